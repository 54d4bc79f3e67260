import re
from collections import Counter
from itertools import permutations

import pytest

from fieldglass.llm import filteraudit
from fieldglass.llm.queries import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows
from tests.llm.helpers import docs, odd_rows, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text, copy):
    words = WORDS.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    cells = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), copy]
    return sum(c << k for k, c in enumerate(cells))


def brute(data, labels):
    data = [(r[0], r[1] or "", r[2] or "") for r in data]
    label = {}
    for i, good, toxic in labels:
        a, b = label.get(i, (False, False))
        label[i] = (a or good == 1, b or toxic == 1)
    rows = []
    for i, text, part in data:
        copy = i is not None and any(t == text and j is not None and j < i for j, t, _ in data)
        rows.append((part, plain_mask(text, copy), *label.get("none" if i is None else i, (False, False))))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                mine = [(n, r) for n, r in enumerate(rows) if r[0] == part]
                fails = [(n, r) for n, r in mine if r[1] & bit]
                removed = [(n, r) for n, r in fails if n not in gone]
                redundant = len(fails) - len(removed)
                gone |= {n for n, _ in removed}
                total[part, letter] += len(removed)
                out[part, order, step] = [len(mine) - len(gone), len(removed), redundant, sum(r[1] == bit for _, r in mine), sum(r[2] for _, r in removed), sum(r[3] for _, r in removed)]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf_dir, sf):
    at = sf_dir.replace("sf0.001", sf)
    assert spark_rows(QUERIES["op13_filter_audit"](spark, at)) == duck_rows(ORACLES["op13_filter_audit"], at)


def test_equals_a_plain_version(spark):
    shout = "AB " * 250
    many = " ".join(f"w{i}" for i in range(300))
    texts = [shout, shout, many, many + " $", many.upper(), "a " * 400, many, "x y z " * 150, "é" * 10 + "A", "😀" * 40 + "A", "A" + "b" * 33, "A" + "b" * 32, "a\x00 b\x1c c " * 120, many]
    data = rows(20) + odd_rows() + [(i, t, ["en", None, ""][i % 3], None, None, None, None, None) for i, t in enumerate(texts)] + [(None, many, "en", None, None, None, None, None)]
    labels = [(0, 1, 0), (0, 0, 1), (2, 1, None), (3, None, 1), (6, 1, 1), (None, 1, 1), (99999, 1, 1)]
    marked = spark.createDataFrame([(*r, "x", 1) for r in labels], "doc_id bigint, quality int, toxic int, part string, mask int")
    got = filteraudit.interactions(docs(spark, data).repartition(4), marked)
    want = brute(data, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r[n] for n in names) for r in got.collect()]
    assert len(got) == len(set(got)) == 600 * len({r[2] or "" for r in data})
    assert set(got) == want


def test_no_documents_and_no_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert filteraudit.interactions(docs(spark, []), labels).count() == 0
    got = filteraudit.interactions(docs(spark), labels.limit(0)).collect()
    assert got and not any(r.good_lost or r.toxic_lost for r in got)
