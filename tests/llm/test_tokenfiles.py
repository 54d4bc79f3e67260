import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import tokenfiles
from fieldglass.llm.queries import QUERIES, TOKENIZER, tokenizer_file
from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def path():
    return tokenizer_file(TOKENIZER)


def plain(rows, path):
    """doc_id, start, n_tokens and crc32 with the tokenizer alone; rows of one id and text are alike."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path), 0, []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_a_plain_version(spark, sf_dir, path):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = QUERIES["op12_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == plain(rows, path)


def test_odd_documents_and_order(spark, path, tmp_path):
    df = docs(spark).withColumn("shard", F.lit("x")).withColumn("ids", F.lit("y")).withColumn("tie", F.lit(1)).repartition(5)
    tokenfiles.write_tokens(df, str(tmp_path / "a"), path, row_group_bytes=1 << 16, page_bytes=1 << 10)
    got = sorted(map(tuple, tokenfiles.checksums(tokenfiles.read_documents(spark, str(tmp_path / "a"))).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r.doc_id for r in df.collect()], key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    key = lambda r: (r[0] is not None, r[0], r[2], r[3])
    assert [key(r) for r in sorted(got, key=key)] == sorted(key(r) for r in plain([(r.doc_id, r.text) for r in df.collect()], path))


def test_no_documents(spark, path, tmp_path):
    tokenfiles.write_tokens(docs(spark, []), str(tmp_path / "none"), path)
    assert tokenfiles.read_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def many(spark, path, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tokens"))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("stone river light"), F.hash("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    tokenfiles.write_tokens(df, at, path, row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=100)
    return at


def test_layout_of_the_files(many):
    files = sorted(glob.glob(f"{many}/tokens/*.parquet"))
    last = -1
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        columns = {meta.row_group(0).column(c).path_in_schema: meta.row_group(0).column(c) for c in range(meta.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["start"].encodings
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last  # files and rows ascend
        last = ids[-1]
    assert groups > len(files)


def scanned(df):
    """Rows that the scan of the token files gave, from the plan's metrics."""
    df.collect()

    def scans(plan):
        if plan.nodeName().startswith("Scan parquet") and "ids" in plan.simpleString(500):
            yield int(plan.metrics().apply("numOutputRows").value())
        kids = plan.children()
        for k in range(kids.size()):
            yield from scans(kids.apply(k))
        if plan.nodeName() == "AdaptiveSparkPlan":
            yield from scans(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            yield from scans(plan.plan())

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_selective_reads(spark, many):
    whole = {r.doc_id: r for r in tokenfiles.read_documents(spark, many).collect()}
    some = tokenfiles.read_documents(spark, many, F.col("doc_id").between(3000, 3009))
    assert {r.doc_id: r for r in some.collect()} == {i: whole[i] for i in range(3000, 3010)}
    assert 10 <= scanned(some) <= 500  # pages, not the file
    lengths = tokenfiles.read_documents(spark, many, ids=False)
    assert [(r.doc_id, r.start, r.n_tokens) for r in lengths.orderBy("doc_id").collect()] == [(i, r.start, r.n_tokens) for i, r in sorted(whole.items())]
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids#" not in plan and "array<int>" not in plan
