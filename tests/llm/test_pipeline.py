import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from fieldglass.llm import language, packing, quality
from fieldglass.llm.queries import TOKENIZER, tokenizer_file
from tests.llm.helpers import docs, rows
from tests.llm.test_jaccard import brute


def test_run_equals_a_plain_version(spark, sf_dir):
    """The kept documents, found with the fitted models' own functions and all pairs, packed whole."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [(r.doc_id, r.text) for r in table.collect()]
    names, scores = language.train(table).predictor()([t or "" for _, t in left])
    left = [d for d, n, s in zip(left, names, scores, strict=True) if n != language.UNKNOWN and s >= corpus_pipeline.LEAST_CONFIDENCE]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    known = {r.doc_id: r.quality for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5}
    sample = sorted((i, t) for i, t in left if i in known)
    model = quality.fit(quality.statistics([t for _, t in sample]), np.array([known[i] for i, _ in sample], float))
    left = [d for d, s in zip(left, model.scores(quality.statistics([t for _, t in left])), strict=True) if s >= quality.THRESHOLD]
    kept = {i for i, _, c in brute(left) if i == c}
    left = [(i, t) for i, t in left if i in kept]
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    encode = packing.WordCache(tokenizer_file(TOKENIZER)).encode
    assert got == {i: len(ids) // 4 + 1 for (i, _), ids in zip(left, encode([t for _, t in left]), strict=True)}
    assert 0 < len(got) < table.count()


def test_stages_keep_columns_and_cope(spark, sf_dir, tmp_path):
    data = rows() + [(500 + i, *r[1:]) for i, r in enumerate(rows()[:5])]
    df = docs(spark, data + [(1, None, "en", None, None, None, None, None), (None, rows()[3][1], "en", None, None, None, None, None), (7, *rows()[7][1:])])
    columns = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = df.count()
        df = stage(spark, df, sf_dir)
        assert df.columns == columns
        path = str(tmp_path / str(before) / _)
        df.write.parquet(path)
        df = spark.read.parquet(path)
        assert df.count() <= before
    ids = [r.doc_id for r in df.collect()]
    assert not {500, 501, 502, 503, 504} & set(ids)
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_near_duplicates_decide_by_row(spark, sf_dir):
    """Texts of one id are documents of their own, copies of rows without an id go, repeated rows stay once."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    data = [(1, a, "en", "s"), (2, b, "en", "s"), (2, a, "en", "s"), (2, c, "en", "s"), (None, c, "en", "s"), (None, "only one " + a[::-1], "en", "s"), (3, b, "en", "t"), (1, a, "en", "s"), (1, a, "de", "s"), (5, "", "en", "s"), (6, "", "en", "s")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string").repartition(3)
    for _ in range(2):
        got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect()), key=str)
        assert got == sorted([(1, a), (2, b), (2, c), (0, "only one " + a[::-1]), (5, ""), (6, "")], key=str)


@pytest.mark.parametrize("at", range(3))
def test_empty_stages(spark, sf_dir, at):
    assert corpus_pipeline.STAGES[at][1](spark, docs(spark, []), sf_dir).count() == 0
