import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import ann
from fieldglass.llm.queries import QUERIES


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2.0) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>, rank int, score double").repartition(4)


def test_recall_on_a_table(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    df = spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack([np.asarray(v, float) for v in rows["embedding"]])
    got = QUERIES["op10_ann"](spark, big).toPandas()
    want = exact(ids, x, ids[ids % 100 == 0], 10)
    assert set(got["query_id"]) == set(want)
    hits = []
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert (np.diff(g["score"]) >= 0).all()
        assert len(g) == 10
        hits.append(len(set(g["vec_id"]) & {i for i, _ in want[q]}))
        for i, s in zip(g["vec_id"], g["score"], strict=True):
            assert s == pytest.approx(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum()), abs=1e-12)
    assert np.mean(hits) / 10 >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[100:200] = x[100]
    ids = np.arange(300)
    df = table(spark, ids, x)
    odd = [(1000, None), (1100, [0.0] * 6), (1200, [float("nan")] + [1.0] * 5), (1300, [None] + [1.0] * 5), (1400, [float("inf")] + [1.0] * 5), (1500, [1.0]), (None, [1.0] * 6), (100, x[100].tolist())]
    more = spark.createDataFrame([(i, v, 1, 2.0) for i, v in odd], df.schema)
    got = ann.search(df.union(more), F.col("vec_id") % 100 == 0, search_rows=100_000).toPandas()
    want = exact(ids, x, [0, 100, 200], 10)
    assert set(got["query_id"]) == {0, 100, 200}
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["vec_id"].tolist() == [i for i, _ in want[q]]


def test_few_and_none(spark):
    df = table(spark, [0, 1, 2], np.eye(3))
    got = ann.search(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df, F.col("vec_id") == 9).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(400, 5)), np.arange(400)
    want = exact(ids, x, ids[ids % 100 == 0], 10)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 7 * 8 * 5)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 1)
    got = ann.search(table(spark, ids, x), F.col("vec_id") % 100 == 0, search_rows=100_000).toPandas()
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["vec_id"].tolist() == [i for i, _ in want[q]]


def test_recall_holds_as_the_table_grows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    n = 40_000
    x = rng.normal(size=(n, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x))}), path)
    got = ann.search(spark.read.parquet(path), F.col("vec_id") % 2000 == 0).toPandas()
    ids = np.arange(n)
    want = exact(ids, x, ids[ids % 2000 == 0], 10)
    hits = [len(set(g["vec_id"]) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id")]
    assert len(hits) == 20 and np.mean(hits) / 10 >= 0.95
