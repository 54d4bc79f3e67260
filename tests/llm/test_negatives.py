import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import negatives
from fieldglass.llm.queries import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank string, score string, cell int, grp int, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, "r", "s", 9, 9, 9) for i, v, y in rows], SCHEMA).repartition(4)


def brute(rows, is_anchor, positives=5, k=10):
    """All pairs, in Python's integers."""
    rows = [(i, [int(np.floor(256 * np.float64(c))) for c in v], y) for i, v, y in {(i, tuple(v), y) for i, v, y in rows}]
    out = set()
    for a, x, label in rows:
        if is_anchor(a):
            scored = sorted((-sum(p * q for p, q in zip(x, z, strict=True)), i, y) for i, z, y in rows)
            for p, i in dict.fromkeys([(-s, i) for s, i, y in scored if y == label and i != a][:positives]):
                inside = [(i, -s) for s, i, y in scored if y != label and 30 * p <= -100 * s <= 90 * p][:k]
                out |= {(a, i, n, j, p, s) for n, (j, s) in enumerate(inside, 1)}
    return out


def found(df):
    got = df.collect()
    assert len(got) == len(set(got))
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}


def drawn(n, dim, seed, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    y = rng.integers(0, labels, n)
    x = centres[y] + spread * rng.normal(size=(n, dim)) + centres.mean(axis=0)
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, y, strict=True))]


def test_query_equals_its_sql(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    assert spark_rows(QUERIES["op11_negatives"](spark, big)) == duck_rows(ORACLES["op11_negatives"], big)


@pytest.mark.parametrize("settings", [{}, {"sample_rows": 40, "pivots": 7, "block_rows": 50, "group_anchors": 6}, {"sample_rows": 1, "pivots": 1}])
def test_equals_all_pairs(spark, settings):
    rows = drawn(600, 8, 1) + drawn(60, 8, 2, spread=0.01)
    rows = [(n, v, y) for n, (_, v, y) in enumerate(rows)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert found(negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, **settings)) == want


def test_odd_rows(spark):
    rows = drawn(80, 4, 3)
    same = [(100 + i, rows[5][1], i % 2) for i in range(40)]  # copies: ties go by id
    again = [rows[0], rows[0], (10, rows[3][1], rows[3][2]), (10, rows[4][1], rows[4][2]), (200, [0.0] * 4, 1), (210, [-1.0] * 4, 2), (-20, rows[6][1], 1)]
    odd = [(300, None, 1), (310, [1.0] * 4, None), (320, [float("nan")] + [1.0] * 3, 1), (330, [None] + [1.0] * 3, 1), (340, [float("inf")] + [1.0] * 3, 1), (350, [1.0], 1), (None, [1.0] * 4, 1), (360, [], 1)]
    want = brute(rows + same + again, lambda i: i % 10 == 0)
    got = found(negatives.mine(table(spark, rows + same + again + odd), F.col("vec_id") % 10 == 0, block_rows=30, group_anchors=3))
    assert got == want


def test_large_components_are_exact(spark):
    rows = [(i, [c * 3e5 for c in v], y) for i, v, y in drawn(120, 5, 4)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and max(p for *_, p, _ in want) > 2**53
    assert found(negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, pivots=5)) == want


def test_few_and_none(spark):
    rows = [(0, [1, 0], 1), (1, [1, 0], 1), (2, [0.5, 0], 2)]
    assert found(negatives.mine(table(spark, rows), F.col("vec_id") == 0)) == {(0, 1, 1, 2, 65536, 32768)}
    assert negatives.mine(table(spark, rows), F.col("vec_id") == 7).count() == 0
    assert negatives.mine(table(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(table(spark, [(0, [0, 0], 1), (1, [0, 0], 1), (2, [0, 0], 2)]), F.col("vec_id") == 0).count() == 1


def test_rings_leave_out_rows_that_cannot_serve(spark):
    """With tight groups of vectors, a group of anchors gets a part of the rows, and the result is the same."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6))
    rows = [(i, (centres[i % 40] * (1 if i % 3 else 0.7) + 0.02 * rng.normal(size=6)).tolist(), i % 3) for i in range(2000)]
    df = negatives.usable(table(spark, rows)).cache()
    of = negatives.survey(df, 400, 40)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    to = of.to_pivots(of.augmented(x))
    cell, far = to.argmin(axis=1), to.min(axis=1)
    of.least = np.array([far[cell == c].min(initial=np.inf) for c in range(len(of.pivots))])
    of.most = np.array([far[cell == c].max(initial=-np.inf) for c in range(len(of.pivots))])
    scaled, by = of.scaled(x[:1])
    scores = x @ x[0]
    low, high = np.sort(scores)[-60], np.sort(scores)[-20]
    cells, inner, outer = of.rings(of.to_pivots(scaled)[0], by[0], low, high)
    ring = {c: (a, b) for c, a, b in zip(cells, inner, outer, strict=True)}
    served = np.array([c in ring and ring[c][0] <= d <= ring[c][1] for c, d in zip(cell, far, strict=True)])
    assert served[(scores >= low) & (scores <= high)].all()
    assert served.mean() < 0.3
