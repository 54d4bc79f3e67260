"""Hard negatives of labelled vectors, by an exact join over Voronoi cells.

An anchor's positives are the rows of its label with the highest inner products. Its
hard negatives, for each positive, are the best rows of other labels whose score is
within a window below the positive's. Both are searches for the highest inner
products under a bound.

Vectors are augmented by one component that brings all rows to the largest norm;
anchors are scaled to it. Then a higher inner product is a smaller distance, and the
bounds of metric spaces hold. Rows go to the cell of their nearest pivot, with their
distance to it. For each anchor a sample of rows gives a score that its last result
can't fall below, so a largest distance, and the window gives a smallest one. With
the distances between anchor and pivots these say which cells, and which ring of each
cell, can hold a result. Anchors are dealt to groups of neighbouring cells; a row is
copied to those groups alone that have its ring of its cell in their bounds. Groups
and rows meet in blocks of a bounded number of rows and anchors, where a plain exact
join gives each anchor its best rows of the block, and a ranked window over the
blocks gives the best of all. Nothing is approximate: pivots and sample only steer
what is read.

Components x count as floor(256 x), scores are whole numbers. As long as the largest
squared norm is below 2**53 they are exact in double precision; beyond that blocks
count in Python's integers, and a score outside the long range is held at its end.

Cases: rows without an id, label or vector, or with a null or non-finite component,
take no part; nor do vectors of another length than ``dim`` (by default the commonest
one). Zero vectors do. Rows with the same id, label and vector count once; other rows
of a repeated id are rows of their own, and none is a positive of an anchor with its
id; positives of one id and score are one. Ties go to the smaller id. An anchor without rows of its label, or without rows in
a window, has no rows there. An empty table gives none; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.store import job, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, times 100, lies between these times the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows whose scores bound every anchor's search, and cells; both are read by every task.
SAMPLE_ROWS, PIVOTS = 4_096, 128
#: Rows and anchors that meet in a task at once.
BLOCK_ROWS, GROUP_ANCHORS = 8_192, 1_024
SEED = 11
#: Of the largest distance: more than rounding can shift a bound.
SLACK = 1e-6


def usable(embeddings: DataFrame, vector: str = "embedding", label: str = "label", dim: int | None = None) -> DataFrame:
    """vec_id, label and vector (array of float if it is one, else of double) of the rows that take part, each once."""
    v = F.col(vector)
    v = v if embeddings.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), v.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    if dim is None:
        common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        dim = common[0]["dim"] if common else 0
    return rows.filter(F.size("vector") == dim).distinct()


def whole(column: pa.Array) -> np.ndarray:
    """The vectors of a column as whole numbers, in double precision."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def _scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all anchors and rows."""
    if exact:
        return anchors @ rows.T
    wide = lambda x: np.array([[int(c) for c in v] for v in x], object).reshape(x.shape)
    found = wide(anchors) @ wide(rows).T
    return np.clip(found, -(2**63), 2**63 - 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, in that order."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= (np.partition(scores, -k)[-k] if scores.dtype != object else sorted(scores)[-k]))
    return near[np.lexsort((ids[near], -scores[near]))[:k]] if scores.dtype != object else np.array(sorted(near, key=lambda i: (-scores[i], ids[i]))[:k], int)


def window_of(positive: int) -> tuple[int, int]:
    """The least and most score of a negative under a positive's score."""
    return -((-LEAST_PERCENT * positive) // 100), MOST_PERCENT * positive // 100


@dataclass
class Map:
    """Pivots, what their cells hold, and a sample of rows: all bounded by the settings above."""

    pivots: np.ndarray
    norm: float
    exact: bool
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None

    def augmented(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them to the largest norm."""
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))])

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors at the largest norm with a component of 0, and what they were multiplied by (0 for a zero vector)."""
        norms = np.sqrt((x**2).sum(axis=1))
        by = np.divide(self.norm, norms, out=np.zeros_like(norms), where=norms > 0)
        return np.column_stack([x * by[:, None], np.zeros(len(x))]), by

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented vectors to all pivots."""
        squares = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def rings(self, to_pivots: np.ndarray, by: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells that can hold rows with scores of ``low`` to ``high`` for one anchor, with the rings of distances to look in."""
        slack = SLACK * (self.norm + 1)
        if by > 0:
            of = lambda score: np.sqrt(max(2 * self.norm**2 - 2 * by * score, 0.0))
            far = of(low) + slack if np.isfinite(low) else np.inf
            near = of(high) - slack if np.isfinite(high) else 0.0
        else:
            far, near = np.inf, 0.0
        inner = np.maximum(to_pivots - far, near - to_pivots)
        outer = to_pivots + far
        # beyond the plane halfway to the anchor's own pivot, no row of a cell is nearer than that plane
        own = int(to_pivots.argmin())
        between = np.sqrt(((self.pivots - self.pivots[own]) ** 2).sum(axis=1))
        plane = np.divide(to_pivots**2 - to_pivots[own] ** 2, 2 * between, out=np.zeros_like(between), where=between > 0)
        cells = np.flatnonzero((inner <= self.most + slack) & (outer >= self.least - slack) & (plane <= far + slack))
        return cells, inner[cells] - slack, outer[cells] + slack


def survey(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS, seed: int = SEED) -> Map | None:
    """Pivots drawn from the ``sample_rows`` rows of smallest hash; None without rows."""
    tip = F.xxhash64("vector", "vec_id", "label")
    sample = rows.orderBy(tip, "vec_id", "label").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float((whole(b.column(0)) ** 2).sum(axis=1).max(initial=0.0))])], ["square"])

    square = rows.select("vector").mapInArrow(norms, "square double").agg(F.max("square")).first()[0]
    x = whole(sample["vector"].combine_chunks())
    norm, exact = float(np.sqrt(square)), square < 2**53
    found = Map(np.zeros((0, 0)), norm, exact, sample["vec_id"].to_numpy(), sample["label"].to_numpy(), x)
    points = np.unique(found.augmented(x), axis=0)
    rng = np.random.default_rng(seed)
    found.pivots = points[np.sort(rng.choice(len(points), min(pivots, len(points)), replace=False))]
    return found


def _celled(rows: DataFrame, shipped) -> DataFrame:
    """Each row with its nearest pivot and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                far = shipped.value.to_pivots(shipped.value.augmented(whole(part.column(2))))
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["vec_id", "label", "vector", "cell", "distance"])

    return rows.mapInArrow(run, f"vec_id bigint, label bigint, vector {rows.schema['vector'].dataType.simpleString()}, cell int, distance double")


def _anchors(anchors: DataFrame, shipped, group_anchors: int) -> DataFrame:
    """Anchors with their nearest pivot, dealt to groups of about ``group_anchors`` of neighbouring cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                home = shipped.value.to_pivots(shipped.value.scaled(whole(part.column(2)))[0]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32))], ["vec_id", "label", "vector", "home"])

    homed = stored(anchors.mapInArrow(run, f"vec_id bigint, label bigint, vector {anchors.schema['vector'].dataType.simpleString()}, home int"), "anchors")
    counts = {r["home"]: r["count"] for r in homed.groupBy("home").count().collect()}  # at most one for each pivot
    # along a chain of nearest pivots: small neighbours share a group, a large cell fills several
    pivots, left, chain = shipped.value.pivots, set(counts), []
    while left:
        chain.append(min(left, key=lambda c: (((pivots[c] - pivots[chain[-1]]) ** 2).sum() if chain else 0, c)))
        left.remove(chain[-1])
    dealt, group, room = [], 0, 0
    for cell in chain:
        several = -(-counts[cell] // group_anchors)
        if counts[cell] > room:
            group, room = group + 1, several * group_anchors
        dealt.append((cell, group, several))
        room -= counts[cell]
        group += several - 1
    groups = anchors.sparkSession.createDataFrame(dealt or [(-1, 0, 1)], "home int, first int, several int")
    key = F.xxhash64("vec_id", "label", "vector")
    found = homed.join(F.broadcast(groups), "home").select("vec_id", "label", "vector", "home", "first", "several", key.alias("anchor_key"))
    return found.withColumn("grp", F.col("first") + F.pmod("anchor_key", F.col("several")).cast("int")).drop("first", "several", "home")


def _met(rows: DataFrame, anchors: DataFrame, needs: DataFrame, keys: list[str], join: Callable, schema: str, block_rows: int) -> DataFrame:
    """Rows of the rings that a group needs, in blocks, joined with the group's anchors by ``join``."""
    rings = stored(needs.groupBy("grp", *keys).agg(F.min("inner").alias("inner"), F.max("outer").alias("outer")), "rings")
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    blocks = stored(rings.join(held, keys).groupBy("grp").agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("blocks")), "blocks")
    served = rows.join(rings.join(blocks, "grp"), keys).filter(F.col("distance").between(F.col("inner"), F.col("outer")))
    served = served.select("grp", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.col("blocks")).cast("int").alias("block"), "vec_id", "label", "vector")
    asking = anchors.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # blocks are parts of a group: what a task holds is bounded by block_rows and the anchors of a group
    return served.groupBy("grp", "block").cogroup(asking.groupBy("grp", "block")).applyInArrow(join, schema)


NEEDS = "grp int, label bigint, cell int, inner double, outer double"
POSITIVE = "anchor_key bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "anchor_key bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _needs(batches: Iterator[pa.RecordBatch], shipped, span: Callable) -> Iterator[pa.RecordBatch]:
    """The rings of cells that each anchor of a batch needs; ``span`` gives the scores that it looks for."""
    of: Map = shipped.value
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x = whole(part.column("vector"))
            scaled, by = of.scaled(x)
            far, scores = of.to_pivots(scaled), _scores(x, of.sample, of.exact)
            found: dict[tuple, tuple] = {}
            for k, (group, label) in enumerate(zip(part.column("grp").to_pylist(), part.column("label").to_pylist(), strict=True)):
                scope = span(part, k, label, scores[k])
                if scope is None:
                    continue
                for cell, inner, outer in zip(*of.rings(far[k], by[k], *scope), strict=True):
                    a, b = found.get((group, label, cell), (inner, outer))
                    found[group, label, cell] = (min(a, inner), max(b, outer))
            yield from _table([(*key, *ring) for key, ring in found.items()], NEEDS).to_batches()


def _positives(rows: DataFrame, anchors: DataFrame, shipped, k: int, block_rows: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label."""

    def span(part: pa.RecordBatch, row: int, label: int, scores: np.ndarray) -> tuple[float, float]:
        of = shipped.value
        mine = scores[(of.labels == label) & (of.ids != part.column("vec_id")[row].as_py())]
        return (float(np.sort(mine)[-k]) if len(mine) >= k else -np.inf, np.inf)

    needs = anchors.mapInArrow(lambda batches: _needs(batches, shipped, span), NEEDS)

    def join(own: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asking.num_rows:
            x, ids, labels = whole(own["vector"].combine_chunks()), own["vec_id"].to_numpy(), own["label"].to_numpy()
            a, a_ids, a_labels, keys = whole(asking["vector"].combine_chunks()), asking["vec_id"].to_numpy(), asking["label"].to_numpy(), asking["anchor_key"].to_numpy()
            for label in np.unique(a_labels):
                mine, ask = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                if not len(mine):
                    continue
                for row, scores in zip(ask, _scores(a[ask], x[mine], shipped.value.exact), strict=True):
                    other = np.flatnonzero(ids[mine] != a_ids[row])
                    top = other[best(scores[other], ids[mine][other], k)]
                    found += [(int(keys[row]), int(a_ids[row]), int(ids[mine[i]]), int(scores[i])) for i in top]
        return _table(found, POSITIVE)

    met = _met(rows, anchors, needs, ["label", "cell"], join, POSITIVE, block_rows)
    order = W.partitionBy("anchor_key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _negatives(rows: DataFrame, asking: DataFrame, shipped, k: int, block_rows: int) -> DataFrame:
    """The first ``k`` rows of other labels in the window under each positive of an anchor.

    ``asking`` has the anchors with the array ``positives`` of positive_id and positive_score.
    """

    def span(part: pa.RecordBatch, row: int, label: int, scores: np.ndarray) -> tuple[float, float] | None:
        other = scores[shipped.value.labels != label]
        spans = []
        for p in {x["positive_score"] for x in part.column("positives")[row].as_py()}:
            low, high = window_of(p)
            if low <= high:
                inside = other[(other >= low) & (other <= high)]
                spans.append((float(np.sort(inside)[-k]) if len(inside) >= k else float(low), float(high)))
        return (min(a for a, _ in spans), max(b for _, b in spans)) if spans else None

    needs = asking.mapInArrow(lambda batches: _needs(batches, shipped, span), NEEDS).drop("label")

    def join(own: pa.Table, group: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and group.num_rows:
            x, ids, labels = whole(own["vector"].combine_chunks()), own["vec_id"].to_numpy(), own["label"].to_numpy()
            for at in range(0, group.num_rows, 64):  # scores of 64 anchors at a time
                part = group.slice(at, 64)
                scores = _scores(whole(part["vector"].combine_chunks()), x, shipped.value.exact)
                for row, anchor in enumerate(part.select(["anchor_key", "vec_id", "label", "positives"]).to_pylist()):
                    windows = [(p, *window_of(p["positive_score"])) for p in anchor["positives"]]
                    windows = [w for w in windows if w[1] <= w[2]]
                    if not windows:
                        continue
                    some = np.flatnonzero((labels != anchor["label"]) & (scores[row] >= min(w[1] for w in windows)) & (scores[row] <= max(w[2] for w in windows)))
                    for p, low, high in windows:
                        inside = some[(scores[row][some] >= low) & (scores[row][some] <= high)]
                        top = inside[best(scores[row][inside], ids[inside], k)]
                        found += [(anchor["anchor_key"], anchor["vec_id"], p["positive_id"], p["positive_score"], int(ids[i]), int(scores[row][i])) for i in top]
        return _table(found, NEGATIVE)

    met = _met(rows, asking, needs, ["cell"], join, NEGATIVE, block_rows)
    order = W.partitionBy("anchor_key", "anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _mine(embeddings: DataFrame, is_anchor: Column, relabel: Column | None, positives: int, negatives: int, vector: str, label: str, dim: int | None, sample_rows: int, pivots: int, block_rows: int, group_anchors: int) -> DataFrame:
    rows = usable(embeddings, vector, label, dim)
    rows = stored(rows if relabel is None else rows.withColumn("label", relabel.cast("bigint")), "vectors")
    spark = rows.sparkSession
    found = survey(rows, sample_rows, pivots)
    if found is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    celled = stored(_celled(rows, spark.sparkContext.broadcast(found)), "cells")
    found.least, found.most = np.full(len(found.pivots), np.inf), np.full(len(found.pivots), -np.inf)
    for r in celled.groupBy("cell").agg(F.min("distance").alias("a"), F.max("distance").alias("b")).collect():  # at most one for each pivot
        found.least[r["cell"]], found.most[r["cell"]] = r["a"], r["b"]
    shipped = spark.sparkContext.broadcast(found)
    anchors = stored(_anchors(rows.filter(is_anchor), shipped, group_anchors), "groups")
    first = stored(_positives(celled, anchors, shipped, positives, block_rows), "positives")
    of = F.collect_set(F.struct("positive_id", "positive_score")).alias("positives")  # at most ``positives`` of each anchor
    asking = stored(anchors.join(first.groupBy("anchor_key", F.col("anchor_id").alias("vec_id")).agg(of), ["anchor_key", "vec_id"]), "asking")
    return _negatives(celled, asking, shipped, negatives, block_rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, vector: str = "embedding", label: str = "label", dim: int | None = None, sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """Hard negatives for each anchor (rows of ``embeddings`` that ``is_anchor``, a Column over vec_id, holds for) and positive.

    anchor_id, positive_id, rank from 1, negative_id, positive_score and
    negative_score. ``relabel``, a Column over vec_id and label, replaces the labels
    first.
    """
    with job(embeddings.sparkSession, "negatives") as result:
        return result(_mine(embeddings, is_anchor, relabel, positives, negatives, vector, label, dim, sample_rows, pivots, block_rows, group_anchors))
