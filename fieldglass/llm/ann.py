"""Approximate nearest neighbours with a forest of random-projection trees.

A forest is fitted on a bounded sample. Its nodes split at the median projection
on the line through two sample points. Every row is indexed: each tree gives it a
leaf. A query walks all trees through one priority queue, nearest margins first,
until its leaves hold ``search_share`` of the entries of all trees, and ``search_rows``
entries and 60 leaves at least; the candidates of those leaves are then ranked by exact
distance in double precision. A share keeps recall as the table grows; the work of a
query grows with the table.

Leaves hold about ``leaf_rows`` rows, and more where a tree would else have more
than ``leaves`` of them, so that the leaves that a query opens don't grow in number.

The work is shuffled by leaf, with vectors in the type that they came in. A row that
several opened leaves hold is ranked in the first of them alone: rows carry their
leaves in all trees, queries the opened ones as bits, so no distance is taken twice
and a query takes no more of them than an exact scan. Equal
vectors are indexed once, with the few smallest ids that can count, so copies don't
fill a leaf; leaves of more rows or queries than a task should hold are split into
blocks by their counts. Each block gives its nearest rows for each query, and a
ranked window takes the nearest of all blocks.

Cases: vectors that are null, zero, of another length than ``dim`` (by default
the commonest one) or hold null or non-finite components take no part, nor do
rows without an id; repeated ids count as often as they occur with different
vectors; ties go to the smaller id; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.store import job, stored

SAMPLE_ROWS = 20_000
TREES = 12
LEAF_ROWS = 200
LEAVES = 50
SEARCH_ROWS = 15_000
SEARCH_SHARE = 0.07
SEARCH_LEAVES = 60
#: Rows of a leaf that a task holds at once, as bytes of double precision, and queries.
BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 2_000
SEED = 5


@dataclass
class Tree:
    """Inner node k splits at ``vector[k] . x > cut[k]``; ``child`` is a node, or -1 - leaf."""

    vector: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        node = np.full(len(x), 0 if len(self.cut) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            k = node[inner]
            right = np.einsum("ij,ij->i", self.vector[k], x[inner]) > self.cut[k]
            node[inner] = self.child[k, right.astype(int)]
        return -1 - node


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree whose leaves hold at most ``leaf`` rows of ``sample``."""
    vectors, cuts, children, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        place = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = rng.choice(rows, 2, replace=False)
                line = sample[a] - sample[b]
                line = line / (np.sqrt((line**2).sum()) or 1.0)
                along = sample[rows] @ line
                cut = float(np.median(along))
                right = along > cut
                if 0 < right.sum() < len(rows):
                    place = len(cuts)
                    vectors.append(line)
                    cuts.append(cut)
                    children.append([0, 0])
                    todo += [(rows[right], place, 1), (rows[~right], place, 0)]
                    break
        if place is None:
            place = -1 - leaves
            leaves += 1
        if parent >= 0:
            children[parent][side] = place
    dim = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(vectors).reshape(-1, dim), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), max(leaves, 1))


@dataclass
class Forest:
    trees: list[Tree]
    first: list[int]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        return np.column_stack([t.leaf_of(x) + f for t, f in zip(self.trees, self.first, strict=True)])

    def search(self, q: np.ndarray, sizes: dict[int, int], enough: int, leaves: int = SEARCH_LEAVES) -> list[int]:
        """Leaves in the order of one shared queue, at least ``leaves``, until they hold ``enough`` rows (over all trees)."""
        projected = [t.vector @ q - t.cut for t in self.trees]
        heap = [(0.0, t, 0 if len(tree.cut) else -1) for t, tree in enumerate(self.trees)]
        heapq.heapify(heap)
        found, held = [], 0
        while heap and (held < enough or len(found) < leaves):
            far, t, node = heapq.heappop(heap)
            while node >= 0:
                margin = projected[t][node]
                near = int(margin > 0)
                child = self.trees[t].child[node]
                heapq.heappush(heap, (max(far, abs(margin)), t, int(child[1 - near])))
                node = int(child[near])
            key = self.first[t] - 1 - node
            found.append(key)
            held += sizes.get(key, 0)
        return found


def fit(vectors: DataFrame, rows: int, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES, seed: int = SEED) -> Forest:
    """A forest for ``rows`` distinct vectors, from the ``sample_rows`` of smallest hash.

    Leaves are sized so that each holds about ``leaf_rows`` of all rows, or the
    share of them that gives a tree about ``leaves``, but at least 4 of the sample.
    """
    chosen = vectors.orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).toPandas()["vector"]
    sample = np.stack([np.asarray(v, float) for v in chosen]) if len(chosen) else np.zeros((0, 1))
    leaf = max(4, int(max(leaf_rows, rows / leaves) * len(sample) / max(rows, 1)))
    rng = np.random.default_rng(seed)
    grown = [grow(sample, leaf, rng) for _ in range(trees)]
    first = np.concatenate([[0], np.cumsum([t.leaves for t in grown])[:-1]]).tolist()
    return Forest(grown, first)


def usable(embeddings: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """vec_id and vector (array of float if it is one, else of double) of the rows that take part."""
    v = F.col(vector)
    v = v if embeddings.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    if dim is None:
        common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        dim = common[0]["dim"] if common else 0
    return rows.filter(F.size("vector") == dim)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of vectors, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


RANKED = "query_class bigint, class_id bigint, score double"


def _nearest(own: pa.Table, asking: pa.Table, k: int, first: list[int]) -> pa.Table:
    """The ``k`` nearest of the rows of a block for each query, by exact distance, ties by id; rows that it meets in an earlier tree are left to that."""
    found = []
    if own.num_rows and asking.num_rows:
        all_x, all_ids = _matrix(own["vector"].combine_chunks()), own["class_id"].to_numpy()
        tree = int(np.searchsorted(first, own["leaf"][0].as_py(), "right")) - 1
        earlier = own["leaves"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1)[:, :tree]
        for query, opened, q in zip(asking["class_id"].to_pylist(), asking["opened"].to_pylist(), _matrix(asking["vector"].combine_chunks()), strict=True):
            fresh = ~np.unpackbits(np.frombuffer(opened, np.uint8), bitorder="little").astype(bool)[earlier].any(axis=1)
            x, ids = all_x[fresh], all_ids[fresh]
            score = np.sqrt(((x - q) ** 2).sum(axis=1))
            near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
            best = near[np.lexsort((ids[near], score[near]))[:k]]
            found.append((np.full(len(best), query), ids[best], score[best]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_class", "class_id", "score"])


def _search(embeddings: DataFrame, is_query, k: int, vector: str, dim: int | None, sample_rows: int, trees: int, leaf_rows: int, leaves: int, search_rows: int, search_share: float) -> DataFrame:
    rows = stored(usable(embeddings, vector, dim), "vectors")
    spark = rows.sparkSession
    by_id = W.partitionBy("vector").orderBy("vec_id")
    members = rows.distinct().withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    classes = stored(members.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("members")), "classes")
    size = classes.count()
    forest = fit(classes.select("vector"), size, sample_rows, trees, leaf_rows, leaves)
    shipped = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shipped.value.keys(_matrix(b.column(1)))
            n = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(n), b.column(1).take(n), leaves.take(n)], ["leaf", "class_id", "vector", "leaves"])

    schema = f"leaf bigint, class_id bigint, vector {classes.schema['vector'].dataType.simpleString()}"
    total_leaves = forest.first[-1] + forest.trees[-1].leaves
    block_rows = max(1, BLOCK_BYTES // (8 * max(1, forest.trees[0].vector.shape[1])))
    indexed = classes.select("class_id", "vector").mapInArrow(index, f"{schema}, leaves array<int>")
    # one count for each leaf of the forest, whose size the sample bounds
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    held = spark.sparkContext.broadcast(sizes)
    enough = max(search_rows, int(search_share * sum(sizes.values())))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                found = [shipped.value.search(q, held.value, enough) for q in _matrix(part.column(1))]
                n = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                bits = np.zeros((part.num_rows, total_leaves), np.uint8)
                for row, leaves in enumerate(found):
                    bits[row, leaves] = 1
                opened = pa.array([b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([key for f in found for key in f], pa.int64()), part.column(0).take(n), part.column(1).take(n), opened.take(n)], ["leaf", "class_id", "vector", "opened"])

    queries = rows.filter(is_query)
    sought = classes.join(queries.select("vector").distinct(), "vector", "left_semi")
    probes = stored(sought.select("class_id", "vector").mapInArrow(probe, f"{schema}, opened binary"), "probes")
    asked = {r["leaf"]: r["count"] for r in probes.groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame([(leaf, -(-n // block_rows), -(-asked.get(leaf, 0) // BLOCK_QUERIES)) for leaf, n in sizes.items() if leaf in asked] or [(-1, 1, 1)], "leaf bigint, row_blocks int, query_blocks int")
    number = lambda of: F.pmod(F.xxhash64("class_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = indexed.join(F.broadcast(blocks), "leaf").select("leaf", number("row_blocks").alias("row_block"), every("query_blocks").alias("query_block"), "class_id", "vector", "leaves")
    right = probes.join(F.broadcast(blocks), "leaf").select("leaf", every("row_blocks").alias("row_block"), number("query_blocks").alias("query_block"), "class_id", "vector", "opened")

    group, first = ("leaf", "row_block", "query_block"), forest.first
    ranked = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(lambda own, asking: _nearest(own, asking, k + 1, first), RANKED)
    near = W.partitionBy("query_class").orderBy("score", "class_id")
    ranked = ranked.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    # copies come back here: at most k + 1 of each class, of which the first k + 1 can count
    ids = W.partitionBy("query_class").orderBy("score", "vec_id")
    hits = ranked.join(classes.select("class_id", "members"), "class_id").select("query_class", F.explode("members").alias("vec_id"), "score")
    hits = hits.withColumn("n", F.row_number().over(ids)).filter(F.col("n") <= k + 1).select("query_class", "vec_id", "score")
    asking = queries.distinct().join(classes.select("vector", F.col("class_id").alias("query_class")), "vector").select(F.col("vec_id").alias("query_id"), "query_class")
    last = W.partitionBy("query_id", "query_class").orderBy("score", "vec_id")
    found = asking.join(hits, "query_class").filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, is_query, k: int = 10, vector: str = "embedding", dim: int | None = None, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES, search_rows: int = SEARCH_ROWS, search_share: float = SEARCH_SHARE) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``is_query`` (a Column over vec_id) holds for.

    query_id, rank from 1, vec_id and score (the Euclidean distance); a query's
    own id is no candidate.
    """
    with job(embeddings.sparkSession, "nearest") as result:
        return result(_search(embeddings, is_query, k, vector, dim, sample_rows, trees, leaf_rows, leaves, search_rows, search_share))
