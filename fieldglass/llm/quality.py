"""Quality classification by histogram gradient-boosted trees over text statistics.

The statistics of a text are shares of character classes, word and line figures
and repetition, from the whole text. Trees are grown level by level on binned
features with logistic loss; a fitted model is four flat arrays, and scoring
walks all trees of a batch at once in numpy.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash of
their id, so the sample doesn't depend on the order of rows. Scoring is row-wise.

Cases: null text counts as empty, and empty texts get a score; with labels of one
kind only, or none, every score is that share of label 1 (0.5 without labels);
rows that repeat are scored alike; further columns are ignored; of several rows
with one doc_id, one trains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty

MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_ROWS = 64, 80, 4, 0.15, 1.0, 8

_CLASSES = (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("blank", b" \t"),
    ("line", b"\n\r"),
    ("stop", b"."),
    ("comma", b",;:"),
    ("call", b"!?"),
    ("sign", b"#$%&*@^~+=_"),
    ("bar", b"|\\/"),
    ("bracket", b"<>[]{}()"),
    ("quote", b"\"'`-"),
    ("high", bytes(range(128, 256))),
    ("control", bytes([*range(9), 11, 12, *range(14, 32), 127])),
)
_MEMBER = np.array([[b in members for _, members in _CLASSES] for b in range(256)], np.float64)
FEATURES = (*(f"share_{name}" for name, _ in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "line_bytes", "distinct_lines", "longest_line", "upper_of_letters", "stops_per_word", "entropy")


def statistics(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    counts = np.zeros((len(texts), 256))
    words = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts[i] = np.bincount(raw, minlength=256)
        tokens = text.split()
        lines = text.split("\n")
        words[i] = len(tokens), len(set(tokens)), len(lines), len(set(lines)), max(map(len, lines))
    size = np.maximum(counts.sum(axis=1), 1)
    by_class = counts @ _MEMBER
    share = by_class / size[:, None]
    n_words = np.maximum(words[:, 0], 1)
    used = counts / size[:, None]
    entropy = -(used * np.log2(np.where(used > 0, used, 1))).sum(axis=1)
    letters = np.maximum(by_class[:, 0] + by_class[:, 1], 1)
    more = (
        np.log1p(counts.sum(axis=1)),
        np.log1p(words[:, 0]),
        (size - by_class[:, 3] - by_class[:, 4]) / n_words,
        words[:, 1] / n_words,
        size / np.maximum(words[:, 2], 1),
        words[:, 3] / np.maximum(words[:, 2], 1),
        words[:, 4] / size,
        by_class[:, 1] / letters,
        by_class[:, 5] / n_words,
        entropy,
    )
    return np.column_stack([share, *more])


@dataclass
class BoostedTrees:
    """Complete binary trees: node k has children 2k+1 and 2k+2; the last level holds values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for the rows of ``x``."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            at = np.zeros((len(x), trees), np.int64)
            tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            for _ in range(inner.bit_length()):
                right = x[row, self.feature[tree, at]] > self.threshold[tree, at]
                at = 2 * at + 1 + right
            total += self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature and bin of each node's best split; bin -1 where none gains."""
    best, feature, cut = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, -1)
    for f in range(binned.shape[1]):
        key = node * BINS + binned[:, f]
        sums = [np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (g, h, None)]
        (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > best
        best[better], feature[better], cut[better] = top[better], f, at[better]
    return feature, cut


def fit(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Boosted trees for 0/1 labels ``y`` of the rows of ``x``."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = y.mean() if len(y) else 0.5
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    trees = TREES if 0 < share < 1 and len(y) >= 2 * LEAST_ROWS else 0
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not trees:
        return BoostedTrees(feature, threshold, value, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            f, cut = _best_splits(binned, node, nodes, g, h)
            for k in range(nodes):
                if cut[k] >= 0 and cut[k] < len(edges[f[k]]):
                    feature[t, first + k], threshold[t, first + k] = f[k], edges[f[k]][cut[k]]
                else:
                    cut[k] = BINS
            node = 2 * node + (binned[np.arange(len(y)), f[node]] > cut[node])
        value[t] = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        total += value[t][node]
    return BoostedTrees(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> BoostedTrees:
    """A model for ``labels`` (doc_id, quality) from at most ``max_rows`` of them, over the texts of ``docs``."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    columns = ", ".join(f"{name} double" for name in ("doc_id_", *FEATURES)).replace("doc_id_ double", "doc_id bigint, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = statistics(b.column(2).to_pylist())
            yield record_batch({"doc_id": b.column(0), "quality": b.column(1)} | {name: found[:, i] for i, name in enumerate(FEATURES)}, columns)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    # at most max_rows rows of 12 bytes are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, columns)
    sample = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    return fit(sample[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), sample["quality"].to_numpy(float))


def quality_of(model: BoostedTrees, text: Column, spark) -> Column:
    """A column of scores from 0 to 1 for a text column."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shipped.value.scores(statistics(texts.tolist())), dtype="float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))
