"""Sessions, folds, legs, bursts and runs over time-ordered rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.store import stored


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def sessions(df: DataFrame, by: list[str], order: list[str], gap_us: int, ts: str = "ts", name: str = "session") -> DataFrame:
    """Number the runs of rows whose gap to the row before is at most ``gap_us``.

    A gap of exactly ``gap_us`` stays within a session, unlike in session_window.
    """
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(micros(ts) - F.lag(micros(ts)).over(w) > gap_us, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def anchored(df: DataFrame, by: list[str], within_us: int, closed: bool, carry: Sequence[str] = ()) -> DataFrame:
    """The rows (ts, id and the columns to ``carry``) with the first time of their pass as ``anchor`` and whether they are its first row.

    A pass takes the rows of a key up to ``within_us`` after its first one
    (``closed``: those at exactly that time too), however many came between; the
    next row begins another. A task holds one batch of sorted rows and looks up the
    end of each pass in it, so no key's rows have to fit in memory.
    """
    typed = lambda columns: "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)
    names = [*by, "us", "id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, 0
        for batch in batches:
            us = batch.column(len(by)).to_numpy(zero_copy_only=False)
            first, anchors = np.zeros(len(us), bool), np.zeros(len(us), np.int64)
            new = np.zeros(len(us), bool)
            for c in range(len(by)):
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            for start, end in zip([0, *starts], [*starts, len(us)], strict=True):
                if start == end:
                    continue
                at, here = start, tuple(batch.column(c)[start].as_py() for c in range(len(by)))
                going = here == key
                while at < end:
                    if not going:
                        anchor, first[at] = us[at], True
                    to = at + int(np.searchsorted(us[at:end], anchor + within_us, "right" if closed else "left"))
                    anchors[at:to] = anchor
                    at, going = to, False
                key = here
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors), pa.array(first)], [*names, "anchor", "first"])

    rows = df.select(*by, micros("ts").alias("us"), F.col("id").cast("bigint").alias("id"), *carry).filter("us is not null")
    return rows.repartition(*by).sortWithinPartitions(*by, "us", "id").mapInArrow(run, f"{typed(by)}us bigint, id bigint, {typed(carry)}anchor bigint, first boolean")


def same_pass(points: DataFrame, by: list[str], within_us: int) -> DataFrame:
    """Fold points (ts, id, plate, confidence, observations) into passes anchored at their first time.

    The fold sums observations and keeps the best reading, the first of equals. Every
    point counts, also one that is repeated; null is a key like any other. Points
    without a time are in no pass.
    """
    at = F.struct("us", "id")
    best = F.struct("confidence", (-F.col("us")).alias("t"), (-F.col("id")).alias("i"))
    folded = anchored(points, by, within_us, True, ["plate", "confidence", "observations"]).groupBy(*by, "anchor").agg(
        F.min_by("id", at).alias("id"), F.max_by("plate", best).alias("plate"), F.max("confidence").alias("confidence"), F.sum(F.col("observations").cast("bigint")).alias("observations"), F.count("*").alias("folded")
    )
    return folded.select(*by, F.timestamp_micros("anchor").alias("ts"), "id", "plate", "confidence", "observations", "folded")


# Grid strength of a damaged frame, that over a device's own level, that before the level is known, and the frames that make it known.
DAMAGED, DAMAGED_OVER, DAMAGED_AT_FIRST, KNOWN_FRAMES = 1.8, 1.4, 3.0, 20
# The weight of the level so far.
LEVEL_KEEPS = 0.95
# Brightness and focus of a black frame.
BLACK_LUMA, BLACK_FOCUS = 8.0, 5.0


def damaged_frames(frames: DataFrame, by: list[str], order: list[str], carry: Sequence[str] = ()) -> DataFrame:
    """Frames (luma, focus, grid) with ``damaged`` and the device's ``level`` before them.

    The level is the moving mean of the grid strength of the device's sound frames:
    a damaged frame doesn't move it, so each verdict depends on those before. Black
    frames and those without a grid are no evidence and never damaged. A task holds
    one batch of sorted rows and three numbers for its current device.
    """
    columns = [*dict.fromkeys([*by, *order, *carry]), "luma", "focus", "grid"]
    rows = frames.select(*columns[:-3], *(F.col(c).cast("double").alias(c) for c in columns[-3:]))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, seen = None, None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            damaged, levels = [], []
            for here, luma, focus, grid in zip(keys, *(batch.column(c).to_pylist() for c in columns[-3:]), strict=True):
                if here != key:
                    key, level, seen = here, None, 0
                levels.append(level)
                black = luma is not None and focus is not None and luma <= BLACK_LUMA and focus <= BLACK_FOCUS
                if black or grid is None:
                    damaged.append(False)
                    continue
                bad = grid >= (DAMAGED_AT_FIRST if seen < KNOWN_FRAMES else max(DAMAGED, DAMAGED_OVER * level))
                damaged.append(bad)
                if not bad:
                    level = grid if level is None else LEVEL_KEEPS * level + (1 - LEVEL_KEEPS) * grid
                    seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(damaged, pa.bool_()), pa.array(levels, pa.float64())], [*columns, "damaged", "level"])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{schema}, damaged boolean, level double")


def moving_rank(df: DataFrame, by: list[str], value: str, older_us: int, newer_us: int, share: float, least: int, ts: str = "ts", node: str = "id") -> DataFrame:
    """For each row (node) the value at ``share`` of those of its key from ``older_us`` to ``newer_us`` before it, if there are ``least``.

    The place is the whole part of share times their number, from 0. Sorted rows
    pass once: a histogram gains the values that enter the window and loses those
    that leave it, so a row costs the steps of a search tree over the distinct
    values, and a task holds a window's times and values, not a window for each row.
    Values are whole numbers; rows without one, or without a time, aren't counted.
    """
    rows = df.select(*by, micros(ts).alias("_us"), F.col(node).alias("_node"), F.col(value).cast("bigint").alias("_value")).filter("_us is not null")
    keys = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    kind = rows.schema["_node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        held: deque[tuple[int, int]] = deque()  # times and values that wait to enter or are in the window
        inside: deque[tuple[int, int]] = deque()
        counts = Counts()
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            out_rows, ranks = [], []
            for n, (here, us, v) in enumerate(zip(names, batch.column("_us").to_pylist(), batch.column("_value").to_pylist(), strict=True)):
                if here != key:
                    key, counts = here, Counts()
                    held.clear()
                    inside.clear()
                if v is not None:
                    held.append((us, v))
                while held and held[0][0] <= us - newer_us:
                    inside.append(held.popleft())
                    counts.add(inside[-1][1], 1)
                while inside and inside[0][0] < us - older_us:
                    counts.add(inside.popleft()[1], -1)
                if counts.total >= least:
                    out_rows.append(n)
                    ranks.append(counts.at(int(share * counts.total)))
            some = batch.take(pa.array(out_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in by), some.column("_node"), pa.array(ranks, pa.int64())], [*by, node, "rank_value"])

    return rows.repartition(*by).sortWithinPartitions(*by, "_us").mapInArrow(run, f"{keys}{node} {kind}, rank_value bigint")


class Counts:
    """How often whole numbers are held; finds the one at a place in their order.

    Numbers are counted one by one and in blocks of 256, and blocks of blocks, so
    that a search passes few counters however far apart the numbers are.
    """

    def __init__(self) -> None:
        self.levels: list[dict[int, int]] = [{}, {}, {}]
        self.total = 0

    def add(self, value: int, n: int) -> None:
        self.total += n
        for depth, level in enumerate(self.levels):
            block = value >> (8 * depth)
            level[block] = level.get(block, 0) + n
            if not level[block]:
                del level[block]

    def at(self, place: int) -> int:
        inside = None
        for depth in (2, 1, 0):
            level = self.levels[depth]
            blocks = sorted(level) if inside is None else [b for b in range(inside << 8, (inside + 1) << 8) if b in level]
            for block in blocks:
                if place < level[block]:
                    inside = block
                    break
                place -= level[block]
        return inside


def numbered(df: DataFrame, by: list[str], at: Column, ties: list[str], name: str = "number") -> DataFrame:
    """``df`` with the number, from 1, of each row of a key by a time ``at`` and ``ties``.

    Rows are counted by key and range of time first; a running sum over one row for
    each range tells where its numbers begin, and rows are sorted within a range
    only. So no key's rows meet in one task.
    """
    ranged = df.withColumn("_range", at)
    counts = stored(ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")), "counts")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), before.alias("_before"))
    same = F.lit(True)
    for left, right in [*((c, f"_by_{c}") for c in by), ("_range", "_at")]:
        same = same & F.col(left).eqNullSafe(F.col(right))
    place = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*ties))
    return ranged.join(starts, same).withColumn(name, F.col("_before") + place).select(*df.columns, name)


def at_shares(df: DataFrame, by: list[str], value: str, at: Column, shares: dict[str, float]) -> DataFrame:
    """For each key the values at the whole index of each share of its sorted rows, as columns.

    ``at`` is a coarse, ascending function of the value, by whose ranges rows are sorted apart.
    """
    rows = numbered(df.filter(F.col(value).isNotNull()).select(*by, value), by, at, [value], "_number")
    counts = rows.groupBy(*by).agg(F.count("*").alias("_count"))
    found = rows.join(counts, by)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_number") == F.floor(F.col("_count") * share) + 1, F.col(value))).alias(name) for name, share in shares.items()))


def legs(points: DataFrame, by: list[str], order: list[str], most_kmh: float = 200.0) -> DataFrame:
    """Seconds, kilometres and speed from the point before; implausible by the unrounded speed."""
    w = W.partitionBy(*by).orderBy(*order)
    seconds = (micros("ts") - F.lag(micros("ts")).over(w)) / 1e6
    km = geo.haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    out = points.withColumn("_s", seconds).withColumn("_km", km).withColumn("_v", F.when(F.col("_s") > 0, F.col("_km") / (F.col("_s") / 3600)))
    return out.withColumns({"seconds": F.round("_s", 1), "km": F.round("_km", 3), "kmh": F.round("_v", 1), "implausible": F.coalesce(F.col("_v") > most_kmh, F.lit(False))}).drop("_s", "_km", "_v")


def throttled(df: DataFrame, by: list[str], cooldown_us: int) -> DataFrame:
    """The rows (ts, id) that fire: those at least ``cooldown_us`` after the last that fired."""
    return anchored(df, by, cooldown_us, False).filter("first").select(*by, F.timestamp_micros("us").alias("ts"), "id")


def bursts(df: DataFrame, by: list[str], within_us: int, least: int) -> DataFrame:
    """Rows at which ``least`` or more rows of their key lie within the time up to them."""
    w = W.partitionBy(*by).orderBy(micros("ts")).rangeBetween(-within_us, 0)
    return df.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least)


def streaks(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of consecutive rows with the flag: first and last time and length."""
    w = W.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_f", flag).withColumn("_change", F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("_f")
    return runs.groupBy(*by, "_run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("_run")


def average_precision(df: DataFrame, by: list[str], score: str, hit: str, labels: int | Column, steps: int = 1024) -> DataFrame:
    """Area under the monotone precision envelope of predictions by falling score (0 to 1).

    Scores are cut into ``steps`` ranges. Counts of the ranges above and the best
    precision in the ranges below are running values over one row for each range;
    what a row needs besides comes from its own range, so that a key's rows are
    never sorted in one task.
    """
    ranged = df.withColumn("_range", F.floor(F.col(score) * steps))
    whole = stored(ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.count_if(hit).alias("_tp")), "ranges")
    above = W.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    whole = stored(whole.select(*by, "_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_n", "_tp"))), "above")
    here = W.partitionBy(*by, "_range")
    down = here.orderBy(F.desc(score), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranged.join(whole, [*by, "_range"]).withColumn("_rank", F.count("*").over(down) + F.col("_n_above"))
    ranked = ranked.withColumn("_tp", F.sum(F.col(hit).cast("int")).over(down) + F.col("_tp_above")).withColumn("_precision", F.col("_tp") / F.col("_rank"))
    up = here.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = stored(ranked.select(*by, "_range", hit, "_tp", "_precision", F.max("_precision").over(up).alias("_best")), "ranked")
    below = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    best = ranked.groupBy(*by, "_range").agg(F.max("_precision").alias("_best_here"))
    best = stored(best.select(*by, "_range", F.max("_best_here").over(below).alias("_best_below")), "best")
    envelope = F.greatest("_best", "_best_below")
    total = labels if isinstance(labels, Column) else F.lit(labels)
    return ranked.join(best, [*by, "_range"]).groupBy(*by).agg((F.sum(F.when(F.col(hit), envelope).otherwise(0.0)) / F.first(total)).alias("ap"), F.max("_tp").alias("hits"), F.count("*").alias("predictions"))
