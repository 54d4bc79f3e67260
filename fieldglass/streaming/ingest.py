"""The same logic on streams: idempotent ingest, matching at arrival, windowed traffic, bursts with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldglass.operators.joins import fuzzy_join
from fieldglass.operators.tables import classified


def verdicts(stream: DataFrame, cameras: DataFrame, department: str | None, latest: Column, delay: str = "40 days") -> DataFrame:
    """Each new detection once, with the code of the first rule that it breaks (null: accepted).

    Replays are dropped by id as long as the watermark's ``delay`` keeps the id;
    late rows within it are accepted, times after ``latest`` aren't.
    """
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["detection_id"])
    known = cameras.select("camera_id", F.col("installation_status").alias("_status"), F.col("department").alias("_department"))
    outside = F.lit(False) if department is None else F.col("_department") != department
    rules = [("UNKNOWN_CAMERA", F.col("_status").isNull()), ("CAMERA_NOT_COMMISSIONED", F.col("_status") != "COMMISSIONED"), ("CAMERA_OUT_OF_SCOPE", outside), ("INVALID_TIMESTAMP", F.col("ts") > latest)]
    return classified(once.join(known, "camera_id", "left"), rules).drop("_status", "_department")


def traffic(stream: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Detections by device and tumbling window."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "camera_id").agg(F.count("*").alias("n")).select("camera_id", F.col("w.start").alias("start"), "n")


def alert_writer(watch: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that matches readings with the list as it is when they arrive.

    Each batch goes to a folder of its own, which a repeated batch replaces, so
    every alert is written once; what is listed later never matches older reads.
    """

    def write(batch: DataFrame, number: int) -> None:
        hits = fuzzy_join(batch.select("sighting_id", "camera_id", "plate"), watch().withColumnRenamed("plate", "watched"))
        hits.select("sighting_id", "camera_id", "plate", "watched", "category", "distance").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer with a folder for each batch, so that a repeated batch changes nothing."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


BURST = "camera_id bigint, quality string, raised timestamp, frames int"
BURST_STATE = "times array<bigint>, open boolean, last bigint"


def bursts(stream: DataFrame, within_us: int, least: int, clear_us: int, delay: str = "40 days") -> DataFrame:
    """An alert when ``least`` bad frames of a kind come within a time, none while one is open.

    An alert closes when no bad frame came for ``clear_us``. The state of a key is
    the times of its last ``least`` frames at most, and goes when the watermark has
    passed the time at which it would say nothing any more.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, is_open, last = state.get if state.exists else ([], False, 0)
        times, out = list(times), []
        for t in np.sort(np.concatenate([pdf["ts"].to_numpy("datetime64[us]").astype(np.int64) for pdf in parts])).tolist():
            if is_open and t - last > clear_us:
                is_open, times = False, []
            times = [x for x in [*times, t] if t - x <= within_us][-least:]
            if len(times) >= least and not is_open:
                is_open = True
                out.append((*key, pd.Timestamp(t * 1000), len(times)))
            last = t
        state.update((times, is_open, last))
        state.setTimeoutTimestamp(max((last + max(within_us, clear_us)) // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["camera_id", "quality", "raised", "frames"])

    return stream.withWatermark("ts", delay).groupBy("camera_id", "quality").applyInPandasWithState(step, BURST, BURST_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, writer: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that the source holds now and stop; progress is kept under ``path``."""
    stream.writeStream.foreachBatch(writer).outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()


HELD = "plate string, ids array<bigint>, flushed string"
HELD_STATE = "ids array<bigint>, last bigint"


def settled_plates(stream: DataFrame, quiet_us: int, most: int, delay: str = "40 days") -> DataFrame:
    """Readings (plate, sighting_id, ts) in groups that are ready to go: a plate's readings once none came for ``quiet_us``, or ``most`` of them.

    A full group goes at once, so an alert that hangs on a busy plate isn't held
    back; the state of a plate is at most ``most`` ids, and goes with its last group.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, last = state.get if state.exists else ([], 0)
        ids, out = list(ids), []
        if state.hasTimedOut:
            state.remove()
            if ids:
                yield pd.DataFrame([(key[0], ids, "settled")], columns=["plate", "ids", "flushed"])
            return
        rows = pd.concat([pdf[["ts", "sighting_id"]] for pdf in parts]).sort_values(["ts", "sighting_id"])
        for t, i in zip(rows["ts"].to_numpy("datetime64[us]").astype(np.int64).tolist(), rows["sighting_id"].tolist(), strict=True):
            if ids and t - last > quiet_us:
                out.append((key[0], ids, "settled"))
                ids = []
            ids, last = [*ids, i], max(last, t)
            if len(ids) >= most:
                out.append((key[0], ids, "full"))
                ids = []
        state.update((ids, last))
        state.setTimeoutTimestamp(max((last + quiet_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["plate", "ids", "flushed"])

    return stream.withWatermark("ts", delay).groupBy("plate").applyInPandasWithState(step, HELD, HELD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def mirrored(main: Callable[[DataFrame, int], None], copy: Callable[[DataFrame, int], None], failed: list | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer whose second sink may fail without holding up the first; what it missed is mended by :func:`repair`."""

    def write(batch: DataFrame, number: int) -> None:
        main(batch, number)
        try:
            copy(batch, number)
        except Exception as e:  # noqa: BLE001  any failure of the copy is let pass
            if failed is not None:
                failed.append((number, str(e)))

    return write


def batches(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the batches that :func:`appended` has written completely below ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) if files.exists(root) else None
    return {int(s.getPath().getParent().getName().removeprefix("batch=")) for s in done or ()}


def repair(spark: SparkSession, main: str, copy_path: str, copy: Callable[[DataFrame, int], None]) -> list[int]:
    """Copy the batches that ``main`` has and ``copy_path`` lacks; returns their numbers. Repeating it changes nothing."""
    missing = sorted(batches(spark, main) - batches(spark, copy_path))
    for number in missing:
        copy(spark.read.parquet(f"{main}/batch={number}"), number)
    return missing


def sweep(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None]) -> DataFrame:
    """Poll every source and hand what it gives to the sink; a source that fails is reported and stops no other.

    One row for each source: source, rows and error (null: none). There are few
    sources, and each poll is a job of its own.
    """
    out = []
    for name, poll in sources.items():
        try:
            found = poll()
            sink(name, found)
            out.append((name, found.count(), None))
        except Exception as e:  # noqa: BLE001  one bad source must not stop the sweep
            out.append((name, 0, type(e).__name__))
    return spark.createDataFrame(out, "source string, rows bigint, error string")
