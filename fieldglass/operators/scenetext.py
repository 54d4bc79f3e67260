"""Text that belongs to the scene: the same picture on the same spot behind different vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators.windows import numbered
from fieldglass.store import job, stored

# Overlap of boxes on one spot, and of the boxes of one vehicle; likeness of pictures; frames between two vehicles; least box.
SPOT_IOU, VEHICLE_IOU, ALIKE, APART_FRAMES, LEAST_WIDTH, LEAST_HEIGHT = 0.6, 0.7, 0.85, 30, 20.0, 8.0
#: Boxes of a device before it that a box is compared with.
HISTORY = 400


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def with_unit(df: DataFrame, picture: str = "picture", name: str = "unit") -> DataFrame:
    """``df`` with the picture centred and brought to length 1: the correlation of two pictures is then :func:`alike`; null if it is flat."""
    df = df.withColumn(name, F.col(picture).cast("array<double>")).withColumn("_mean", _sum(F.col(name)) / F.size(name))
    df = df.withColumn(name, F.transform(name, lambda v: v - F.col("_mean"))).withColumn("_mean", F.sqrt(_sum(F.transform(name, lambda v: v * v))))
    return df.withColumn(name, F.when(F.col("_mean") > 0, F.transform(name, lambda v: v / F.col("_mean")))).drop("_mean")


def alike(a: Column, b: Column) -> Column:
    """Correlation of two pictures of one size, from their unit arrays."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def static_text(boxes: DataFrame, history: int = HISTORY) -> DataFrame:
    """camera_id and id of the boxes (id, camera_id, frame, track_id, x1, y1, x2, y2, v1, w1, v2, w2, picture) that show text of the scene.

    A box is a sign if one of the ``history`` boxes before it on its device is on the
    same spot with the same picture, but of another track, another vehicle (v1, w1,
    v2, w2) and APART_FRAMES or more away. What is on the spot of a sign with its
    picture, up to ``history`` boxes before or after it, is text of the scene too,
    whatever its vehicle. Boxes are numbered by frame and id and meet by number, so a
    box meets a bounded number of others, and it is sent with its picture once and to
    two or three ranges of numbers, however many cells it covers. Boxes below the
    least size are never compared.
    """
    box = lambda n: [F.col(f"{n}.{c}") for c in ("x1", "y1", "x2", "y2")]
    vehicle = lambda n: [F.col(f"{n}.{c}") for c in ("v1", "w1", "v2", "w2")]
    near = (geo.iou(box("a"), box("b")) >= SPOT_IOU) & (alike(F.col("a.unit"), F.col("b.unit")) >= ALIKE)
    with job(boxes.sparkSession, "static-text") as result:
        large = boxes.filter((F.col("x2") - F.col("x1") >= LEAST_WIDTH) & (F.col("y2") - F.col("y1") >= LEAST_HEIGHT))
        large = stored(with_unit(large).drop("picture"), "units")
        rows = stored(numbered(large, ["camera_id"], F.floor(F.col("frame") / 1000), ["frame", "id"]), "numbered").select("camera_id", F.struct("*").alias("t"))
        bucket = F.floor(F.col("t.number") / history)

        def met(left: DataFrame, ranges: tuple[int, ...]) -> DataFrame:
            a = left.select("camera_id", F.col("t").alias("a"), F.explode(F.array(*(bucket + i for i in ranges))).alias("bucket"))
            b = rows.select("camera_id", F.col("t").alias("b"), bucket.alias("bucket"))
            return a.join(b, ["camera_id", "bucket"]).filter(F.abs(F.col("a.number") - F.col("b.number")) <= history)

        other = (F.col("a.track_id") != F.col("b.track_id")) & (geo.iou(vehicle("a"), vehicle("b")) < VEHICLE_IOU) & (F.abs(F.col("a.frame") - F.col("b.frame")) >= APART_FRAMES)
        signs = met(rows, (-1, 0)).filter((F.col("b.number") < F.col("a.number")) & other & near)
        signs = stored(signs.groupBy("camera_id", F.col("a.number").alias("number")).agg(F.first("a").alias("t")).select("camera_id", "t"), "signs")
        return result(met(signs, (-1, 0, 1)).filter(near).select("camera_id", F.col("b.id").alias("id")).distinct())
