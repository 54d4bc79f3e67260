"""Fragments of tracks that are one physical vehicle.

A tracker gives one vehicle several ids: a second box in the same frames (duplicate),
a new id for a vehicle that stands where one stood (parked), or a new id a moment later
and further along the way (continuation). Fragments are joined by their boxes alone.
Duplicates and parked ids are joined without more; continuations are joined strongest
first, each fragment with one next and one previous, and never within what is joined
already. So this is no plain union: which pairs count depends on the stronger ones.

Tracks belong to a device; ``boxes`` has camera_id, track_id, frame, x1, y1, x2, y2,
class_name and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators.components import components
from fieldglass.operators.tracks import duplicates
from fieldglass.store import job, stored

# Classes of two wheels; every other class has four.
TWO_WHEELED = ("motorcycle", "bicycle", "motorbike", "scooter")
# A track stands if this share of its centres is within this part of its size of the median one, from so many boxes on.
STILL_RADIUS, STILL_SHARE, STILL_BOXES = 0.25, 0.8, 3
# The best confidence below which a standing track is a box on nothing, and the overlap of one parked vehicle's boxes.
STILL_SCORE, PARKED_IOU = 0.65, 0.5
# The part of its size up to which a vehicle hasn't moved within a second.
MOVED_SHARE = 0.15
# How much smaller or larger a continuing box may be, how far from where it was due, and what a second of gap costs.
LEAST_RATIO, MOST_RATIO, MOST_DRIFT, GAP_COST = 0.4, 2.5, 0.6, 0.5
# Seconds that a moving and a parked vehicle may be lost, and frames that make a vehicle.
MOVING_GAP_S, PARKED_GAP_S, LEAST_BOXES = 2.0, 120.0, 3

KEY = ("camera_id", "track_id")


def _sides(box: str) -> list[Column]:
    return [F.col(f"{box}.{c}") for c in ("x1", "y1", "x2", "y2")]


def _area(box: str) -> Column:
    x1, y1, x2, y2 = _sides(box)
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def _size(box: str) -> Column:
    return F.sqrt(F.greatest(_area(box), F.lit(1.0)))


def _centre(box: str) -> tuple[Column, Column]:
    x1, y1, x2, y2 = _sides(box)
    return (x1 + x2) / 2, (y1 + y2) / 2


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def _apart(a: str, b: str) -> Column:
    (xa, ya), (xb, yb) = _centre(a), _centre(b)
    return _length(xb - xa, yb - ya)


def family(name: Column) -> Column:
    return F.when(name.isin(*TWO_WHEELED), "two-wheeler").otherwise("four-wheeler")


def described(boxes: DataFrame, fps: float) -> DataFrame:
    """One row a track: frames, family, best score, first, median and last box, whether it stands, and how it moves at its ends.

    Two passes over the boxes by track; no track's boxes are gathered.
    """
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    rows = boxes.select(*KEY, "frame", box.alias("box"), "class_name", "confidence")
    middle = F.struct(*(F.percentile(f"box.{c}", F.lit(0.5)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    at = F.struct("frame", "box")
    whole = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("z"), middle.alias("middle"), F.mode("class_name", True).alias("class_name"), F.max("confidence").alias("score")
    )
    rows = rows.join(whole.select(*KEY, "a", "z", "middle"), list(KEY))
    near = _apart("box", "middle") < STILL_RADIUS * _size("middle")
    ends = rows.groupBy(*KEY).agg(
        F.count_if(near).alias("near"),
        F.max(F.when(F.col("frame") - F.col("a.frame") <= fps, at)).alias("begun"),
        F.min(F.when(F.col("z.frame") - F.col("frame") <= fps, at)).alias("ending"),
    )
    t = whole.join(ends, list(KEY))
    took = F.col("z.frame") - F.col("ending.frame")
    speed = [F.when(took > 0, (z - e) / took).otherwise(0.0) for e, z in zip(_centre("ending.box"), _centre("z.box"), strict=True)]
    return t.select(
        *KEY, "n", F.col("a.frame").alias("first"), F.col("z.frame").alias("last"), family(F.col("class_name")).alias("family"), F.coalesce("score", F.lit(1.0)).alias("score"),
        F.col("a.box").alias("begin"), "middle", F.col("z.box").alias("end"), speed[0].alias("vx"), speed[1].alias("vy"),
        ((F.col("n") >= STILL_BOXES) & (F.col("near") >= STILL_SHARE * F.col("n"))).alias("standing"),
        (_apart("a.box", "begun.box") < MOVED_SHARE * _size("a.box")).alias("still_begin"),
        ((took == 0) | (_apart("ending.box", "z.box") < MOVED_SHARE * _size("z.box"))).alias("still_end"),
    )


def box_cells(box: str, around: int) -> Column:
    """The cells that a box covers in a grid of about its size, and in those of up to ``around`` steps larger or smaller.

    Boxes of which one half overlaps the other's differ by less than a step and share a cell.
    """
    x1, y1, x2, y2 = _sides(box)

    def covered(level: Column) -> Column:
        side = F.pow(F.lit(2.0), level)
        span = lambda lo, hi: F.sequence(F.floor(lo / side), F.floor(hi / side))
        return F.flatten(F.transform(span(x1, x2), lambda x: F.transform(span(y1, y2), lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))

    own = F.floor(F.log2(_size(box))).cast("int")
    return F.flatten(F.transform(F.sequence(own - around, own + around), covered))


def _node(side: str) -> Column:
    return F.struct(F.col(f"{side}.camera_id").alias("camera_id"), F.col(f"{side}.track_id").alias("track_id"))


def parked_pairs(tracks: DataFrame, most_gap: float) -> DataFrame:
    """Pairs of standing tracks of one family on one spot, at most ``most_gap`` frames apart.

    They meet by spot and by time, so a busy device's tracks don't all meet.
    """
    t = tracks.filter("standing").select("camera_id", "family", F.struct("track_id", "camera_id", "first", "last", "middle").alias("t"))
    times = F.explode(F.sequence(F.floor(F.col("t.first") / most_gap), F.floor((F.col("t.last") + most_gap) / most_gap))).alias("time")
    meet = ["camera_id", "family", "cell", "time"]
    a = t.select("*", F.explode(box_cells("t.middle", 0)).alias("cell")).select("camera_id", "family", "cell", times, F.col("t").alias("a"))
    b = t.select("*", F.explode(box_cells("t.middle", 1)).alias("cell")).select("camera_id", "family", "cell", times, F.col("t").alias("b"))
    gap = F.greatest("a.first", "b.first") - F.least("a.last", "b.last")
    same = (F.col("a.track_id") < F.col("b.track_id")) & (gap <= most_gap) & (geo.iou(_sides("a.middle"), _sides("b.middle")) >= PARKED_IOU)
    return a.join(b, meet).filter(same).select(_node("a").alias("a"), _node("b").alias("b")).distinct()


def continuation_pairs(tracks: DataFrame, fps: float, moving_gap: float, parked_gap: float) -> DataFrame:
    """Pairs (a may go on as b) with their cost; a parked vehicle's are judged by overlap, others by where they were due."""
    t = tracks.select("camera_id", "family", F.struct(*tracks.columns).alias("t"))
    gap = F.col("b.first") - F.col("a.last")
    stood = F.col("a.still_end") & F.col("b.still_begin") & (F.col("b.n") >= STILL_BOXES)
    bucket = lambda frame, width: F.floor(F.col(frame) / width)
    out = []
    for width, grids in ((moving_gap, False), (parked_gap, True)):
        a = t.select("camera_id", "family", F.col("t").alias("a"), F.explode(F.array(bucket("t.last", width), bucket("t.last", width) + 1)).alias("time"))
        b = t.select("camera_id", "family", F.col("t").alias("b"), bucket("t.first", width).alias("time"))
        meet = ["camera_id", "family", "time"]
        if grids:
            a, b = a.filter("a.still_end").withColumn("cell", F.explode(box_cells("a.end", 0))), b.filter("b.still_begin").withColumn("cell", F.explode(box_cells("b.begin", 1)))
            meet.append("cell")
        near = a.join(b, meet).filter((F.col("a.track_id") != F.col("b.track_id")) & (gap > 0) & (gap <= width))
        if grids:
            overlap = geo.iou(_sides("a.end"), _sides("b.begin"))
            near = near.filter(stood & (overlap >= PARKED_IOU)).withColumn("cost", 1 - overlap + gap / parked_gap)
        else:
            (xa, ya), (xb, yb) = _centre("a.end"), _centre("b.begin")
            drift = _length(xa + F.col("a.vx") * gap - xb, ya + F.col("a.vy") * gap - yb) / F.sqrt(F.greatest(_area("a.end"), _area("b.begin")))
            ratio = _area("b.begin") / F.greatest(_area("a.end"), F.lit(1e-9))
            near = near.filter(~(stood & (gap <= parked_gap)) & ratio.between(LEAST_RATIO, MOST_RATIO)).withColumn("drift", drift)
            near = near.filter(F.col("drift") <= MOST_DRIFT).withColumn("cost", F.col("drift") + GAP_COST * gap / moving_gap)
        out.append(near.select(_node("a").alias("a"), _node("b").alias("b"), "cost").distinct())
    return out[0].unionByName(out[1])


def strongest_first(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, cost) that are joined when they are tried by rising cost, then a, then b.

    A pair is joined if a has no next, b no previous, and they aren't joined already,
    by ``roots`` (node, root) or by the pairs before. Done in rounds: a pair that is the
    cheapest of all that touch either of its two groups doesn't depend on any other, so
    all such pairs are joined at once; groups are renamed, and what has become idle goes.
    """
    spark = pairs.sparkSession
    of = lambda side, name: roots.select(F.col("node").alias(side), F.col("root").alias(name))
    with job(spark, "strongest") as result:
        left = pairs.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select("a", "b", "cost", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        left, found = stored(left.filter(F.col("ra") != F.col("rb")), "left"), None
        while not left.isEmpty():
            pair = F.struct("cost", "a", "b")
            best = left.select(F.explode(F.array("ra", "rb")).alias("r"), pair.alias("p")).groupBy("r").agg(F.min("p").alias("p"))
            mine = left.withColumn("p", pair)
            for side in ("ra", "rb"):
                mine = mine.join(best.withColumnRenamed("r", side), [side, "p"], "left_semi")
            taken = stored(mine.select("a", "b", "ra", "rb"), "taken")
            found = taken if found is None else found.unionByName(taken)
            left = left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti")
            moved = taken.select(F.greatest("ra", "rb").alias("old"), F.least("ra", "rb").alias("new"))
            for side in ("ra", "rb"):
                left = left.join(moved.withColumnRenamed("old", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
            left = stored(left.filter(F.col("ra") != F.col("rb")).select("a", "b", "cost", "ra", "rb"), "left")
        return result((left if found is None else found).select("a", "b"))


def _alike(pairs: DataFrame, appearance: DataFrame | None, least: float, a: str, b: str) -> DataFrame:
    """The pairs whose histograms ``a`` and ``b`` are similar; a pair without one of them goes."""
    if appearance is None:
        return pairs
    of = lambda side, which: appearance.select(F.struct(*KEY).alias(side), F.col(which).alias(f"h{side}"))
    both = pairs.join(of("a", a), "a").join(of("b", b), "b")
    return both.filter(geo.histogram_similarity(F.col("ha"), F.col("hb")) >= least).select(*pairs.columns)


def link_fragments(
    boxes: DataFrame, fps: float = 25.0, same: DataFrame | None = None, appearance: DataFrame | None = None, least_alike: float = 0.0,
    least_score: float = STILL_SCORE, moving_gap_s: float = MOVING_GAP_S, parked_gap_s: float = PARKED_GAP_S, least_boxes: int = LEAST_BOXES,
) -> DataFrame:
    """camera_id, track_id and vehicle of every track: numbers from 1 by first appearance on the device.

    ``same`` holds pairs (camera_id, a, b) that are known to be one vehicle;
    ``appearance`` has histograms early, middle and late of tracks, and when given,
    boxes join only tracks that look alike. A track that stands and never reaches
    ``least_score``, and a vehicle of fewer than ``least_boxes`` boxes, get no number.
    """
    with job(boxes.sparkSession, "fragments") as result:
        every = stored(described(boxes, fps), "described")
        tracks = every.filter(~(F.col("standing") & (F.col("score") < least_score)))
        kept = boxes.join(tracks.select(*KEY), list(KEY), "left_semi")
        twice = duplicates(kept, ["camera_id", "frame"]).select(F.struct("camera_id", F.col("a").alias("track_id")).alias("a"), F.struct("camera_id", F.col("b").alias("track_id")).alias("b"))
        sure = _alike(twice.unionByName(parked_pairs(tracks, parked_gap_s * fps)), appearance, least_alike, "middle", "middle")
        if same is not None:
            known = same.select(F.struct("camera_id", F.col("a").alias("track_id")).alias("a"), F.struct("camera_id", F.col("b").alias("track_id")).alias("b"))
            there = tracks.select(F.struct(*KEY).alias("node"))
            known = known.join(there.withColumnRenamed("node", "a"), "a", "left_semi").join(there.withColumnRenamed("node", "b"), "b", "left_semi")
            sure = sure.unionByName(known)
        sure = stored(sure, "sure")
        roots = components(sure)
        next_ones = _alike(continuation_pairs(tracks, fps, moving_gap_s * fps, parked_gap_s * fps), appearance, least_alike, "late", "early")
        chosen = strongest_first(stored(next_ones, "pairs"), roots)
        whole = components(sure.unionByName(chosen))
        t = tracks.withColumn("node", F.struct(*KEY)).join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
        t = stored(t.select(*KEY, "n", "first", "root"), "rooted")
        per = t.groupBy("camera_id", "root").agg(F.sum("n").alias("total"), F.min("first").alias("first")).filter(F.col("total") >= least_boxes)
        number = F.row_number().over(W.partitionBy("camera_id").orderBy("first", "root"))  # one row a vehicle
        named = t.join(per.select("camera_id", "root", number.alias("vehicle")), ["camera_id", "root"]).select(*KEY, "vehicle")
        return result(every.select(*KEY).join(named, list(KEY), "left"))
