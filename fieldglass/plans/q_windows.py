"""Queries over time: sessions, routes, discontinuities, bursts, streaks and moving baselines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import plates
from fieldglass.operators import access, paging, windows
from fieldglass.plans import views
from fieldglass.plans.q_fields import duck_distance, duck_km
from fieldglass.plans.views import sql, table

HOUR = 3600 * 1_000_000


def _clock(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _vehicle_rows(spark, sf_dir):
    """Detections of vehicles with their readings; every 29th track has no number."""
    d = views.detections(spark, sf_dir).filter("class_name <> 'person'")
    read = views.sightings(spark, sf_dir).select(F.col("sighting_id").alias("detection_id"), "plate", F.col("confidence").alias("plate_confidence"))
    tracked = F.when(F.col("track_id") % 29 != 0, F.col("track_id"))
    return d.withColumn("track_id", tracked).join(read, "detection_id", "left")


def _vehicles(spark, sf_dir):
    """Vehicles as sessions of a track at a device."""
    s = windows.sessions(_vehicle_rows(spark, sf_dir).filter("track_id is not null"), ["camera_id", "track_id"], ["ts", "detection_id"], 12 * HOUR)
    first = lambda c: F.struct(c, (-F.unix_micros("ts")).alias("t"), (-F.col("detection_id")).alias("i"))
    out = s.groupBy("camera_id", "track_id", "session").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("frames"), F.max("width_px").alias("width"), F.max_by("class_name", first("confidence")).alias("class_name"),
        F.max_by("plate", F.when(F.col("plate").isNotNull(), first("plate_confidence"))).alias("plate"), F.max("plate_confidence").alias("plate_confidence"), F.bool_or(F.when(F.col("plate").isNotNull(), F.col("confidence") > 0.9)).alias("confirmed"),
    )
    near = F.col("width") >= 96
    return out.withColumns({"near": near, "reason": F.when(F.col("plate").isNull(), F.when(near, "plate not readable").otherwise("too far to read"))})


def vehicles_seen(spark, sf_dir):
    """vehicles with class, width, nearness, frames and their best plate, or why they have none."""
    return _clock(_vehicles(spark, sf_dir).withColumn("plate_confidence", F.round("plate_confidence", 6)), "first_seen", "last_seen")


SESSIONS = """SELECT *, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id ORDER BY ts, detection_id) AS session FROM
    (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY camera_id, track_id ORDER BY ts, detection_id) AS gap FROM (SELECT d.*, s.plate, s.confidence AS pc FROM det d LEFT JOIN sighting s ON s.sighting_id = d.detection_id) WHERE class_name <> 'person' AND track_id % 29 <> 0)"""
VEHICLES = """SELECT camera_id, track_id, session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS frames, max(width_px) AS width, arg_max(class_name, row(confidence, -epoch_us(ts), -detection_id)) AS class_name,
    arg_max(plate, row(pc, -epoch_us(ts), -detection_id)) FILTER (plate IS NOT NULL) AS plate, max(pc) AS plate_confidence, bool_or(confidence > 0.9) FILTER (plate IS NOT NULL) AS confirmed, max(width_px) >= 96 AS near,
    CASE WHEN count(plate) = 0 THEN CASE WHEN max(width_px) >= 96 THEN 'plate not readable' ELSE 'too far to read' END END AS reason FROM sess GROUP BY camera_id, track_id, session"""
VEHICLES_SEEN = sql("SELECT * REPLACE (round(plate_confidence, 6) AS plate_confidence) FROM vehicle", sess=SESSIONS, vehicle=VEHICLES)


def vehicle_list(spark, sf_dir):
    """the vehicles of a list, those with a plate first, then the last seen."""
    v = _vehicles(spark, sf_dir).orderBy(F.col("plate").isNull(), F.desc("last_seen"), "camera_id", "track_id").limit(300)
    return _clock(v.select("camera_id", "track_id", "session", "plate", "last_seen"), "last_seen")


VEHICLE_LIST = sql("SELECT camera_id, track_id, session, plate, last_seen FROM vehicle ORDER BY plate IS NULL, last_seen DESC, camera_id, track_id LIMIT 300", sess=SESSIONS, vehicle=VEHICLES)


def vehicles_totals(spark, sf_dir):
    """vehicles by device, those near and those with a plate, their share, and frames without a track."""
    near, plated = F.count_if("near"), F.count("plate")
    share = F.round(F.col("identified") / F.nullif(F.col("near"), F.lit(0)), 3)
    out = _vehicles(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("vehicles"), near.alias("near"), plated.alias("identified")).withColumn("share", share)
    loose = _vehicle_rows(spark, sf_dir).groupBy("camera_id").agg(F.count_if(F.col("track_id").isNull()).alias("untracked"))
    return out.join(loose, "camera_id", "full")


VEHICLES_TOTALS = sql(
    """SELECT camera_id, vehicles, near, identified, round(identified / CAST(nullif(near, 0) AS DOUBLE), 3) AS share, untracked FROM (SELECT camera_id, count(*) AS vehicles, count(*) FILTER (near) AS near, count(plate) AS identified FROM vehicle GROUP BY camera_id)
    FULL JOIN (SELECT camera_id, count(*) FILTER (track_id % 29 = 0) AS untracked FROM det WHERE class_name <> 'person' GROUP BY camera_id) USING (camera_id)""",
    sess=SESSIONS, vehicle=VEHICLES,
)


def _passes(spark, sf_dir):
    s = views.sightings(spark, sf_dir).withColumnRenamed("sighting_id", "id")
    return windows.same_pass(s, ["track_id", "camera_id"], 6 * HOUR)


def passes(spark, sf_dir):
    """readings folded into passes anchored at their first reading."""
    out = _passes(spark, sf_dir).select("track_id", "camera_id", "ts", F.col("id").alias("first_id"), "plate", F.round("confidence", 6).alias("confidence"), "observations", "folded")
    return _clock(out, "ts")


PASS = """SELECT track_id, camera_id, id AS first_id, anchor, plate, confidence, observations, folded FROM walk WHERE is_last"""
WALK = """SELECT r.track_id, r.camera_id, r.k, r.sighting_id AS id, epoch_us(r.ts) AS anchor, r.plate, r.confidence, CAST(r.observations AS BIGINT) AS observations, CAST(1 AS BIGINT) AS folded FROM numbered r WHERE k = 1
    UNION ALL SELECT r.track_id, r.camera_id, r.k, CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 THEN w.id ELSE r.sighting_id END, CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 THEN w.anchor ELSE epoch_us(r.ts) END,
    CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 AND r.confidence <= w.confidence THEN w.plate ELSE r.plate END,
    CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 THEN greatest(r.confidence, w.confidence) ELSE r.confidence END,
    CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 THEN w.observations + r.observations ELSE CAST(r.observations AS BIGINT) END,
    CASE WHEN epoch_us(r.ts) - w.anchor <= 21600000000 THEN w.folded + 1 ELSE 1 END FROM walk w JOIN numbered r ON r.track_id = w.track_id AND r.camera_id = w.camera_id AND r.k = w.k + 1"""
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY track_id, camera_id ORDER BY ts, sighting_id) AS k FROM sighting"
LASTS = "SELECT track_id, camera_id, id AS first_id, make_timestamp(anchor) AS ts, arg_max(plate, folded) AS plate, max(confidence) AS confidence, max(observations) AS observations, max(folded) AS folded FROM walk GROUP BY ALL"
PASSES = sql("SELECT track_id, camera_id, first_id, ts, plate, round(confidence, 6) AS confidence, observations, folded FROM passes", numbered=NUMBERED, walk=WALK, passes=LASTS)


def _route(spark, sf_dir, first: int | None = None):
    """The route of one plate; of ``first`` readings only the earliest so many are looked at, before plates are compared."""
    access.with_reason("case 12: theft reported")
    s = access.readable(views.sightings(spark, sf_dir), views.cameras(spark, sf_dir), access.Caller()).withColumn("camera_id", F.col("sighting_id") % 100)
    if first is not None:
        s = s.orderBy("ts", "sighting_id").limit(first)
    mine = s.filter(plates.distance_within(F.col("plate"), F.lit("GJ08HX1259")).isNotNull()).withColumnRenamed("sighting_id", "id").withColumn("trace", F.lit("GJ08HX1259"))
    cams = views.cameras(spark, sf_dir).select("camera_id", "latitude", "longitude")
    found = windows.same_pass(mine, ["trace", "camera_id"], 6 * HOUR).join(cams, "camera_id").orderBy("ts", "id").limit(500)
    out = windows.legs(found, ["trace"], ["ts", "id"])
    return _clock(out.select("id", "camera_id", "ts", "seconds", "km", "kmh", "implausible"), "ts")


def route(spark, sf_dir):
    """The route of one plate: scope first, matching readings, passes, legs and their sum."""
    return _route(spark, sf_dir)


def route_of_first(spark, sf_dir):
    """the route of one plate among the 300 earliest readings in scope: the limit comes before the plates are compared."""
    return _route(spark, sf_dir, 300)


ROUTE = sql(
    f"""SELECT id, camera_id, ts, round(s, 1) AS seconds, round(km, 3) AS km, round(CASE WHEN s > 0 THEN km / (s / 3600) END, 1) AS kmh, coalesce(CASE WHEN s > 0 THEN km / (s / 3600) END > 200, false) AS implausible FROM (SELECT b.id, b.camera_id, b.ts, (epoch_us(b.ts) - epoch_us(a.ts)) / CAST(1000000 AS DOUBLE) AS s, {duck_km("a", "b")} AS km
    FROM p b LEFT JOIN p a ON a.n = b.n - 1)""",
    mine=f"SELECT sighting_id, sighting_id % 100 AS camera_id, ts, plate, row_number() OVER (PARTITION BY sighting_id % 100 ORDER BY ts, sighting_id) AS k FROM sighting WHERE {duck_distance('plate', chr(39) + 'GJ08HX1259' + chr(39))} <= 1.0 AND camera_id IN (SELECT camera_id FROM cam)",
    steps="""SELECT camera_id, k, sighting_id AS id, ts AS anchor FROM mine WHERE k = 1 UNION ALL SELECT m.camera_id, m.k, CASE WHEN epoch_us(m.ts) - epoch_us(s.anchor) <= 21600000000 THEN s.id ELSE m.sighting_id END,
    CASE WHEN epoch_us(m.ts) - epoch_us(s.anchor) <= 21600000000 THEN s.anchor ELSE m.ts END FROM steps s JOIN mine m ON m.camera_id = s.camera_id AND m.k = s.k + 1""",
    p="SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM (SELECT DISTINCT id, camera_id, anchor AS ts FROM steps) JOIN cam USING (camera_id) ORDER BY ts, id LIMIT 500",
)


ROUTE_OF_FIRST = ROUTE.replace("AS k FROM sighting WHERE", "AS k FROM (SELECT * FROM sighting WHERE camera_id IN (SELECT camera_id FROM cam) ORDER BY ts, sighting_id LIMIT 300) WHERE")


def clock_cuts(spark, sf_dir):
    """Segments of a device's media clock, cut at loops, and the rate in each."""
    d = views.detections(spark, sf_dir).select("camera_id", "detection_id", ((F.col("detection_id") * 40) % 7000 + F.col("width_px")).alias("pts"))
    w = W.partitionBy("camera_id").orderBy("detection_id")
    delta = F.col("pts") - F.lag("pts").over(w)
    cut = d.withColumn("delta", delta).withColumn("cut", F.when((F.col("delta") < 0) & ((-F.col("delta") > 2000) | (F.col("pts") < 300)), 1).otherwise(0))
    seg = cut.withColumn("segment", F.sum("cut").over(w))
    return seg.groupBy("camera_id", "segment").agg(F.count("*").alias("frames"), F.round((F.count("*") - 1) * 1000 / F.nullif(F.max("pts") - F.min("pts"), F.lit(0)), 3).alias("fps"))


CLOCK_CUTS = sql("""SELECT camera_id, segment, count(*) AS frames, round((count(*) - 1) * 1000 / CAST(nullif(max(pts) - min(pts), 0) AS DOUBLE), 3) AS fps FROM (SELECT *, sum(CASE WHEN delta < 0 AND (-delta > 2000 OR pts < 300) THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY detection_id) AS segment
    FROM (SELECT *, pts - lag(pts) OVER (PARTITION BY camera_id ORDER BY detection_id) AS delta FROM (SELECT camera_id, detection_id, (detection_id * 40) % 7000 + width_px AS pts FROM det))) GROUP BY ALL""")


def speeds(spark, sf_dir):
    """speed over the last 12 samples of a track and its fall from the early to the late half."""
    d = views.detections(spark, sf_dir)
    w = W.partitionBy("track_id").orderBy("ts", "detection_id")
    x = F.col("width_px").cast("double")
    step = F.abs(x - F.lag(x).over(w))
    t = F.unix_micros("ts")
    win = w.rowsBetween(-10, 0)
    out = d.withColumn("step", step).withColumn("begun", F.lag(t).over(w))
    speed = F.sum("step").over(win) / ((t - F.min("begun").over(win)) / 3.6e9)
    out = out.withColumn("speed", speed).withColumn("late", F.avg("speed").over(w.rowsBetween(-5, 0))).withColumn("early", F.avg("speed").over(w.rowsBetween(-11, -6)))
    return out.select("detection_id", F.round("speed", 4).alias("speed"), F.round(F.col("early") - F.col("late"), 4).alias("slowing"))


SPEEDS = sql("""SELECT detection_id, round(speed, 4) AS speed, round(avg(speed) OVER (w ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) - avg(speed) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS slowing
    FROM (SELECT *, sum(step) OVER (w ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) / ((epoch_us(ts) - min(begun) OVER (w ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)) / CAST(3600000000 AS DOUBLE)) AS speed
    FROM (SELECT *, abs(CAST(width_px AS DOUBLE) - lag(width_px) OVER w) AS step, lag(epoch_us(ts)) OVER w AS begun FROM det WINDOW w AS (PARTITION BY track_id ORDER BY ts, detection_id)) WINDOW w AS (PARTITION BY track_id ORDER BY ts, detection_id)) WINDOW w AS (PARTITION BY track_id ORDER BY ts, detection_id)""")


def headings(spark, sf_dir):
    """heading, straightness, trust and sense (growth from the first to the last third) of the last 12 places of each track."""
    d = views.detections(spark, sf_dir).select("detection_id", "track_id", "ts", F.col("width_px").cast("double").alias("x"), ((F.col("detection_id") * 31) % 200).cast("double").alias("y"))
    w = W.partitionBy("track_id").orderBy("ts", "detection_id")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    d = d.withColumn("step", step)
    win = w.rowsBetween(-11, 0)
    dx, dy = F.col("x") - F.first("x").over(win), F.col("y") - F.first("y").over(win)
    path = F.sum("step").over(w.rowsBetween(-10, 0))
    out = d.withColumn("dx", dx).withColumn("dy", dy).withColumn("path", path).withColumn("widest", F.max("step").over(w.rowsBetween(-10, 0))).withColumn("n", F.count("*").over(win))
    out = out.withColumn("growth", F.avg("x").over(w.rowsBetween(-3, 0)) / F.nullif(F.avg("x").over(w.rowsBetween(-11, -8)), F.lit(0.0)))
    moved = F.hypot("dx", "dy")
    return out.filter("n = 12").select("detection_id", F.round(F.degrees(F.atan2("dy", "dx")), 3).alias("heading"), F.round(F.col("path") / F.nullif(moved, F.lit(0.0)), 3).alias("winding"), (F.col("widest") <= 150).alias("trusted"), F.when(F.col("growth") >= 1.12, "approaching").when(F.col("growth") <= 1 / 1.12, "receding").alias("sense"))


HEADINGS = sql("""SELECT detection_id, round(degrees(atan2(dy, dx)), 3) AS heading, round(path / nullif(sqrt(dx * dx + dy * dy), 0), 3) AS winding, widest <= 150 AS trusted, CASE WHEN growth >= 1.12 THEN 'approaching' WHEN growth <= 1 / CAST(1.12 AS DOUBLE) THEN 'receding' END AS sense FROM (SELECT detection_id, avg(x) OVER (PARTITION BY track_id ORDER BY ts, detection_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / nullif(avg(x) OVER (PARTITION BY track_id ORDER BY ts, detection_id ROWS BETWEEN 11 PRECEDING AND 8 PRECEDING), 0) AS growth, x - first_value(x) OVER v AS dx, y - first_value(y) OVER v AS dy, sum(step) OVER u AS path, max(step) OVER u AS widest, count(*) OVER v AS n
    FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM (SELECT detection_id, track_id, ts, CAST(width_px AS DOUBLE) AS x, CAST((detection_id * 31) % 200 AS DOUBLE) AS y FROM det) WINDOW w AS (PARTITION BY track_id ORDER BY ts, detection_id))
    WINDOW v AS (PARTITION BY track_id ORDER BY ts, detection_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), u AS (PARTITION BY track_id ORDER BY ts, detection_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)) WHERE n = 12""")


def crowd_baseline(spark, sf_dir):
    """the 90th percentile (by index) of a device's widths from a day to an hour before, of 20 or more."""
    found = windows.moving_rank(views.detections(spark, sf_dir), ["camera_id"], "width_px", 24 * HOUR, HOUR, 0.9, 20, node="detection_id")
    return found.select("detection_id", F.col("rank_value").cast("int").alias("baseline"))


CROWD_BASELINE = sql("""SELECT detection_id, past[CAST(floor(len(past) * 0.9) AS INT) + 1] AS baseline FROM (SELECT d.detection_id, list_sort(list(e.width_px)) AS past FROM det d JOIN det e ON e.camera_id = d.camera_id
    AND e.ts >= d.ts - INTERVAL 24 HOUR AND e.ts <= d.ts - INTERVAL 1 HOUR GROUP BY d.detection_id) WHERE len(past) >= 20""")


def cooldown(spark, sf_dir):
    """alerts of a track at least two days after its last that fired."""
    d = views.detections(spark, sf_dir).withColumnRenamed("detection_id", "id")
    return windows.throttled(d, ["track_id"], 48 * HOUR).select("track_id", "id")


COOLDOWN = sql(
    "SELECT track_id, id FROM fired",
    rows="SELECT track_id, detection_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY track_id ORDER BY ts, detection_id) AS k FROM det",
    chain="SELECT track_id, id, t, k, true AS fires FROM rows WHERE k = 1 UNION ALL SELECT r.track_id, r.id, CASE WHEN r.t - c.t >= 172800000000 THEN r.t ELSE c.t END, r.k, r.t - c.t >= 172800000000 FROM chain c JOIN rows r ON r.track_id = c.track_id AND r.k = c.k + 1",
    fired="SELECT track_id, id FROM chain WHERE fires",
)


def reader_runs(spark, sf_dir):
    """runs of readings of one plate with gaps of at most a day."""
    s = windows.sessions(views.sightings(spark, sf_dir), ["plate"], ["ts", "sighting_id"], 24 * HOUR, name="run")
    return s.groupBy("plate", "run").agg(F.count("*").alias("readings"), F.min("sighting_id").alias("least"))


READER_RUNS = sql("""SELECT plate, run, count(*) AS readings, min(sighting_id) AS least FROM (SELECT *, sum(CASE WHEN gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY ts, sighting_id) AS run
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY plate ORDER BY ts, sighting_id) AS gap FROM sighting)) GROUP BY ALL""")


def latest_health(spark, sf_dir):
    """F16: the latest frame of each device."""
    q = views.detections(spark, sf_dir).groupBy("camera_id").agg(F.max_by(F.struct("detection_id", "class_name"), F.struct("ts", "detection_id")).alias("m"))
    return q.select("camera_id", "m.detection_id", "m.class_name")


LATEST_HEALTH = sql("SELECT camera_id, detection_id, class_name FROM det QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, detection_id DESC) = 1")


def footage_bursts(spark, sf_dir):
    """Frames that are the third bad one of a kind within 24 hours, or a later one."""
    q = views.footage(spark, sf_dir)
    return _clock(windows.bursts(q, ["camera_id", "quality"], 24 * HOUR, 3).select("camera_id", "quality", "ts", "n"), "ts")


FOOTAGE_BURSTS = sql("""SELECT camera_id, quality, ts, n FROM (SELECT *, count(*) OVER (PARTITION BY camera_id, quality ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM quality) WHERE n >= 3""")


def health_streaks(spark, sf_dir):
    """Runs of two or more failed checks of a device; checks in an hour in which half of its source's failed or more are not the device's."""
    d = views.detections(spark, sf_dir).withColumns({"source": F.col("camera_id") % 3, "hour": F.date_trunc("hour", "ts")})
    checks = d.groupBy("source", "hour").agg(F.count("*").alias("checks"), F.count_if(F.col("confidence") < 0.1).alias("failed"))
    d = d.join(checks.filter("checks >= 2 and 2 * failed >= checks"), ["source", "hour"], "left_anti")
    runs = windows.streaks(d, ["camera_id"], ["ts", "detection_id"], F.col("confidence") < 0.1).filter("n >= 2")
    return _clock(runs, "first", "last")


HEALTH_STREAKS = sql("""SELECT camera_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN f = p THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id ORDER BY ts, detection_id) AS run FROM
    (SELECT *, confidence < 0.1 AS f, lag(confidence < 0.1) OVER (PARTITION BY camera_id ORDER BY ts, detection_id) AS p FROM det WHERE (camera_id % 3, date_trunc('hour', ts)) NOT IN (SELECT (camera_id % 3, date_trunc('hour', ts)) FROM det GROUP BY camera_id % 3, date_trunc('hour', ts) HAVING count(*) >= 2 AND 2 * count(*) FILTER (confidence < 0.1) >= count(*)))) WHERE f GROUP BY camera_id, run HAVING count(*) >= 2""")


def inactivity(spark, sf_dir):
    """Bad-frame spells of a device and kind, closed when none came for two days."""
    s = windows.sessions(views.footage(spark, sf_dir), ["camera_id", "quality"], ["ts"], 48 * HOUR, name="spell")
    out = s.groupBy("camera_id", "quality", "spell").agg(F.min("ts").alias("opened"), F.max("ts").alias("last"), F.count("*").alias("frames"))
    closed = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("last") > 48 * HOUR
    return _clock(out.withColumn("closed", closed), "opened", "last")


INACTIVITY = sql("""SELECT camera_id, quality, spell, min(ts) AS opened, max(ts) AS last, count(*) AS frames, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 172800000000 AS closed FROM (SELECT *, sum(CASE WHEN gap > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, quality ORDER BY ts) AS spell
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY camera_id, quality ORDER BY ts) AS gap FROM quality)) GROUP BY camera_id, quality, spell""")


def moving_baseline(spark, sf_dir):
    """The exponential mean (0.95, 0.05) of each device's confidence after its last frame of each day."""
    d = views.detections(spark, sf_dir).groupBy("camera_id", F.to_date("ts").alias("day")).agg(F.avg("confidence").alias("level"))
    rows = d.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("day", "level"))).alias("rows"))
    ema = F.aggregate("rows", F.lit(None).cast("double"), lambda m, r: F.when(m.isNull(), r["level"]).otherwise(m * 0.95 + r["level"] * 0.05))
    return rows.select("camera_id", F.round(ema, 6).alias("level"))


MOVING_BASELINE = sql(
    "SELECT camera_id, round(arg_max(m, k), 6) AS level FROM walk GROUP BY camera_id",
    days="SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY d) AS k, level FROM (SELECT camera_id, CAST(ts AS DATE) AS d, avg(confidence) AS level FROM det GROUP BY ALL)",
    walk="SELECT camera_id, k, level AS m FROM days WHERE k = 1 UNION ALL SELECT d.camera_id, d.k, w.m * CAST(0.95 AS DOUBLE) + d.level * CAST(0.05 AS DOUBLE) FROM walk w JOIN days d ON d.camera_id = w.camera_id AND d.k = w.k + 1",
)

def _frames(spark, sf_dir):
    """A frame for each detection: brightness, focus, clipped share and the strength of the coding grid."""
    i = F.col("detection_id")
    grid = F.when(i % 17 == 3, F.col("confidence") * 5).otherwise(1 + (F.col("detection_id") * 31 % 97) / F.lit(97.0) + (F.col("camera_id") % 3) * 0.35)
    return views.detections(spark, sf_dir).select(
        "detection_id", "camera_id", "ts", ((i * 37) % 256).cast("double").alias("luma"), ((i * 13) % 211).cast("double").alias("focus"), ((i * 7) % 100 / F.lit(100.0)).alias("clipped"), F.when(i % 29 != 0, grid).alias("grid")
    )


def frame_verdicts(spark, sf_dir):
    """The footage class of each frame; damage is judged by the level of the device's sound frames so far."""
    found = windows.damaged_frames(_frames(spark, sf_dir), ["camera_id"], ["ts", "detection_id"], ["clipped"])
    black = (F.col("luma") <= windows.BLACK_LUMA) & (F.col("focus") <= windows.BLACK_FOCUS)
    shown = F.when(black, "blackout").when(F.col("damaged"), "corrupted").when((F.col("luma") >= 235) | (F.col("clipped") >= 0.9), "overexposed").when(F.col("luma") <= 60, "low_light").when(F.col("focus") < 40, "blurred").otherwise("normal")
    return found.select("detection_id", shown.alias("quality"), F.round("level", 6).alias("level"))


FRAME_VERDICTS = sql(
    """SELECT detection_id, CASE WHEN black THEN 'blackout' WHEN bad THEN 'corrupted' WHEN luma >= 235 OR clipped >= 0.9 THEN 'overexposed' WHEN luma <= 60 THEN 'low_light' WHEN focus < 40 THEN 'blurred' ELSE 'normal' END AS quality, round(level, 6) AS level FROM walk""",
    frame="""SELECT detection_id, camera_id, luma, focus, clipped, grid, luma <= 8 AND focus <= 5 AS black, row_number() OVER (PARTITION BY camera_id ORDER BY ts, detection_id) AS k FROM (SELECT detection_id, camera_id, ts, CAST((detection_id * 37) % 256 AS DOUBLE) AS luma, CAST((detection_id * 13) % 211 AS DOUBLE) AS focus,
      (detection_id * 7) % 100 / CAST(100 AS DOUBLE) AS clipped, CASE WHEN detection_id % 29 <> 0 THEN CASE WHEN detection_id % 17 = 3 THEN confidence * 5 ELSE 1 + (detection_id * 31 % 97) / CAST(97 AS DOUBLE) + (camera_id % 3) * CAST(0.35 AS DOUBLE) END END AS grid FROM det)""",
    walk="""SELECT detection_id, camera_id, k, luma, focus, clipped, black, NOT black AND coalesce(grid >= 3, false) AS bad, CAST(NULL AS DOUBLE) AS level, CASE WHEN NOT black AND grid < 3 THEN grid END AS next, CASE WHEN NOT black AND grid < 3 THEN 1 ELSE 0 END AS seen FROM frame WHERE k = 1
      UNION ALL SELECT detection_id, camera_id, k, luma, focus, clipped, black, bad, level, CASE WHEN black OR grid IS NULL OR bad THEN level WHEN level IS NULL THEN grid ELSE CAST(0.95 AS DOUBLE) * level + (1 - CAST(0.95 AS DOUBLE)) * grid END, CASE WHEN black OR grid IS NULL OR bad THEN seen ELSE seen + 1 END FROM
      (SELECT f.detection_id, f.camera_id, f.k, f.luma, f.focus, f.clipped, f.grid, f.black, w.next AS level, w.seen, NOT f.black AND coalesce(f.grid >= CASE WHEN w.seen < 20 THEN 3 ELSE greatest(1.8, CAST(1.4 AS DOUBLE) * w.next) END, false) AS bad FROM walk w JOIN frame f ON f.camera_id = w.camera_id AND f.k = w.k + 1)""",
)

QUERIES = {
    "vehicles_seen": vehicles_seen, "vehicle_list": vehicle_list, "vehicles_totals": vehicles_totals, "passes": passes, "route": route, "route_of_first": route_of_first, "clock_cuts": clock_cuts, "speeds": speeds, "headings": headings,
    "crowd_baseline": crowd_baseline, "cooldown": cooldown, "reader_runs": reader_runs, "latest_health": latest_health, "footage_bursts": footage_bursts, "health_streaks": health_streaks,
    "inactivity": inactivity, "moving_baseline": moving_baseline, "frame_verdicts": frame_verdicts,
}
ORACLES = {
    "vehicles_seen": VEHICLES_SEEN, "vehicle_list": VEHICLE_LIST, "vehicles_totals": VEHICLES_TOTALS, "passes": PASSES, "route": ROUTE, "route_of_first": ROUTE_OF_FIRST, "clock_cuts": CLOCK_CUTS, "speeds": SPEEDS, "headings": HEADINGS,
    "crowd_baseline": CROWD_BASELINE, "cooldown": COOLDOWN, "reader_runs": READER_RUNS, "latest_health": LATEST_HEALTH, "footage_bursts": FOOTAGE_BURSTS, "health_streaks": HEALTH_STREAKS,
    "inactivity": INACTIVITY, "moving_baseline": MOVING_BASELINE, "frame_verdicts": FRAME_VERDICTS,
}
