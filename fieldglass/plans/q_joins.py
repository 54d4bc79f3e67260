"""Queries of joins: lookups, fuzzy, band, interval, nearest, guards and subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geo, plates
from fieldglass.operators import access, joins, paging
from fieldglass.plans import views
from fieldglass.plans.q_fields import duck_distance, duck_km
from fieldglass.plans.views import sql, table
from fieldglass.store import job, new_path, stored


def _clock(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def scoped_detections(spark, sf_dir):
    """Detections of readable devices with the devices' fields."""
    cams = views.cameras(spark, sf_dir)
    mine = access.readable(views.detections(spark, sf_dir), cams, access.Caller(department="EUROPE"))
    return mine.join(cams.select("camera_id", "name", "district"), "camera_id", "left").groupBy("camera_id", "name", "district").agg(F.count("*").alias("n"))


SCOPED_DETECTIONS = sql("SELECT camera_id, name, district, count(*) AS n FROM det JOIN cam USING (camera_id) WHERE department = 'EUROPE' GROUP BY ALL")


def watch_hits(spark, sf_dir):
    """D3: every reading and listed plate within the distance, all hits kept."""
    s = views.sightings(spark, sf_dir).select("sighting_id", "plate")
    w = views.watch_list(spark, sf_dir).withColumnRenamed("plate", "watched")
    hits = joins.fuzzy_join(s, w)
    return hits.select("sighting_id", "plate", "watched", "category", F.round("distance", 6).alias("distance"), (F.col("distance") == 0).alias("exact"))


WATCH_HITS = sql(
    """SELECT sighting_id, s.plate, watched, category, round(d, 6) AS distance, d = 0 AS exact FROM sighting s JOIN pairs USING (plate)""",
    pairs=f"SELECT * FROM (SELECT s.plate, w.plate AS watched, w.category, {duck_distance('s.plate', 'w.plate')} AS d FROM (SELECT DISTINCT plate FROM sighting) s, watch w WHERE abs(length(s.plate) - length(w.plate)) <= 2 AND levenshtein(s.plate, w.plate) <= 2) WHERE d <= 1.0",
)


def cross_camera(spark, sf_dir):
    """Readings within twelve hours and the distance, and whether no vehicle could be so fast between their devices."""
    cams = views.cameras(spark, sf_dir).select("camera_id", "latitude", "longitude")
    s = views.sightings(spark, sf_dir).select("sighting_id", (F.col("sighting_id") % 100).alias("camera_id"), "ts", "plate").join(cams, "camera_id")
    near = stored(joins.plate_pairs(s, s.select(F.col("plate").alias("watched"))), "near")
    pairs = joins.band_join(s.join(near, "plate"), s, 12 * 3600, on=[("watched", "plate")]).filter(F.col("l.sighting_id") != F.col("r.sighting_id"))
    km = geo.haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    speed = F.when(F.col("dt") > 0, km / (F.col("dt") / 3600))
    other = F.col("l.camera_id") != F.col("r.camera_id")
    return pairs.select(F.col("l.sighting_id").alias("a"), F.col("r.sighting_id").alias("b"), F.round("l.distance", 6).alias("distance"), other.alias("other_device"), (other & F.coalesce(speed > 200, F.lit(True))).alias("impossible"))


CROSS_CAMERA = sql(
    f"""SELECT a, b, round(d, 6) AS distance, other AS other_device, other AND coalesce(km / (dt / 3600) > 200, true) AS impossible FROM (SELECT l.camera_id <> r.camera_id AS other, l.sighting_id AS a, r.sighting_id AS b, {duck_distance("l.plate", "r.plate")} AS d, {duck_km("l", "r")} AS km,
    nullif((epoch_us(r.ts) - epoch_us(l.ts)) / CAST(1000000 AS DOUBLE), 0) AS dt
    FROM s l JOIN s r ON l.sighting_id <> r.sighting_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 12 HOUR AND levenshtein(l.plate, r.plate) <= 2) WHERE d <= 1.0""",
    s="SELECT sighting_id, ts, plate, c.camera_id, latitude, longitude FROM sighting x JOIN cam c ON c.camera_id = x.sighting_id % 100",
)


def event_correlation(spark, sf_dir):
    """Events of two devices within 180 s and 300 km, and whether they are of two departments."""
    cams = views.cameras(spark, sf_dir).select("camera_id", "department", "latitude", "longitude")
    d = views.detections(spark, sf_dir).select("detection_id", "camera_id", "ts")
    # devices stand still, so what holds of two of them is found once, and events meet those of devices that are near
    cams = cams.join(d.select("camera_id").distinct(), "camera_id", "left_semi")
    km = geo.haversine_km(F.col("p.latitude"), F.col("p.longitude"), F.col("q.latitude"), F.col("q.longitude"))
    near = cams.alias("p").join(cams.alias("q"), (F.col("p.camera_id") != F.col("q.camera_id")) & (km <= 300.0))
    near = stored(near.select(F.col("p.camera_id").alias("camera_id"), F.col("q.camera_id").alias("other"), F.round(km, 3).alias("km"), (F.col("p.department") != F.col("q.department")).alias("cross_department")), "near-devices")
    pairs = joins.band_join(d.join(near, "camera_id").drop("camera_id"), d, 180, on=[("other", "camera_id")])
    return pairs.select(F.col("l.detection_id").alias("a"), F.col("r.detection_id").alias("b"), F.col("l.km").alias("km"), (F.floor(F.col("dt") * 1000 + 0.5) / 1000).alias("dt"), F.col("l.cross_department").alias("cross_department"))


EVENT_CORRELATION = sql(
    f"""SELECT a, b, round(km, 3) AS km, round(dt, 3) AS dt, cross_department FROM (SELECT l.detection_id AS a, r.detection_id AS b, {duck_km("l", "r")} AS km, (epoch_us(r.ts) - epoch_us(l.ts)) / CAST(1000000 AS DOUBLE) AS dt, l.department <> r.department AS cross_department
    FROM d l JOIN d r ON l.camera_id <> r.camera_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 180 SECOND) WHERE km <= 300""",
    d="SELECT detection_id, det.camera_id, ts, department, latitude, longitude FROM det JOIN cam USING (camera_id)",
)


def incident_plates(spark, sf_dir):
    """The best reading of each incident's tracks from two days before it to five days after."""
    inc = views.detections(spark, sf_dir).filter("class_name = 'person'").select(F.col("detection_id").alias("incident_id"), "camera_id", F.col("ts").alias("seen"), F.array(F.col("track_id"), (F.col("track_id") + 10) % 150).alias("track_ids"))
    s = views.sightings(spark, sf_dir)
    # from two days before to five days after: a band of seven days that begins two days early, in buckets of that width
    early = inc.withColumn("track_id", F.explode("track_ids")).withColumn("ts", F.timestamp_micros(F.unix_micros("seen") - 2 * 86400 * 1000000))
    inside = joins.band_join(early, s, 7 * 86400, on=[("camera_id", "camera_id"), ("track_id", "track_id")]).select("l.incident_id", "r.confidence", "r.sighting_id")
    return inside.groupBy("incident_id").agg(F.max_by("sighting_id", F.struct("confidence", "sighting_id")).alias("sighting_id"), F.count("*").alias("readings"))


INCIDENT_PLATES = sql("""SELECT incident_id, arg_max(sighting_id, row(confidence, sighting_id)) AS sighting_id, count(*) AS readings FROM
    (SELECT detection_id AS incident_id, camera_id, ts AS seen, unnest([track_id, (track_id + 10) % 150]) AS track_id FROM det WHERE class_name = 'person') i
    JOIN sighting s USING (camera_id, track_id) WHERE s.ts BETWEEN i.seen - INTERVAL 2 DAY AND i.seen + INTERVAL 5 DAY GROUP BY incident_id""")


def plate_stamps(spark, sf_dir):
    """Detections without a plate get that of the first reading within the day after them."""
    d = views.detections(spark, sf_dir).filter("width_px < 96").select("detection_id", "camera_id", "track_id", "ts")
    s = views.sightings(spark, sf_dir).select("camera_id", "track_id", "ts", "sighting_id", "plate")
    hits = joins.band_join(d, s, 86400, on=[("camera_id", "camera_id"), ("track_id", "track_id")])
    return hits.groupBy(F.col("l.detection_id").alias("detection_id")).agg(F.min_by("r.plate", F.struct("r.ts", "r.sighting_id")).alias("plate"))


PLATE_STAMPS = sql("""SELECT detection_id, arg_min(plate, row(read_at, sighting_id)) AS plate FROM (SELECT d.detection_id, s.plate, s.ts AS read_at, s.sighting_id FROM det d JOIN sighting s
    USING (camera_id, track_id) WHERE d.width_px < 96 AND s.ts BETWEEN d.ts AND d.ts + INTERVAL 24 HOUR) GROUP BY detection_id""")


def video_clock(spark, sf_dir):
    """Each reading with the nearest clock sample of its device within 6 h, the earlier of two."""
    q = views.footage(spark, sf_dir).select("camera_id", "ts", F.unix_micros("ts").alias("clock")).distinct()
    s = views.sightings(spark, sf_dir).select("sighting_id", "camera_id", "ts")
    return joins.nearest(s, q, "camera_id", "clock", 6 * 3600).select("sighting_id", "clock")


VIDEO_CLOCK = sql("""SELECT sighting_id, c AS clock FROM sighting LEFT JOIN (SELECT s.sighting_id AS i, arg_min(epoch_us(q.ts), row(abs(epoch_us(q.ts) - epoch_us(s.ts)), q.ts)) AS c FROM sighting s JOIN quality q
    ON q.camera_id = s.camera_id AND abs(epoch_us(q.ts) - epoch_us(s.ts)) <= 21600000000 GROUP BY s.sighting_id) ON i = sighting_id""")


def last_restart(spark, sf_dir):
    """For each reading the last restart (a corrupted frame) of its device before it."""
    q = views.footage(spark, sf_dir).filter("quality = 'corrupted'").select("camera_id", "ts", F.unix_micros("ts").alias("restart"))
    return joins.backward_asof(views.sightings(spark, sf_dir).select("sighting_id", "camera_id", "ts"), q, "camera_id", "restart").select("sighting_id", "restart")


LAST_RESTART = sql("""SELECT sighting_id, (SELECT max(epoch_us(q.ts)) FROM quality q WHERE q.camera_id = s.camera_id AND q.quality = 'corrupted' AND q.ts <= s.ts) AS restart FROM sighting s""")


def guarded_times(spark, sf_dir):
    """Readings that have a sample within a day with no restart between it and them."""
    s = views.sightings(spark, sf_dir).select("sighting_id", "camera_id", "ts")
    q = views.footage(spark, sf_dir)
    ok = joins.backward_asof(s, q.filter("quality <> 'corrupted'").select("camera_id", "ts", F.unix_micros("ts").alias("sample")), "camera_id", "sample").drop("sampled_at")
    ok = joins.backward_asof(ok, q.filter("quality = 'corrupted'").select("camera_id", "ts", F.unix_micros("ts").alias("restart")), "camera_id", "restart")
    fresh = F.unix_micros("ts") - F.col("sample") <= 86400 * 1000000
    return ok.filter(fresh & (F.col("restart").isNull() | (F.col("restart") < F.col("sample")))).select("sighting_id")


GUARDED_TIMES = sql("""SELECT sighting_id FROM sighting s WHERE EXISTS (SELECT 1 FROM quality q WHERE q.camera_id = s.camera_id AND q.quality <> 'corrupted' AND q.ts <= s.ts AND q.ts >= s.ts - INTERVAL 24 HOUR
    AND NOT EXISTS (SELECT 1 FROM quality r WHERE r.camera_id = s.camera_id AND r.quality = 'corrupted' AND r.ts >= q.ts AND r.ts <= s.ts))""")


def per_supplier_counts(spark, sf_dir):
    """Several counts beside each device, of facts aggregated before the join."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("last_ship"))
    parts = li.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("parts"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    out = s.join(lines, F.col("s_suppkey") == lines["l_suppkey"], "left").drop("l_suppkey").join(parts, F.col("s_suppkey") == parts["l_suppkey"], "left").drop("l_suppkey")
    return out.select("s_suppkey", "s_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "returned", "parts")), "last_ship")


PER_SUPPLIER_COUNTS = """SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned,
    (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS last_ship FROM supplier"""


def evidence_flags(spark, sf_dir):
    """Whether an order has a returned line, beside the order."""
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("evidence", F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(back, "o_orderkey", "left").select("o_orderkey", F.coalesce("evidence", F.lit(False)).alias("evidence"))


EVIDENCE_FLAGS = "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS evidence FROM orders"


def uncovered(spark, sf_dir):
    """Customers of nations without any supplier of a positive balance."""
    good = table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(good, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


UNCOVERED = "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)"


def stale_devices(spark, sf_dir):
    """Devices of a source that its last sync (the lines of its last two days of shipping) didn't see, only if it saw any and had no errors."""
    cams = views.cameras(spark, sf_dir).withColumn("source", F.col("camera_id") % 4)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("camera_id"), (F.col("l_suppkey") % 4).alias("source"), "l_tax", "l_shipdate").filter("source <> 2")
    last = li.groupBy("source").agg(F.date_sub(F.max("l_shipdate"), 1).alias("since"))
    seen = li.join(last, "source").filter(F.col("l_shipdate") >= F.col("since"))
    sound = seen.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("l_tax") > 0.07) & (F.col("source") == 3)).alias("errors")).filter("n > 0 and errors = 0").select("source")
    return cams.join(sound, "source", "left_semi").join(seen.select("camera_id"), "camera_id", "left_anti").select("camera_id", "source")


STALE_DEVICES = sql("""SELECT camera_id, camera_id % 4 AS source FROM cam WHERE camera_id % 4 IN (SELECT source FROM seen GROUP BY source HAVING count(*) > 0 AND count(*) FILTER (l_tax > 0.07 AND source = 3) = 0)
    AND camera_id NOT IN (SELECT camera_id FROM seen)""", seen="SELECT * FROM (SELECT l_suppkey AS camera_id, l_suppkey % 4 AS source, l_tax, l_shipdate, max(l_shipdate) OVER (PARTITION BY l_suppkey % 4) AS last FROM lineitem WHERE l_suppkey % 4 <> 2) WHERE CAST(l_shipdate AS DATE) >= CAST(last AS DATE) - 1")  # fmt: skip


def hot_cameras(spark, sf_dir):
    """Devices within reach of any device with a reading close to a stolen plate in the last days, those included."""
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    recent = views.sightings(spark, sf_dir).filter(F.unix_micros("ts") >= F.unix_micros(now) - 3 * 86400 * 1000000)
    wanted = views.watch_list(spark, sf_dir).filter("category = 'stolen'").select(F.col("plate").alias("watched"))
    last = stored(joins.fuzzy_join(recent, wanted).groupBy("camera_id").agg(F.max("ts").alias("ts")), "hot")
    cams = views.cameras(spark, sf_dir).select("camera_id", "latitude", "longitude")
    starts = last.join(cams, "camera_id")
    minutes = (F.unix_micros(now) - F.unix_micros("ts")) / 60e6
    return joins.reach_join(starts, cams, minutes).select("camera_id").union(last.select("camera_id")).distinct()


HOT_CAMERAS = sql(
    f"""SELECT camera_id FROM last UNION SELECT p.camera_id FROM cam p WHERE EXISTS (SELECT 1 FROM last l JOIN cam c USING (camera_id) WHERE {duck_km("c", "p")} <= least(25, greatest(3, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(l.ts)) / 60e6)))""",
    last=f"SELECT camera_id, max(ts) AS ts FROM sighting WHERE ts >= TIMESTAMP '2024-01-27' AND plate IN (SELECT plate FROM (SELECT s.plate, {duck_distance('s.plate', 'w.plate')} AS d FROM (SELECT DISTINCT plate FROM sighting) s JOIN watch w ON category = 'stolen' AND levenshtein(s.plate, w.plate) <= 2) WHERE d <= 1.0) GROUP BY camera_id",
)


def nearest_reading(spark, sf_dir):
    """For each listed plate the reading that is fewest edits away, at most 3."""
    w = views.watch_list(spark, sf_dir).select(F.col("plate").alias("watched"))
    s = views.sightings(spark, sf_dir).select("plate")
    return nearest_plates(s, w, 3)


def nearest_plates(readings, wanted, most):
    """wanted, plate and edits: the nearest of ``readings.plate`` for each of ``wanted.watched``, the smaller of two.

    Each round allows one edit more, for the listed plates that have none yet.
    """
    with job(readings.sparkSession, "nearest") as result:
        readings, left, found = stored(readings.select("plate").distinct(), "readings"), stored(wanted.select("watched").filter(F.col("watched").isNotNull()), "wanted"), None
        for edits in range(most + 1):
            near = joins.edit_join(readings, left, edits).groupBy("watched").agg(F.min(F.struct("edits", "plate")).alias("m"))
            near = stored(near.select(F.col("watched").alias("wanted"), "m.plate", "m.edits"), "nearest")
            found = near if found is None else found.union(near)
            left = stored(left.join(near.select(F.col("wanted").alias("watched")), "watched", "left_anti"), "wanted")
        return result(found)


NEAREST_READING = sql("""SELECT wanted, plate, edits FROM (SELECT w.plate AS wanted, s.plate, levenshtein(s.plate, w.plate) AS edits FROM watch w JOIN (SELECT DISTINCT plate FROM sighting) s ON levenshtein(s.plate, w.plate) <= 3)
    QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY edits, plate) = 1""")


def box_matches(spark, sf_dir):
    """Predictions claim the best free box of their picture, the surest first."""
    d = views.detections(spark, sf_dir)
    x = lambda k: ((F.col("detection_id") * k) % 40).cast("double")
    boxes = d.select(F.floor(F.col("detection_id") / 400).alias("camera_id"), F.floor(F.col("detection_id") / 20).alias("picture"), "detection_id", "confidence", x(7).alias("x1"), x(13).alias("y1"), (x(7) + 40).alias("x2"), (x(13) + 40).alias("y2"))
    return greedy_boxes(boxes.filter("detection_id % 2 = 0"), boxes.filter("detection_id % 2 = 1"), ["camera_id", "picture"], 0.30)


def greedy_boxes(predictions, labels, key, least_iou):
    """prediction, label and iou of greedy one-to-one matches within each picture.

    A picture's candidate pairs above ``least_iou`` are folded in order of
    confidence; the fold keeps what is taken. A picture holds few boxes.
    """
    p, t = predictions.alias("p"), labels.alias("t")
    box = lambda n: [F.col(f"{n}.{c}") for c in ("x1", "y1", "x2", "y2")]
    pairs = p.join(t, key).select(*key, F.col("p.confidence").alias("confidence"), F.col("p.detection_id").alias("prediction"), F.col("t.detection_id").alias("label"), geo.iou(box("p"), box("t")).alias("iou")).filter(F.col("iou") >= least_iou)
    row = F.struct((-F.col("confidence")).alias("c"), F.col("prediction"), (-F.col("iou")).alias("i"), F.col("label"))
    folded = F.aggregate(
        F.array_sort("rows"),
        F.expr("cast(array() as array<struct<prediction: bigint, label: bigint, iou: double>>)"),
        lambda kept, r: F.when(F.exists(kept, lambda k: (k["prediction"] == r["prediction"]) | (k["label"] == r["label"])), kept).otherwise(F.array_append(kept, F.struct(r["prediction"].alias("prediction"), r["label"].alias("label"), (-r["i"]).alias("iou")))),
    )
    return pairs.groupBy(*key).agg(F.collect_list(row).alias("rows")).select(*key, F.explode(folded).alias("m")).select(*key, "m.prediction", "m.label", F.round("m.iou", 6).alias("iou"))


BOX_MATCHES = sql(
    "SELECT camera_id, picture, prediction, label, round(iou, 6) AS iou FROM walk WHERE hit",
    box="SELECT detection_id AS id, floor(detection_id / 400)::BIGINT AS camera_id, floor(detection_id / 20)::BIGINT AS picture, confidence, (detection_id * 7) % 40 AS x, (detection_id * 13) % 40 AS y FROM det",
    pair="SELECT p.camera_id, p.picture, p.confidence, p.id AS prediction, t.id AS label, greatest(0, 40 - abs(p.x - t.x)) * greatest(0, 40 - abs(p.y - t.y)) AS inter FROM box p JOIN box t ON p.picture = t.picture AND p.id % 2 = 0 AND t.id % 2 = 1",
    numbered="SELECT *, inter / CAST(3200 - inter AS DOUBLE) AS iou, row_number() OVER (PARTITION BY picture ORDER BY confidence DESC, prediction, inter DESC, label) AS k FROM pair WHERE inter / CAST(3200 - inter AS DOUBLE) >= 0.30",
    walk="""SELECT camera_id, picture, k, prediction, label, iou, true AS hit, [prediction] AS ps, [label] AS ls FROM numbered WHERE k = 1 UNION ALL SELECT n.camera_id, n.picture, n.k, n.prediction, n.label, n.iou, NOT list_contains(ps, n.prediction) AND NOT list_contains(ls, n.label),
    CASE WHEN list_contains(ps, n.prediction) OR list_contains(ls, n.label) THEN ps ELSE list_append(ps, n.prediction) END, CASE WHEN list_contains(ps, n.prediction) OR list_contains(ls, n.label) THEN ls ELSE list_append(ls, n.label) END FROM walk w JOIN numbered n ON n.picture = w.picture AND n.k = w.k + 1""",
)


def union_view(spark, sf_dir):
    """The readings of all devices' own tables as one: a table with a folder for each device."""
    path = new_path(spark, "by-device")
    views.sightings(spark, sf_dir).select("camera_id", "sighting_id", "plate").write.partitionBy("camera_id").parquet(path)
    return spark.read.schema("camera_id bigint, sighting_id bigint, plate string").parquet(path).groupBy("camera_id").agg(F.count("*").alias("n"), F.countDistinct("plate").alias("plates"))


UNION_VIEW = sql("SELECT camera_id, count(*) AS n, count(DISTINCT plate) AS plates FROM sighting GROUP BY camera_id")

QUERIES = {
    "scoped_detections": scoped_detections, "watch_hits": watch_hits, "cross_camera": cross_camera, "event_correlation": event_correlation, "incident_plates": incident_plates,
    "plate_stamps": plate_stamps, "video_clock": video_clock, "last_restart": last_restart, "guarded_times": guarded_times, "per_supplier_counts": per_supplier_counts,
    "evidence_flags": evidence_flags, "uncovered": uncovered, "stale_devices": stale_devices, "hot_cameras": hot_cameras, "nearest_reading": nearest_reading, "box_matches": box_matches, "union_view": union_view,
}
ORACLES = {
    "scoped_detections": SCOPED_DETECTIONS, "watch_hits": WATCH_HITS, "cross_camera": CROSS_CAMERA, "event_correlation": EVENT_CORRELATION, "incident_plates": INCIDENT_PLATES,
    "plate_stamps": PLATE_STAMPS, "video_clock": VIDEO_CLOCK, "last_restart": LAST_RESTART, "guarded_times": GUARDED_TIMES, "per_supplier_counts": PER_SUPPLIER_COUNTS,
    "evidence_flags": EVIDENCE_FLAGS, "uncovered": UNCOVERED, "stale_devices": STALE_DEVICES, "hot_cameras": HOT_CAMERAS, "nearest_reading": NEAREST_READING, "box_matches": BOX_MATCHES, "union_view": UNION_VIEW,
}
