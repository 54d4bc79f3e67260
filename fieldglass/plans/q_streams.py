"""Queries that run a stream over the events to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.plans import views
from fieldglass.plans.q_fields import duck_distance
from fieldglass.plans.views import sql
from fieldglass.store import new_path
from fieldglass.streaming import incidents, ingest

HOUR = 3600 * 1_000_000


def _detections(spark, sf_dir):
    """The events of the table as a stream of detections."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    kinds = F.create_map(*(F.lit(x) for x in ("click", "car", "view", "motorcycle", "purchase", "truck", "signup", "bus")))
    return events.select(
        F.col("event_id").alias("detection_id"), (F.col("user_id") % 10).alias("camera_id"), F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("person")).alias("class_name"), (F.get_json_object("props", "$.k").cast("int") * 2).alias("width_px"),
    )


def stream_ingest(spark, sf_dir):
    """Rows of a stream that replays some of them, each once with its verdict."""
    d = _detections(spark, sf_dir).withColumn("camera_id", F.col("detection_id") % 120)
    twice = d.withColumn("copy", F.explode(F.when(F.col("detection_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    found = ingest.verdicts(twice, views.cameras(spark, sf_dir), "ASIA", F.lit("2024-01-29 00:05:00").cast("timestamp"))
    path = new_path(spark, "ingest")
    ingest.run_once(found.select("detection_id", "camera_id", "reject_code"), path, ingest.appended(path))
    return spark.read.parquet(path).groupBy(F.coalesce("reject_code", F.lit("ACCEPTED")).alias("code")).agg(F.count("*").alias("n"), F.sum("detection_id").alias("ids"))


STREAM_INGEST = sql("""SELECT code, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM (SELECT detection_id, CASE WHEN installation_status IS NULL THEN 'UNKNOWN_CAMERA' WHEN installation_status <> 'COMMISSIONED' THEN 'CAMERA_NOT_COMMISSIONED'
    WHEN department <> 'ASIA' THEN 'CAMERA_OUT_OF_SCOPE' WHEN ts > TIMESTAMP '2024-01-29 00:05:00' THEN 'INVALID_TIMESTAMP' ELSE 'ACCEPTED' END AS code FROM det LEFT JOIN cam c ON c.camera_id = detection_id % 120) GROUP BY code""")


def stream_alerts(spark, sf_dir):
    """Readings matched with the watch list as they arrive."""
    p, i = views.plates(spark, sf_dir), F.col("detection_id")
    read = F.when(i % 13 == 0, F.substring("plate", 1, 9)).when(i % 11 == 0, F.concat(F.lit("6"), F.expr("substr(plate, 2)"))).otherwise(F.col("plate"))
    s = _detections(spark, sf_dir).filter("class_name <> 'person' and width_px >= 96").join(p, F.col("track_id") == F.col("user_id")).select(i.alias("sighting_id"), "camera_id", read.alias("plate"))
    path = new_path(spark, "alerts")
    ingest.run_once(s, path, ingest.alert_writer(lambda: views.watch_list(spark, sf_dir), path))
    return spark.read.schema("sighting_id bigint, camera_id bigint, plate string, watched string, category string, distance double").parquet(path).select("sighting_id", "plate", "watched", F.round("distance", 6).alias("distance"))


STREAM_ALERTS = sql(
    "SELECT sighting_id, r.plate, watched, round(d, 6) AS distance FROM read r JOIN near USING (plate)",
    read="SELECT detection_id AS sighting_id, CASE WHEN detection_id % 13 = 0 THEN substr(plate, 1, 9) WHEN detection_id % 11 = 0 THEN '6' || substr(plate, 2) ELSE plate END AS plate FROM det JOIN plate_of ON user_id = track_id WHERE class_name <> 'person' AND width_px >= 96",
    near=f"SELECT * FROM (SELECT r.plate, w.plate AS watched, {duck_distance('r.plate', 'w.plate')} AS d FROM (SELECT DISTINCT plate FROM read) r JOIN watch w ON levenshtein(r.plate, w.plate) <= 2) WHERE d <= 1.0",
)


def stream_traffic(spark, sf_dir):
    """E1 on a stream: detections of each device by day."""
    path = new_path(spark, "traffic")
    ingest.run_once(ingest.traffic(_detections(spark, sf_dir)), path, lambda batch, number: batch.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path).withColumn("start", F.col("start").cast("timestamp_ntz"))


STREAM_TRAFFIC = sql("SELECT camera_id, date_trunc('day', ts) AS start, count(*) AS n FROM det GROUP BY ALL")


def stream_bursts(spark, sf_dir):
    """I5-I7, I10 with state: alerts of three bad frames within a day, closed after two days without any."""
    q = _detections(spark, sf_dir).filter("class_name = 'person'").select("camera_id", views.footage_kind().alias("quality"), "ts")
    path = new_path(spark, "bursts")
    ingest.run_once(ingest.bursts(q, 24 * HOUR, 3, 48 * HOUR), path, ingest.appended(path))
    return spark.read.parquet(path).select("camera_id", "quality", F.col("raised").cast("timestamp_ntz").alias("raised"))


STREAM_BURSTS = sql(
    "SELECT camera_id, quality, make_timestamp(t) AS raised FROM walk WHERE raises",
    frame="SELECT camera_id, quality, epoch_us(ts) AS t, row_number() OVER (PARTITION BY camera_id, quality ORDER BY ts) AS k FROM quality",
    walk="""SELECT camera_id, quality, k, t, [t] AS times, false AS open, false AS raises FROM frame WHERE k = 1 UNION ALL SELECT camera_id, quality, k, t, times, open OR len(times) >= 3, NOT open AND len(times) >= 3 FROM
    (SELECT f.camera_id, f.quality, f.k, f.t, w.open AND f.t - w.t <= 172800000000 AS open, list_filter(list_append(CASE WHEN w.open AND f.t - w.t > 172800000000 THEN [] ELSE w.times END, f.t), lambda x: f.t - x <= 86400000000)[-3:] AS times
    FROM walk w JOIN frame f ON f.camera_id = w.camera_id AND f.quality = w.quality AND f.k = w.k + 1)""",
)

ZONE = incidents.Zone([(0.6, 0.6), (1.0, 0.6), (1.0, 1.0), (0.6, 1.0)], frozenset(("person",)), None, 1.0)
FRAME = (800.0, 600.0)


def traffic_boxes(events):
    """Boxes of traffic from events: of a device 20 to a frame, five frames a second; cars, persons in their way, and two trucks that meet."""
    i = F.col("event_id")
    k, slot = F.expr("(event_id % 2000) div 20"), (i % 20).cast("int")
    car, person = slot < 12, slot < 18
    jitter = ((i * 7) % 3).cast("double")
    x = F.when(car, (slot * 67 + k * 9) % 760).when(person, (slot - 11) * 100 + jitter).when(slot == 18, 100 + 15.6 * F.least(k, F.lit(12))).otherwise(513 - 15.6 * F.least(k, F.lit(12)))
    y = F.when(car, 200 + (slot % 3) * 60).when(person, F.when(slot % 3 == 0, 420).otherwise(200 + (slot % 3) * 60)).otherwise(100).cast("double")
    w, h = F.when(car, 70).when(person, 20).otherwise(60), F.when(car, 50).when(person, 45).otherwise(60)
    label = F.when(car, "car").when(person, "person").otherwise("truck")
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + k * 200_000)
    rows = events.select(F.expr("event_id div 2000").alias("camera_id"), ts.alias("ts"), slot.cast("bigint").alias("track_id"), label.alias("label"), x.cast("double").alias("x1"), y.alias("y1"), (x + w).cast("double").alias("x2"), (y + h).alias("y2"), (k * 200).alias("pts"), "event_id")
    # after the first box comes one row without a track, hours later, that lets all frames pass
    last = F.when(F.col("event_id") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("last", F.explode(last))
    return rows.select(F.when(F.col("last"), -1).otherwise(F.col("camera_id")).alias("camera_id"), F.when(F.col("last"), F.timestamp_micros(F.lit(1_704_153_600_000_000))).otherwise(F.col("ts")).alias("ts"), *(F.when(~F.col("last"), F.col(c)).alias(c) for c in ("track_id", "label", "x1", "y1", "x2", "y2", "pts")))


def stream_incidents(spark, sf_dir):
    """I10, I11 with state: persons among moving traffic, collisions and intrusions on a stream of boxes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    boxes = traffic_boxes(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))
    path = new_path(spark, "incidents")
    with incidents.keyed_state(spark):
        ingest.run_once(incidents.incidents(boxes, ZONE, FRAME), path, ingest.appended(path))
    return spark.read.schema(f"{incidents.INCIDENT}, batch int").parquet(path).select("camera_id", "kind", "tracks", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("begun", "raised")))


def stream_settled(spark, sf_dir):
    """I16: readings of a stream in groups that are ready to go: of plates not read for six hours, or full ones of five."""
    p = views.plates(spark, sf_dir).select(F.col("user_id").alias("track_id"), "plate")
    d = _detections(spark, sf_dir).filter("class_name <> 'person' or detection_id = 0")
    # the first row comes twice: its copy, long after all others and without a plate, lets the last groups go
    d = d.withColumn("last", F.explode(F.when(F.col("detection_id") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).filter("last or class_name <> 'person'")
    late = F.col("ts") + F.expr("interval 400 days")
    s = d.join(p, "track_id").select(F.when(F.col("last"), "").otherwise(F.col("plate")).alias("plate"), F.col("detection_id").alias("sighting_id"), F.when(F.col("last"), late).otherwise(F.col("ts")).alias("ts"))
    path = new_path(spark, "settled")
    ingest.run_once(ingest.settled_plates(s, 6 * HOUR, 5), path, ingest.appended(path))
    found = spark.read.schema(f"{ingest.HELD}, batch int").parquet(path)
    return found.select("plate", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"), "flushed")


STREAM_SETTLED = sql(
    "SELECT plate, CAST(count(*) AS INT) AS n, arg_min(id, k) AS first, arg_max(id, k) AS last, CASE WHEN count(*) = 5 THEN 'full' ELSE 'settled' END AS flushed FROM walk GROUP BY plate, run",
    r="SELECT plate, detection_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY plate ORDER BY ts, detection_id) AS k FROM det JOIN plate_of ON user_id = track_id WHERE class_name <> 'person'",
    walk="""SELECT plate, id, t, k, 1 AS held, 0 AS run FROM r WHERE k = 1 UNION ALL SELECT r.plate, r.id, r.t, r.k, CASE WHEN w.held = 5 OR r.t - w.t > 21600000000 THEN 1 ELSE w.held + 1 END, CASE WHEN w.held = 5 OR r.t - w.t > 21600000000 THEN w.run + 1 ELSE w.run END FROM walk w JOIN r ON r.plate = w.plate AND r.k = w.k + 1""",
)


def stream_copies(spark, sf_dir):
    """Detections of a stream in a main table and in a copy by device that fails when the first batch comes, mended afterwards."""
    main, copy = new_path(spark, "main"), new_path(spark, "copy")
    d = _detections(spark, sf_dir).select("detection_id", "camera_id", "ts")

    def by_device(batch, number):
        batch.write.mode("overwrite").partitionBy("camera_id").parquet(f"{copy}/batch={number}")

    def refuses(batch, number):
        raise OSError("the copy is out of reach")

    ingest.run_once(d, main, ingest.mirrored(ingest.appended(main), refuses))
    ingest.repair(spark, main, copy, by_device)
    read = spark.read.schema("detection_id bigint, ts timestamp, batch int, camera_id bigint").parquet(copy)
    return read.groupBy("camera_id").agg(F.count("*").alias("n"), F.sum("detection_id").alias("ids"))


STREAM_COPIES = sql("SELECT camera_id, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM det GROUP BY camera_id")


def source_sweep(spark, sf_dir):
    """A sweep over the departments' devices of which one service fails: the rows of each, and the failure."""
    c = views.cameras(spark, sf_dir)
    path = new_path(spark, "sweep")

    def poll(name):
        found = c.filter(F.col("department") == name).select("camera_id", "health_status")
        return found if name != "EUROPE" else found.withColumn("camera_id", F.when(F.raise_error(F.lit("no answer")).isNull(), F.col("camera_id")))

    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    found = ingest.sweep(spark, {n: (lambda n=n: poll(n)) for n in names}, lambda name, df: df.write.parquet(f"{path}/source={name.replace(' ', '-')}"))
    return found.select("source", "rows", F.col("error").isNotNull().alias("failed"))


SOURCE_SWEEP = sql("SELECT r_name AS source, CASE WHEN r_name = 'EUROPE' THEN 0 ELSE (SELECT count(*) FROM cam WHERE department = r_name) END AS rows, r_name = 'EUROPE' AS failed FROM region")

QUERIES = {"stream_settled": stream_settled, "stream_copies": stream_copies, "source_sweep": source_sweep, "stream_incidents": stream_incidents, "stream_ingest": stream_ingest, "stream_alerts": stream_alerts, "stream_traffic": stream_traffic, "stream_bursts": stream_bursts}
ORACLES = {"stream_settled": STREAM_SETTLED, "stream_copies": STREAM_COPIES, "source_sweep": SOURCE_SWEEP, "stream_ingest": STREAM_INGEST, "stream_alerts": STREAM_ALERTS, "stream_traffic": STREAM_TRAFFIC, "stream_bursts": STREAM_BURSTS}
