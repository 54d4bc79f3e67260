"""Queries of sources and sinks: what is written in a dialect is read back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import fields
from fieldglass.plans import views
from fieldglass.plans.views import sql
from fieldglass.operators import tables
from fieldglass.sources import answers, registers
from fieldglass.store import new_path


def dialect_events(spark, sf_dir):
    """Detections written in two departments' dialects, read as one schema."""
    d, ts = views.detections(spark, sf_dir), F.date_trunc("second", "ts")
    a, b = new_path(spark, "events-a"), new_path(spark, "events-b")
    s = F.col("detection_id").cast("string")
    meta = F.create_map(F.lit("w"), F.col("width_px").cast("string"))
    d.filter("detection_id % 2 = 0").select(s.alias("evt_id"), F.col("camera_id").cast("string").alias("cam"), F.upper("class_name").alias("kind"), fields.local_text(ts).alias("ts"), F.when(F.col("confidence") > 0.5, "HIGH").otherwise("LOW").alias("severity"), meta.alias("meta")).write.json(a)
    d.filter("detection_id % 2 = 1").select(s.alias("ref"), F.col("camera_id").cast("string").alias("cam_ref"), F.col("class_name").alias("type"), F.unix_millis(ts).alias("at_ms"), F.when(F.col("confidence") > 0.5, 3).otherwise(1).alias("level"), meta.alias("attributes")).write.json(b)
    both = registers.events_a(spark, a, False).unionByName(registers.events_b(spark, b, False))
    return both.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


DIALECT_EVENTS = sql("""SELECT CASE WHEN detection_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, CAST(detection_id AS VARCHAR) AS event_id, CAST(camera_id AS VARCHAR) AS camera_id, class_name AS event_type, date_trunc('second', ts) AS ts,
    CASE WHEN confidence > 0.5 THEN 'high' ELSE 'low' END AS severity FROM det""")


def camera_dialects(spark, sf_dir):
    """A2-A4: registers of three dialects, the third with surveyed places."""
    c = views.cameras(spark, sf_dir)
    paths = [new_path(spark, f"cameras-{k}") for k in "abc"]
    s = F.col("camera_id").cast("string")
    c.filter("camera_id % 3 = 0").select(s.alias("camera_code"), F.col("name").alias("camera_name"), F.concat("district", F.lit(" /")).alias("zone"), F.upper("health_status").alias("status"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.date_format("installation_date", "dd/MM/yyyy").alias("installed_on")).write.json(paths[0])
    c.filter("camera_id % 3 = 1").select(s.alias("cameraRef"), F.struct("name", F.col("district").alias("zone")).alias("meta"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("position"), F.col("health_status").alias("state"), F.unix_millis(F.col("installation_date").cast("timestamp")).alias("installedAt")).write.json(paths[1])
    c.filter("camera_id % 3 = 2").select(s.alias("id"), F.col("name").alias("title"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).write.json(paths[2])
    third = registers.catalogue(spark, paths[2], whole_files=False, surveyed=c.filter("camera_id % 2 = 0").select(s.alias("camera_id"), "latitude", "longitude"))
    both = registers.cameras_a(spark, paths[0], False).unionByName(registers.cameras_b(spark, paths[1], False)).unionByName(third, allowMissingColumns=True)
    return both.select("source", "camera_id", "name", "zone", "health_status", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "installation_date")


CAMERA_DIALECTS = sql("""SELECT CASE camera_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS source, CAST(camera_id AS VARCHAR) AS camera_id, name, CASE WHEN camera_id % 3 < 2 THEN district END AS zone,
    CASE WHEN camera_id % 3 < 2 THEN CASE health_status WHEN 'unavailable' THEN 'offline' ELSE health_status END END AS health_status, round(CASE WHEN camera_id % 3 < 2 OR camera_id % 2 = 0 THEN latitude ELSE 0 END, 6) AS latitude,
    round(CASE WHEN camera_id % 3 < 2 OR camera_id % 2 = 0 THEN longitude ELSE 0 END, 6) AS longitude, CASE WHEN camera_id % 3 < 2 THEN installation_date END AS installation_date FROM cam""")


def landed_answers(spark, sf_dir):
    """A1: answers of each district's service, some refused, cut off, late or short of an item's id; the attempt that counts of each."""
    c = views.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).cast("string").alias("source"), F.floor(F.col("s_suppkey") / 100).alias("page"))
    item = F.struct(F.when(F.col("s_suppkey") % 13 != 0, F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 9).alias("n"))
    pages = c.groupBy("source", "page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("body"))
    k = (F.col("page") * 7 + F.col("source").cast("int")) % 11
    attempt = F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt")
    sent = pages.select("source", F.concat(F.lit("page "), "page").alias("request"), attempt, k.alias("k"), "body")
    status = F.when((F.col("k") == 3) & (F.col("attempt") == 1), 503).when(F.col("k") == 7, 401).when(F.col("k") == 9, F.lit(None)).otherwise(200)
    body = F.when(F.col("k") == 5, F.expr("substr(body, 1, length(body) - 3)")).when(F.col("k") == 9, F.lit(None)).otherwise(F.col("body"))
    path = new_path(spark, "answers")
    sent.select(F.to_json(F.struct("source", "request", "attempt", status.alias("status"), (F.col("k") == 9).alias("timed_out"), body.alias("body")))).write.text(path)
    rows = answers.settled(answers.read(spark.read.text(path), "id string, n int", "id"))
    return rows.groupBy("source", "request", "attempt", F.coalesce("error", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.col("item.id").cast("bigint")).alias("ids"))


LANDED_ANSWERS = """SELECT source, request, CAST(max(CASE WHEN k = 3 THEN 2 ELSE 1 END) AS INT) AS attempt, outcome, CASE WHEN max(k) IN (5, 7, 9) THEN 1 ELSE count(*) END AS n, CAST(CASE WHEN outcome = 'loaded' THEN sum(s_suppkey) END AS BIGINT) AS ids FROM
    (SELECT source, request, k, s_suppkey, CASE k WHEN 5 THEN 'protocol' WHEN 7 THEN 'auth' WHEN 9 THEN 'timeout' ELSE CASE WHEN s_suppkey % 13 = 0 THEN 'item' ELSE 'loaded' END END AS outcome FROM
    (SELECT s_suppkey, CAST(s_suppkey % 25 AS VARCHAR) AS source, 'page ' || (s_suppkey // 100) AS request, (s_suppkey // 100 * 7 + s_suppkey % 25) % 11 AS k FROM supplier)) GROUP BY source, request, outcome"""


def exports(spark, sf_dir):
    """Detections exported as CSV by district, class and device, a folder for each value, counted as read back."""
    cams = views.cameras(spark, sf_dir).select("camera_id", "district")
    d = views.detections(spark, sf_dir).join(cams, "camera_id").withColumnRenamed("class_name", "class").select("detection_id", "camera_id", "district", "class", "confidence")
    out = []
    for name in ("district", "class", "camera_id"):
        path = new_path(spark, f"export-{name}")
        tables.export_by(d.select("detection_id", "confidence", name), name, path)
        back = spark.read.option("header", True).schema(f"detection_id bigint, confidence double, {name} string").csv(path)
        out.append(back.groupBy(F.lit(name).alias("export"), F.col(name).alias("value")).agg(F.count("*").alias("n"), F.sum("detection_id").alias("ids")))
    return out[0].unionByName(out[1]).unionByName(out[2])


EXPORTS = sql("""SELECT export, value, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM (SELECT detection_id, unnest([{'export': 'district', 'value': district}, {'export': 'class', 'value': class_name}, {'export': 'camera_id', 'value': CAST(camera_id AS VARCHAR)}], recursive := true) FROM (SELECT detection_id, class_name, det.camera_id, district FROM det JOIN cam USING (camera_id))) GROUP BY ALL""")


def vehicle_register(spark, sf_dir):
    """A5: a register file read by normalised number, the last row of each."""
    p = views.table(spark, sf_dir, "part").select(F.concat(F.lit("gj "), F.lpad((F.col("p_partkey") % 700).cast("string"), 6, "0")).alias("registration_number"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_type").alias("vehicle_class"), F.col("p_size").cast("string").alias("color"), "p_partkey")
    path = new_path(spark, "vehicles")
    rows = p.groupBy(F.col("p_partkey") % 700 % 16).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "registration_number", "make", "model", "vehicle_class", "color"))), lambda v: v.dropFields("p_partkey")).alias("vehicles"))
    rows.select(F.to_json(F.struct(F.lit("register").alias("source"), F.lit("1").alias("schema_version"), F.lit(True).alias("is_demo_data"), "vehicles"))).write.text(path)
    return registers.vehicles(spark, path, False).select("registration_number", "make", "color")


VEHICLE_REGISTER = "SELECT 'GJ' || lpad(CAST(p_partkey % 700 AS VARCHAR), 6, '0') AS registration_number, arg_max(p_brand, p_partkey) AS make, arg_max(CAST(p_size AS VARCHAR), p_partkey) AS color FROM part GROUP BY 1"


def csv_round_trip(spark, sf_dir):
    """A plate report written as CSV with quotes and commas, read back with the errors of each row."""
    c, path = views.cameras(spark, sf_dir), new_path(spark, "onboarding")
    odd = F.when(F.col("camera_id") % 4 == 0, F.concat(F.lit('a "b", '), "name")).when(F.col("camera_id") % 4 == 1, F.lit("")).otherwise(F.col("name"))
    lat = F.when(F.col("camera_id") % 5 == 0, F.lit("x")).otherwise(F.format_string("%.3f", "latitude"))
    registers.write_csv(c.select(odd.alias("name"), "district", lat.alias("latitude"), F.format_string("%.3f", "longitude").alias("longitude"), F.col("camera_id").cast("string").alias("code")), path)
    return registers.onboarding(spark, path).select("code", "name", F.round("latitude", 3).alias("latitude"), F.array_join("errors", ",").alias("errors"))


CSV_ROUND_TRIP = sql("""SELECT CAST(camera_id AS VARCHAR) AS code, CASE camera_id % 4 WHEN 0 THEN 'a "b", ' || name WHEN 1 THEN NULL ELSE name END AS name, CASE WHEN camera_id % 5 <> 0 THEN round(latitude, 3) END AS latitude,
    array_to_string(list_filter([CASE WHEN camera_id % 4 = 1 THEN 'name_missing' END, CASE WHEN camera_id % 5 = 0 THEN 'latitude_invalid' END], lambda x: x IS NOT NULL), ',') AS errors FROM cam""")


def report_rows(spark, sf_dir):
    """The text columns of the plate report."""
    return registers.plate_report(views.sightings(spark, sf_dir))


REPORT_ROWS = sql("SELECT CAST(sighting_id AS VARCHAR) AS sighting, plate, printf('%.3f', round(confidence, 3)) AS confidence, CASE WHEN observations > 4 THEN 'yes' ELSE 'no' END AS sure FROM sighting WHERE confidence >= 0.10")


def alert_payloads(spark, sf_dir):
    """One signed body of the exact hits of each device and day; body sizes and signatures."""
    s = views.sightings(spark, sf_dir).join(views.watch_list(spark, sf_dir), "plate").select(F.concat_ws("/", "camera_id", F.to_date("ts")).alias("batch"), "sighting_id", "plate", "category")
    return registers.signed_payload(s, "test-key").select("batch", F.length("body").alias("size"), "signature")


QUERIES = {"dialect_events": dialect_events, "camera_dialects": camera_dialects, "vehicle_register": vehicle_register, "landed_answers": landed_answers, "exports": exports, "csv_round_trip": csv_round_trip, "report_rows": report_rows, "alert_payloads": alert_payloads}
ORACLES = {"dialect_events": DIALECT_EVENTS, "camera_dialects": CAMERA_DIALECTS, "vehicle_register": VEHICLE_REGISTER, "landed_answers": LANDED_ANSWERS, "exports": EXPORTS, "csv_round_trip": CSV_ROUND_TRIP, "report_rows": REPORT_ROWS}
