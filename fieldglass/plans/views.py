"""Domain views over the driver tables: devices, detections, sightings, watch list, footage quality.

Each view is a DataFrame here and a common table expression for DuckDB in CTES, so
that every query has a twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    health = F.element_at(F.array(*map(F.lit, ("offline", "degraded", "unavailable", "online", "online"))), (key % 5 + 1).cast("int"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        key.alias("camera_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("department"),
        (20.1 + ((key * 37) % 460) / F.lit(100.0)).alias("latitude"),
        (68.1 + ((key * 53) % 640) / F.lit(100.0)).alias("longitude"),
        health.alias("health_status"),
        F.when(key % 7 == 3, "SUSPENDED").otherwise("COMMISSIONED").alias("installation_status"),
        F.date_add(F.lit("2012-01-01").cast("date"), ((key * 311) % 4000).cast("int")).alias("installation_date"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("click", "car", "view", "motorcycle", "purchase", "truck", "signup", "bus")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("detection_id"),
        (F.col("user_id") % 10).alias("camera_id"),
        F.col("user_id").alias("track_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("person")).alias("class_name"),
        (F.col("value") / F.lit(500.0)).alias("confidence"),
        (F.get_json_object("props", "$.k").cast("int") * 2).alias("width_px"),
    )


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    letter = lambda x: F.char((65 + x % 26).cast("int"))
    plate = F.concat(F.lit("GJ"), F.lpad((u % 38 + 1).cast("string"), 2, "0"), letter(u), letter(u * 7), (1000 + (u * 37) % 9000).cast("string"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", plate.alias("plate"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate readings, some of them short by a glyph, confused or off by one."""
    d, p = detections(spark, sf_dir), plates(spark, sf_dir)
    seen = d.filter((F.col("class_name") != "person") & (F.col("width_px") >= 96)).join(p, d.track_id == p.user_id)
    i, plate = F.col("detection_id"), F.col("plate")
    head = F.substring(plate, 1, 9)
    read = F.when(i % 13 == 0, head).when(i % 11 == 0, F.concat(F.lit("6"), F.expr("substr(plate, 2)"))).when(i % 17 == 0, F.concat(head, ((F.substring(plate, 10, 1).cast("int") + 1) % 10).cast("string"))).otherwise(plate)
    return seen.select(i.alias("sighting_id"), "camera_id", "track_id", "ts", "confidence", (1 + F.col("width_px") % 9).alias("observations"), read.alias("plate"))


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("stolen", "wanted", "blacklist", "missing", "suspect")))
    return plates(spark, sf_dir).filter(F.col("user_id") % 7 == 0).select("plate", F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("category"))


def footage_kind() -> Column:
    """What is wrong with a frame, by its width: five kinds."""
    w = F.col("width_px")
    return F.when(w % 6 == 0, "corrupted").when(w % 6 == 2, "blackout").when(w % 5 == 0, "overexposed").when(w % 5 == 1, "low_light").otherwise("blurred")


def footage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter(F.col("class_name") == "person").select("camera_id", "ts", footage_kind().alias("quality"))


CTES = {
    "cam": """SELECT s_suppkey AS camera_id, s_name AS name, n_name AS district, r_name AS department,
      20.1 + ((s_suppkey*37) % 460)/CAST(100.0 AS DOUBLE) AS latitude, 68.1 + ((s_suppkey*53) % 640)/CAST(100.0 AS DOUBLE) AS longitude,
      CASE s_suppkey % 5 WHEN 0 THEN 'offline' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unavailable' ELSE 'online' END AS health_status,
      CASE WHEN s_suppkey % 7 = 3 THEN 'SUSPENDED' ELSE 'COMMISSIONED' END AS installation_status,
      CAST((DATE '2012-01-01' + CAST((s_suppkey*311) % 4000 AS INT)) AS DATE) AS installation_date
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "det": """SELECT event_id AS detection_id, user_id % 10 AS camera_id, user_id AS track_id, CAST(ts AS TIMESTAMP) AS ts,
      CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'motorcycle' WHEN 'purchase' THEN 'truck' WHEN 'signup' THEN 'bus' ELSE 'person' END AS class_name,
      value/CAST(500.0 AS DOUBLE) AS confidence, CAST(json_extract_string(props,'$.k') AS INT) * 2 AS width_px FROM events""",
    "plate_of": """SELECT user_id, concat('GJ', lpad(CAST(user_id % 38 + 1 AS VARCHAR),2,'0'), chr(CAST(65 + user_id % 26 AS INT)),
      chr(CAST(65 + (user_id*7) % 26 AS INT)), CAST(1000 + (user_id*37) % 9000 AS VARCHAR)) AS plate FROM (SELECT DISTINCT user_id FROM events) u""",
    "sighting": """SELECT d.detection_id AS sighting_id, d.camera_id, d.track_id, d.ts, d.confidence, 1 + d.width_px % 9 AS observations,
      CASE WHEN d.detection_id % 13 = 0 THEN substr(p.plate,1,9) WHEN d.detection_id % 11 = 0 THEN concat('6', substr(p.plate,2))
      WHEN d.detection_id % 17 = 0 THEN concat(substr(p.plate,1,9), CAST((CAST(substr(p.plate,10,1) AS INT)+1) % 10 AS VARCHAR)) ELSE p.plate END AS plate
      FROM det d JOIN plate_of p ON p.user_id = d.track_id WHERE d.class_name <> 'person' AND d.width_px >= 96""",
    "watch": """SELECT plate, CASE user_id % 5 WHEN 0 THEN 'stolen' WHEN 1 THEN 'wanted' WHEN 2 THEN 'blacklist' WHEN 3 THEN 'missing' ELSE 'suspect' END AS category
      FROM plate_of WHERE user_id % 7 = 0""",
    "quality": """SELECT camera_id, ts, CASE WHEN width_px % 6 = 0 THEN 'corrupted' WHEN width_px % 6 = 2 THEN 'blackout' WHEN width_px % 5 = 0 THEN 'overexposed' WHEN width_px % 5 = 1 THEN 'low_light' ELSE 'blurred' END AS quality
      FROM det WHERE class_name = 'person'""",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the views as common table expressions before it, and then its own."""
    ctes = ", ".join(f"{n} AS ({q})" for n, q in (CTES | more).items())
    return f"WITH RECURSIVE {ctes} {body}"
