"""Reading department registers, event files and CSV of several dialects into one schema, and writing them.

Readers take paths that Spark reads and explicit schemas; a row that can't be
read becomes nulls, and validation says what is wrong with a row instead of
failing the load.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions import fields, plates

EVENT_A = "evt_id string, cam string, kind string, ts string, severity string, meta map<string,string>"
EVENT_B = "ref string, cam_ref string, type string, at_ms bigint, level int, attributes map<string,string>"
CAMERA_A = "camera_code string, camera_name string, zone string, status string, lat double, lon double, installed_on string"
CAMERA_B = "cameraRef string, meta struct<name: string, zone: string>, position struct<lat: double, lng: double>, state string, installedAt bigint"
VEHICLES = "source string, schema_version string, is_demo_data boolean, vehicles array<struct<registration_number: string, make: string, model: string, vehicle_class: string, color: string>>"
#: Words in a column's name that would identify an owner.
OWNER_WORDS = ("owner", "aadhaar", "phone", "mobile", "address", "email", "father", "licence_holder")
SEVERITIES = ["low", "medium", "high", "critical"]


def events_a(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Events of the flat dialect: local wall clock, words for severity; arrays in whole files, or a row a line."""
    raw = spark.read.schema(EVENT_A).option("multiLine", whole_files).json(path)
    return raw.select(F.lit("A").alias("source"), F.col("evt_id").alias("event_id"), F.col("cam").alias("camera_id"), F.lower("kind").alias("event_type"), fields.wall_clock_utc(F.col("ts")).alias("ts"), F.lower("severity").alias("severity"))


def events_b(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Events of the nested dialect: epoch milliseconds, levels for severity."""
    raw = spark.read.schema(EVENT_B).option("multiLine", whole_files).json(path)
    level = F.try_element_at(F.array(*map(F.lit, SEVERITIES)), F.col("level"))
    return raw.select(F.lit("B").alias("source"), F.col("ref").alias("event_id"), F.col("cam_ref").alias("camera_id"), F.lower("type").alias("event_type"), F.timestamp_millis("at_ms").alias("ts"), level.alias("severity"))


def cameras_a(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    raw = spark.read.schema(CAMERA_A).option("multiLine", whole_files).json(path)
    return raw.select(F.lit("A").alias("source"), F.col("camera_code").alias("camera_id"), F.col("camera_name").alias("name"), fields.joined_zone(F.col("zone")).alias("zone"), fields.folded(F.col("status"), fields.HEALTH_WORDS, "unknown").alias("health_status"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), fields.any_date(F.col("installed_on")).alias("installation_date"))


def cameras_b(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    raw = spark.read.schema(CAMERA_B).option("multiLine", whole_files).json(path)
    return raw.select(F.lit("B").alias("source"), F.col("cameraRef").alias("camera_id"), F.col("meta.name").alias("name"), fields.joined_zone(F.col("meta.zone")).alias("zone"), fields.folded(F.col("state"), fields.HEALTH_WORDS, "unknown").alias("health_status"), F.col("position.lat").alias("latitude"), F.col("position.lng").alias("longitude"), F.to_date(F.timestamp_millis("installedAt")).alias("installation_date"))


def catalogue(spark: SparkSession, path: str, surveyed: DataFrame, whole_files: bool = True) -> DataFrame:
    """A third dialect's catalogue, with surveyed places where there are any."""
    raw = spark.read.schema("id string, title string, lat double, lon double").option("multiLine", whole_files).json(path)
    known = surveyed.select(F.col("camera_id").alias("id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    return raw.join(known, "id", "left").select(F.lit("C").alias("source"), F.col("id").alias("camera_id"), F.col("title").alias("name"), F.coalesce("_lat", "lat").alias("latitude"), F.coalesce("_lon", "lon").alias("longitude"))


def forbidden_columns(schema: T.DataType, path: str = "") -> list[str]:
    """Names of fields, nested ones too, that would identify an owner."""
    found = []
    if isinstance(schema, T.ArrayType):
        return forbidden_columns(schema.elementType, path)
    if isinstance(schema, T.StructType):
        for f in schema:
            if any(w in f.name.lower() for w in OWNER_WORDS):
                found.append(f"{path}{f.name}")
            found += forbidden_columns(f.dataType, f"{path}{f.name}.")
    return found


def vehicles(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """The vehicle register by normalised number, last row of each; ValueError if it would identify owners."""
    inferred = spark.read.option("multiLine", whole_files).json(path)
    if bad := forbidden_columns(inferred.schema):
        raise ValueError(f"the register holds {', '.join(sorted(bad))}")
    rows = spark.read.schema(VEHICLES).option("multiLine", whole_files).json(path).select(F.posexplode("vehicles").alias("at", "v"), "is_demo_data")
    number = plates.registry_form(F.col("v.registration_number"))
    last = rows.filter(number != "").groupBy(number.alias("registration_number")).agg(F.max_by(F.struct("v.make", "v.model", "v.vehicle_class", "v.color", "is_demo_data"), "at").alias("r"))
    return last.select("registration_number", "r.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth CSV of several devices, without comment rows; the device is the file's name, or its folder's (``camera=``)."""
    raw = spark.read.option("header", True).schema("vehicle string, tracks string, plate string, legibility string, vehicle_type string, side string, notes string").csv(path)
    name = F.col("_metadata.file_path")
    device = F.coalesce(F.nullif(F.regexp_extract(name, r"/camera=([^/]*)/[^/]*$", 1), F.lit("")), F.regexp_extract(name, r"([^/]*)\.csv$", 1))
    return raw.select(device.alias("camera"), "vehicle", "tracks", "plate", "legibility", "vehicle_type", "side", "notes").filter(~F.coalesce(F.col("vehicle"), F.lit("")).startswith("#"))


def onboarding(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a bulk import with all errors of each."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema("name string, district string, latitude string, longitude string, code string").csv(path)
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    errors = fields.tags(name_missing=blank("name"), district_missing=blank("district"), latitude_invalid=lat.isNull() | ~lat.between(6.0, 38.0), longitude_invalid=lon.isNull() | ~lon.between(68.0, 98.0))
    return raw.select("name", "district", lat.alias("latitude"), lon.alias("longitude"), "code", errors.alias("errors"))


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 CSV with a header, CRLF rows and empty fields for nulls."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").csv(path)


# Floors of the plate report.
LEAST_CONFIDENCE, LEAST_PRIOR = 0.10, 0.12


def graded(sightings: DataFrame) -> DataFrame:
    """Readings with the floor of the plate report that they miss (``withheld``); null for those in it."""
    priors = sightings.select("plate").distinct().withColumn("_g", plates.grammar(plates.grammar_form(F.col("plate")))).select("plate", F.col("_g.prior").alias("_prior"))
    missed = fields.first_reason(confidence=F.coalesce("confidence", F.lit(0.0)) >= LEAST_CONFIDENCE, grammar=F.coalesce("_prior", F.lit(0.0)) >= LEAST_PRIOR)
    return sightings.join(priors, "plate", "left").withColumn("withheld", missed).drop("_prior")


def write_markdown(df: DataFrame, columns: list[str], path: str) -> None:
    """A Markdown table as text files, the head in one of its own."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(f"| {' | '.join(columns)} |",), (f"|{' --- |' * len(columns)}",)], "line string")
    head.coalesce(1).write.text(path)
    df.select(row([F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "/"), F.lit("")) for c in columns]).alias("line")).write.mode("append").text(path)


def write_truth(rows: DataFrame, path: str) -> None:
    """Ground truth (camera, vehicle, plate) as CSV, a folder for each device."""
    more = ("tracks", "legibility", "vehicle_type", "side", "notes")
    full = rows.withColumns({c: F.lit("") for c in more}).select("camera", "vehicle", "tracks", "plate", "legibility", "vehicle_type", "side", "notes")
    full.write.partitionBy("camera").option("header", True).csv(path)


def plate_report(sightings: DataFrame, floor: float = 0.10) -> DataFrame:
    """The columns of a plate report as text: confidence with three decimals, yes or no, nulls empty."""
    rows = sightings.filter(F.coalesce("confidence", F.lit(0.0)) >= floor)
    return rows.select(F.col("sighting_id").cast("string").alias("sighting"), "plate", F.format_string("%.3f", F.round(F.col("confidence") * 1000) / 1000).alias("confidence"), F.when(F.col("observations") > 4, "yes").otherwise("no").alias("sure"))


def signed_payload(alerts: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """One JSON body for each batch of alerts and its keyed SHA-256 signature (HMAC)."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in alerts.columns if c != batch]))))
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.col("body").cast("binary")), 256))), 256)
    return alerts.groupBy(batch).agg(body.alias("body")).withColumn("signature", digest)
