"""Queries of lists, pages, filters and access rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import fields
from fieldglass.operators import access, paging
from fieldglass.plans import views
from fieldglass.plans.views import sql

SINCE = "2024-01-10 00:00:00"
ASIA = access.Caller(department="ASIA", permissions=("plate:read",))
ALL = access.Caller(permissions=("plate:read", "track:read"))


def _since(df, column="ts"):
    return df.filter(F.col(column) >= F.lit(SINCE).cast("timestamp"))


def _clock(df, *columns):
    """Times as wall clocks without a zone, as the oracle has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns or ("ts",)})


def camera_list(spark, sf_dir):
    """Filtered devices, one page in order, with the total of all pages."""
    c = paging.where(views.cameras(spark, sf_dir), installation_status="COMMISSIONED", health_status=["online", "offline"])
    c = c.filter(paging.containing("supplier#0000000", "name", "camera_id"))
    return paging.page(c.select("camera_id", "name", "department", "health_status"), [F.col("department"), F.col("camera_id")], 5, 20)


CAMERA_LIST = sql("""SELECT camera_id, name, department, health_status, (SELECT count(*) FROM c) AS total FROM c ORDER BY department, camera_id LIMIT 20 OFFSET 5""",
    c="SELECT * FROM cam WHERE installation_status = 'COMMISSIONED' AND health_status IN ('online','offline') AND contains(lower(name), 'supplier#0000000')")


def detection_page(spark, sf_dir):
    """A page is cut before scope; what is out of scope goes, plates past retention are masked."""
    d = _since(views.detections(spark, sf_dir)).filter(F.col("confidence") >= 0.2)
    top = d.orderBy(F.desc("ts"), F.desc("detection_id")).offset(50).limit(200).join(views.plates(spark, sf_dir), F.col("track_id") == F.col("user_id"), "left")
    mine = access.readable(top, views.cameras(spark, sf_dir), access.Caller(department="ASIA"))
    fresh = F.col("ts") >= F.lit("2024-01-28").cast("timestamp")
    return _clock(access.masked(mine.select("detection_id", "camera_id", "ts", "class_name", "plate"), ["plate"], fresh, "withheld"))


DETECTION_PAGE = sql("""SELECT detection_id, camera_id, ts, class_name, CASE WHEN ts >= TIMESTAMP '2024-01-28' THEN plate END AS plate, NOT (ts >= TIMESTAMP '2024-01-28') AS withheld
    FROM (SELECT * FROM det WHERE ts >= TIMESTAMP '2024-01-10' AND confidence >= 0.2 ORDER BY ts DESC, detection_id DESC LIMIT 200 OFFSET 50) t LEFT JOIN plate_of ON track_id = user_id
    WHERE camera_id IN (SELECT camera_id FROM cam WHERE department = 'ASIA')""")


def camera_detections(spark, sf_dir):
    """The newest detections of one class at one device."""
    d = paging.where(_since(views.detections(spark, sf_dir)), camera_id=3, class_name="car")
    return _clock(d.orderBy(F.desc("ts"), F.desc("detection_id")).limit(100).select("detection_id", "ts", F.round("confidence", 6).alias("confidence")))


CAMERA_DETECTIONS = sql("SELECT detection_id, ts, round(confidence, 6) AS confidence FROM det WHERE camera_id = 3 AND class_name = 'car' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, detection_id DESC LIMIT 100")


def sighting_list(spark, sf_dir):
    """Readings in scope above a confidence floor, newest first, with the plate hidden past a horizon."""
    access.with_reason("monthly audit of readings")
    s = access.readable(views.sightings(spark, sf_dir), views.cameras(spark, sf_dir), ASIA)
    s = _since(s).filter(F.coalesce("confidence", F.lit(0.0)) >= 0.3)
    return _clock(s.orderBy(F.desc("ts"), F.desc("sighting_id")).limit(500).select("sighting_id", "camera_id", "ts", "plate"))


SIGHTING_LIST = sql("""SELECT sighting_id, camera_id, ts, plate FROM sighting WHERE camera_id IN (SELECT camera_id FROM cam WHERE department = 'ASIA')
    AND ts >= TIMESTAMP '2024-01-10' AND confidence >= 0.3 ORDER BY ts DESC, sighting_id DESC LIMIT 500""")


def event_list(spark, sf_dir):
    """Events of some kinds since a time, newest first, in the sources' words."""
    e = paging.where(_since(views.table(spark, sf_dir, "events")), event_type=["click", "purchase"])
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "ts", "event_type", (F.col("user_id") % 10).alias("camera_id"))


EVENT_LIST = "SELECT event_id, ts, event_type, user_id % 10 AS camera_id FROM events WHERE event_type IN ('click','purchase') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 300"


def audit_list(spark, sf_dir):
    """Acts of the own department or of none, by a text in any of their fields."""
    o = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    acts = o.select("o_orderkey", own.alias("department"), F.col("o_orderstatus").alias("outcome"), "o_orderpriority", "o_orderdate")
    acts = acts.filter((F.col("department").isNull() | (F.col("department") == "BUILDING")) & paging.containing("urgent", "o_orderpriority", "department"))
    return acts.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(10).limit(100).select("o_orderkey", "department", "outcome")


AUDIT_LIST = """SELECT o_orderkey, department, outcome FROM (SELECT o_orderkey, nullif(c_mktsegment,'MACHINERY') AS department, o_orderstatus AS outcome, o_orderpriority, o_orderdate
    FROM orders JOIN customer ON o_custkey = c_custkey) WHERE (department IS NULL OR department = 'BUILDING') AND (contains(lower(o_orderpriority),'urgent') OR contains(lower(coalesce(department,'')),'urgent'))
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 10"""


def vehicle_search(spark, sf_dir):
    """Register rows by part of a number or a make, ordered, with the total."""
    p = views.table(spark, sf_dir, "part")
    hit = F.col("p_partkey").cast("string").contains("12") | F.upper("p_type").like("%STEEL%")
    rows = paging.where(p.filter(hit & F.col("p_size").between(5, 30)), p_brand=[r"Brand#11", "Brand#12", "Brand#23", "Brand#34"])
    return paging.page(rows.select("p_partkey", "p_name", "p_brand", "p_size"), [F.col("p_name"), F.col("p_partkey")], 0, 50)


VEHICLE_SEARCH = """WITH v AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE (contains(CAST(p_partkey AS VARCHAR),'12') OR upper(p_type) LIKE '%STEEL%') AND p_size BETWEEN 5 AND 30
    AND p_brand IN ('Brand#11','Brand#12','Brand#23','Brand#34')) SELECT *, (SELECT count(*) FROM v) AS total FROM v ORDER BY p_name, p_partkey LIMIT 50"""


def watch_entries(spark, sf_dir):
    """Listed plates with the number of exact readings of each, none as 0."""
    counts = views.sightings(spark, sf_dir).groupBy("plate").agg(F.count("*").alias("n"))
    return paging.where(views.watch_list(spark, sf_dir), category=["stolen", "wanted", "missing"]).join(counts, "plate", "left").select("plate", "category", F.coalesce("n", F.lit(0)).alias("alerts"))


WATCH_ENTRIES = sql("""SELECT w.plate, w.category, coalesce(n, 0) AS alerts FROM watch w LEFT JOIN (SELECT plate, count(*) AS n FROM sighting GROUP BY plate) s USING (plate) WHERE category IN ('stolen','wanted','missing')""")


def request_list(spark, sf_dir):
    """Rows of a live source and of the mirror for a source that is out, newest first."""
    o = views.table(spark, sf_dir, "orders")
    live = o.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_orderstatus", "o_orderdate", F.lit("live").alias("origin"))
    mirror = o.filter(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_orderstatus", "o_orderdate", F.lit("mirror").alias("origin"))
    return paging.where(live.unionByName(mirror), o_orderstatus="F").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)


REQUEST_LIST = """SELECT o_orderkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'mirror' END AS origin FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200"""


def grants(spark, sf_dir):
    """Grants that are the caller's or theirs to give, active or not, and the decision ladder."""
    o = views.table(spark, sf_dir, "orders")
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    mine = (F.col("o_custkey") % 5 == 0) | (F.col("o_orderpriority") == "1-URGENT")
    active = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate").isNull() | (F.col("o_orderdate") > now))
    gates = [(F.col("o_orderstatus") != "P", "PENDING"), (F.col("o_orderdate") > now, "EXPIRED"), (F.col("o_totalprice") > 50000, "NO_CAPABILITY")]
    return o.filter(mine).select("o_orderkey", active.alias("active"), access.decided(gates).alias("decision"))


GRANTS = """SELECT o_orderkey, o_orderstatus = 'F' AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1997-01-01') AS active,
    CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN NOT (o_orderdate > TIMESTAMP '1997-01-01') THEN 'EXPIRED' WHEN NOT (o_totalprice > 50000) THEN 'NO_CAPABILITY' ELSE 'ALLOWED' END AS decision
    FROM orders WHERE o_custkey % 5 = 0 OR o_orderpriority = '1-URGENT'"""


def health_alert_list(spark, sf_dir):
    """Open alerts first, then the newest."""
    o = views.table(spark, sf_dir, "orders")
    open_ = F.col("o_orderstatus") == "O"
    return o.select("o_orderkey", open_.alias("open"), "o_orderdate").orderBy(F.desc("open"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(150)


HEALTH_ALERT_LIST = "SELECT o_orderkey, o_orderstatus = 'O' AS open, o_orderdate FROM orders ORDER BY open DESC, o_orderdate DESC, o_orderkey DESC LIMIT 150"


def form_errors(spark, sf_dir):
    """Rows that a form or schema check refuses, with all their errors."""
    d = views.detections(spark, sf_dir)
    errors = fields.tags(unknown_class=~F.col("class_name").isin("car", "motorcycle", "truck", "bus"), low_confidence=F.col("confidence") < 0.05, no_width=F.col("width_px") <= 0, odd_time=F.hour("ts") == 3)
    return d.select("detection_id", F.array_join(errors, ",").alias("errors")).filter(F.col("errors") != "")


FORM_ERRORS = sql("""SELECT * FROM (SELECT detection_id, array_to_string(list_filter([CASE WHEN class_name NOT IN ('car','motorcycle','truck','bus') THEN 'unknown_class' END,
    CASE WHEN confidence < 0.05 THEN 'low_confidence' END, CASE WHEN width_px <= 0 THEN 'no_width' END, CASE WHEN hour(ts) = 3 THEN 'odd_time' END], lambda x: x IS NOT NULL), ',') AS errors FROM det) WHERE errors <> ''""")


def redaction(spark, sf_dir):
    """M3: columns by visibility level, capped for other departments."""
    c = views.cameras(spark, sf_dir)
    level = F.when(F.col("department") == "ASIA", "FULL").when(F.col("installation_status") == "COMMISSIONED", "STANDARD").otherwise("LIMITED")
    shown = {"FULL": ["name", "latitude", "longitude", "health_status"], "STANDARD": ["name", "health_status"], "LIMITED": ["name"]}
    return access.redacted(c.withColumn("level", level), F.col("level"), shown, ["name", "latitude", "longitude", "health_status"]).select("camera_id", "level", "name", "latitude", "longitude", "health_status")


REDACTION = sql("""SELECT camera_id, level, name, CASE WHEN level = 'FULL' THEN latitude END AS latitude, CASE WHEN level = 'FULL' THEN longitude END AS longitude,
    CASE WHEN level <> 'LIMITED' THEN health_status END AS health_status FROM (SELECT *, CASE WHEN department = 'ASIA' THEN 'FULL' WHEN installation_status = 'COMMISSIONED' THEN 'STANDARD' ELSE 'LIMITED' END AS level FROM cam)""")


def ranked_tags(spark, sf_dir):
    """The best rows of each tag by the tag's own key and direction, tags merged for each row."""
    d = views.detections(spark, sf_dir)
    w, p = F.col("width_px"), F.col("confidence")
    marks = fields.tags(tiny=w < 40, wide=w > 160, unsure=p < 0.2)
    key = F.when(F.col("tag") == "wide", -w).when(F.col("tag") == "tiny", w).otherwise(p * 1000)
    picked = paging.best(d.withColumn("tag", F.explode(marks)), ["tag"], [key.asc(), F.col("detection_id")], 25)
    return picked.groupBy("detection_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), "|").alias("tags"))


RANKED_TAGS = sql("""SELECT detection_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (SELECT * FROM (
    SELECT detection_id, 'tiny' AS tag, width_px AS k FROM det WHERE width_px < 40 UNION ALL SELECT detection_id, 'wide', -width_px FROM det WHERE width_px > 160
    UNION ALL SELECT detection_id, 'unsure', confidence * 1000 FROM det WHERE confidence < 0.2) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY k, detection_id) <= 25) GROUP BY detection_id""")


def crop_bank(spark, sf_dir):
    """The best 8 readings of each track by a weighted score."""
    score = F.col("confidence") * (0.4 + 0.6 * F.least(F.lit(1.0), F.col("width_px") / F.lit(200.0)))
    kept = paging.best(views.detections(spark, sf_dir).withColumn("score", score), ["track_id"], [F.desc("score"), F.col("detection_id")], 8, "place")
    return kept.select("track_id", "place", "detection_id", F.round("score", 6).alias("score"))


CROP_BANK = sql("""SELECT track_id, place, detection_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, detection_id) AS place
    FROM (SELECT *, confidence * (0.4 + 0.6 * least(1.0, width_px / CAST(200 AS DOUBLE))) AS score FROM det)) WHERE place <= 8""")

QUERIES = {
    "camera_list": camera_list, "detection_page": detection_page, "camera_detections": camera_detections, "sighting_list": sighting_list, "event_list": event_list,
    "audit_list": audit_list, "vehicle_search": vehicle_search, "watch_entries": watch_entries, "request_list": request_list, "grants": grants,
    "health_alert_list": health_alert_list, "form_errors": form_errors, "redaction": redaction, "ranked_tags": ranked_tags, "crop_bank": crop_bank,
}
ORACLES = {
    "camera_list": CAMERA_LIST, "detection_page": DETECTION_PAGE, "camera_detections": CAMERA_DETECTIONS, "sighting_list": SIGHTING_LIST, "event_list": EVENT_LIST,
    "audit_list": AUDIT_LIST, "vehicle_search": VEHICLE_SEARCH, "watch_entries": WATCH_ENTRIES, "request_list": REQUEST_LIST, "grants": GRANTS,
    "health_alert_list": HEALTH_ALERT_LIST, "form_errors": FORM_ERRORS, "redaction": REDACTION, "ranked_tags": RANKED_TAGS, "crop_bank": CROP_BANK,
}
