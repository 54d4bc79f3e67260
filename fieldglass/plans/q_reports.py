"""Queries of reports, evaluation, fusion, components and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import fields, geo, plates
from fieldglass.operators import joins, paging, tables, voting, windows
from fieldglass.operators.components import components
from fieldglass.plans import views
from fieldglass.plans.q_fields import _grammar_sql, duck_distance
from fieldglass.plans.views import sql, table
from fieldglass.store import stored

HOUR = 3600 * 1_000_000
VEHICLES = ["car", "motorcycle", "truck", "bus"]


def _clock(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def camera_traffic(spark, sf_dir):
    """For each device and class of detections since a time: count, first, last, and distinct plates of the device."""
    d = views.detections(spark, sf_dir).filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
    by = d.groupBy("camera_id", "class_name").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    total = by.groupBy("camera_id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("class_name").isin(*VEHICLES), F.col("n"))), F.lit(0)).alias("vehicles"))
    seen = views.sightings(spark, sf_dir).groupBy("camera_id").agg(F.countDistinct("plate").alias("plates"))
    cams = views.cameras(spark, sf_dir).select("camera_id", "name", "department")
    return _clock(by.join(total, "camera_id").join(seen, "camera_id", "left").join(cams, "camera_id", "left"), "first", "last")


CAMERA_TRAFFIC = sql("""SELECT b.*, total, vehicles, plates, name, department FROM (SELECT camera_id, class_name, count(*) AS n, min(ts) AS first, max(ts) AS last FROM det WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL) b
    JOIN (SELECT camera_id, count(*) AS total, count(*) FILTER (class_name IN ('car','motorcycle','truck','bus')) AS vehicles FROM det WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL) t USING (camera_id)
    LEFT JOIN (SELECT camera_id, count(DISTINCT plate) AS plates FROM sighting GROUP BY ALL) p USING (camera_id) LEFT JOIN (SELECT camera_id, name, department FROM cam) c USING (camera_id)""")


def overview(spark, sf_dir):
    """Counts of devices by status and health, in one row."""
    c = views.cameras(spark, sf_dir)
    one = c.agg(F.count("*").alias("cameras"), F.count_if(F.col("installation_status") == "COMMISSIONED").alias("commissioned"), F.count_if(F.col("health_status") == "online").alias("online"), F.count_if(F.col("health_status") == "offline").alias("offline"), F.countDistinct("department").alias("departments"), F.max("installation_date").alias("newest"))
    return one.withColumn("bad_frames", views.footage(spark, sf_dir).agg(F.count("*")).scalar())


OVERVIEW = sql("""SELECT count(*) AS cameras, count(*) FILTER (installation_status = 'COMMISSIONED') AS commissioned, count(*) FILTER (health_status = 'online') AS online, count(*) FILTER (health_status = 'offline') AS offline,
    count(DISTINCT department) AS departments, max(installation_date) AS newest, (SELECT count(*) FROM quality) AS bad_frames FROM cam""")


def district_coverage(spark, sf_dir):
    """Districts with devices by health, by department, and whether coverage is thin."""
    c = views.cameras(spark, sf_dir)
    per = c.groupBy("district", "department").agg(F.count("*").alias("n"), *(F.count_if(F.col("health_status") == h).alias(h) for h in ("online", "offline", "degraded", "unavailable")))
    out = per.groupBy("district").agg(F.sum("n").alias("cameras"), *(F.sum(h).alias(h) for h in ("online", "offline", "degraded", "unavailable")), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "department", "n"))), ",").alias("departments"))
    return out.withColumn("thin", F.col("cameras") - F.col("unavailable") < 3)


DISTRICT_COVERAGE = sql("""SELECT district, CAST(sum(n) AS BIGINT) AS cameras, CAST(sum(online) AS BIGINT) AS online, CAST(sum(offline) AS BIGINT) AS offline, CAST(sum(degraded) AS BIGINT) AS degraded, CAST(sum(unavailable) AS BIGINT) AS unavailable,
    string_agg(department || '=' || n, ',' ORDER BY department || '=' || n) AS departments, sum(n) - sum(unavailable) < 3 AS thin FROM (SELECT district, department, count(*) AS n, count(*) FILTER (health_status = 'online') AS online,
    count(*) FILTER (health_status = 'offline') AS offline, count(*) FILTER (health_status = 'degraded') AS degraded, count(*) FILTER (health_status = 'unavailable') AS unavailable FROM cam GROUP BY ALL) GROUP BY district""")


def ageing(spark, sf_dir):
    """Devices of eight years or more, the oldest first."""
    age = fields.age_years(F.col("installation_date"), F.lit("2024-02-01").cast("date"))
    return views.cameras(spark, sf_dir).select("camera_id", age.alias("years")).filter("years >= 8").orderBy(F.desc("years"), "camera_id")


AGEING = sql("SELECT camera_id, years FROM (SELECT camera_id, round(date_diff('day', installation_date, DATE '2024-02-01') / CAST(365.25 AS DOUBLE), 2) AS years FROM cam) WHERE years >= 8")


def footage_quality(spark, sf_dir):
    """E5: bad frames of each device by kind, those flagged, the last of them, and whether an alert is open."""
    q = views.footage(spark, sf_dir)
    kinds = ["blackout", "corrupted", "blurred", "overexposed", "low_light"]
    pivot = q.groupBy("camera_id").pivot("quality", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    last = q.groupBy("camera_id").agg(F.max("ts").alias("last"))
    open_ = windows.bursts(q, ["camera_id", "quality"], 24 * HOUR, 5).select("camera_id").distinct().withColumn("open", F.lit(True))
    out = pivot.join(last, "camera_id").join(open_, "camera_id", "full").withColumn("open", F.coalesce("open", F.lit(False)))
    return _clock(out.withColumn("flagged", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))), "last")


FOOTAGE_QUALITY = sql("""SELECT camera_id, count(*) FILTER (quality = 'blackout') AS blackout, count(*) FILTER (quality = 'corrupted') AS corrupted, count(*) FILTER (quality = 'blurred') AS blurred, count(*) FILTER (quality = 'overexposed') AS overexposed, count(*) FILTER (quality = 'low_light') AS low_light,
    max(ts) AS last, camera_id IN (SELECT camera_id FROM (SELECT camera_id, count(*) OVER (PARTITION BY camera_id, quality ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM quality) WHERE n >= 5) AS open, count(*) AS flagged FROM quality GROUP BY camera_id""")


def plate_search(spark, sf_dir):
    """Distinct plates near a searched one with their readings, by distance and then number."""
    s = views.sightings(spark, sf_dir)
    d = plates.distance_within(F.col("plate"), F.lit("GJ08HX1259"))
    near = s.select("plate").distinct().withColumn("distance", d).filter("distance is not null")
    out = s.join(near, "plate").groupBy("plate", "distance").agg(F.count("*").alias("sightings"), F.countDistinct("camera_id").alias("cameras"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("confidence").alias("best"))
    out = out.orderBy("distance", F.desc("sightings"), "plate").limit(100)
    return _clock(out.withColumns({"distance": F.round("distance", 6), "best": F.round("best", 6)}), "first", "last")


PLATE_SEARCH = sql(
    """SELECT plate, round(d, 6) AS distance, count(*) AS sightings, count(DISTINCT camera_id) AS cameras, min(ts) AS first, max(ts) AS last, round(max(confidence), 6) AS best FROM sighting JOIN near USING (plate) GROUP BY plate, d ORDER BY d, sightings DESC, plate LIMIT 100""",
    near=f"SELECT * FROM (SELECT plate, {duck_distance('plate', chr(39) + 'GJ08HX1259' + chr(39))} AS d FROM (SELECT DISTINCT plate FROM sighting)) WHERE d <= 1.0",
)


def directory(spark, sf_dir):
    """For each department its devices, health, districts and statuses."""
    c = views.cameras(spark, sf_dir)
    return c.groupBy("department").agg(F.count("*").alias("cameras"), F.count_if(F.col("health_status") == "online").alias("online"), F.array_join(F.array_sort(F.collect_set("district")), ",").alias("districts"), F.array_join(F.array_sort(F.collect_set("installation_status")), ",").alias("statuses"), F.min_by("name", "camera_id").alias("first_name"))


DIRECTORY = sql("""SELECT department, count(*) AS cameras, count(*) FILTER (health_status = 'online') AS online, string_agg(DISTINCT district, ',' ORDER BY district) AS districts,
    string_agg(DISTINCT installation_status, ',' ORDER BY installation_status) AS statuses, arg_min(name, camera_id) AS first_name FROM cam GROUP BY department""")


def source_report(spark, sf_dir):
    """For each device its counts and its four commonest classes as one text."""
    d = views.detections(spark, sf_dir)
    counts = d.groupBy("camera_id", "class_name").agg(F.count("*").alias("n"))
    top = paging.best(counts, ["camera_id"], [F.desc("n"), F.col("class_name")], 4, "place")
    return top.groupBy("camera_id").agg(F.sum("n").alias("top_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "class_name", "n").alias("t")))), lambda x: x["t"]), ", ").alias("top"))


SOURCE_REPORT = sql("""SELECT camera_id, CAST(sum(n) AS BIGINT) AS top_n, string_agg(class_name || ':' || n, ', ' ORDER BY place) AS top FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, class_name) AS place
    FROM (SELECT camera_id, class_name, count(*) AS n FROM det GROUP BY ALL)) WHERE place <= 4 GROUP BY camera_id""")


def frames(spark, sf_dir):
    """Detections of one hour at a device as one frame with its classes in order."""
    d = views.detections(spark, sf_dir)
    return _clock(d.groupBy("camera_id", F.date_trunc("hour", "ts").alias("frame")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("detection_id", "class_name"))), lambda s: s["class_name"]), ",").alias("classes")), "frame")


FRAMES = sql("SELECT camera_id, date_trunc('hour', ts) AS frame, string_agg(class_name, ',' ORDER BY detection_id) AS classes FROM det GROUP BY ALL")


def percentiles(spark, sf_dir):
    """Exact percentiles, derived bands and shares of each class."""
    d = views.detections(spark, sf_dir)
    p = F.percentile("width_px", F.array(*(F.lit(x) for x in (0.05, 0.25, 0.5, 0.9, 0.99))))
    out = d.groupBy("class_name").agg(p.alias("p"), F.min("width_px").alias("least"), F.max("width_px").alias("most"), F.count("*").alias("n"), F.avg((F.col("width_px") >= 40).cast("double")).alias("share"))
    return out.select("class_name", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p90", "p99"))), "least", "most", "n", F.round("share", 6).alias("share"))


PERCENTILES = sql("""SELECT class_name, round(quantile_cont(width_px, 0.05), 4) AS p5, round(quantile_cont(width_px, 0.25), 4) AS p25, round(quantile_cont(width_px, 0.5), 4) AS p50, round(quantile_cont(width_px, 0.9), 4) AS p90, round(quantile_cont(width_px, 0.99), 4) AS p99,
    min(width_px) AS least, max(width_px) AS most, count(*) AS n, round(avg(CASE WHEN width_px >= 40 THEN 1.0 ELSE 0.0 END), 6) AS share FROM det GROUP BY class_name""")


def size_bands(spark, sf_dir):
    """The edges of five size bands of each group of tracks, from quantiles or, for few sizes, fixed."""
    d = views.detections(spark, sf_dir).groupBy("class_name", (F.col("track_id") % 40).alias("lane")).agg(fields.derived_bands(F.col("width_px")).alias("edges"), F.count_if(F.col("width_px") > 0).alias("sizes"))
    return d.select("class_name", "lane", "sizes", *(F.round(F.col("edges")[i], 4).alias(f"edge{i + 1}") for i in range(4)))


_CUT = ", ".join(f"quantile_cont(CAST(width_px AS DOUBLE), {q}) FILTER (width_px > 0) AS q{i + 1}" for i, q in enumerate(fields.BAND_SHARES))
SIZE_BANDS = sql(f"""SELECT class_name, lane, sizes, round(CASE WHEN sizes < 20 THEN 20 ELSE q1 END, 4) AS edge1, round(CASE WHEN sizes < 20 THEN 40 ELSE e2 END, 4) AS edge2, round(CASE WHEN sizes < 20 THEN 60 ELSE e3 END, 4) AS edge3, round(CASE WHEN sizes < 20 THEN 120 ELSE greatest(q4, e3 + 1) END, 4) AS edge4
    FROM (SELECT *, greatest(q3, e2 + 1) AS e3 FROM (SELECT *, greatest(q2, q1 + 1) AS e2 FROM (SELECT class_name, track_id % 40 AS lane, count(*) FILTER (width_px > 0) AS sizes, {_CUT} FROM det GROUP BY ALL)))""")


def track_traffic(spark, sf_dir):
    """Each track's displacement, growth and direction from first to last place."""
    d = views.detections(spark, sf_dir)
    o = F.struct("ts", "detection_id")
    out = d.groupBy("track_id").agg(F.min_by("width_px", o).alias("w0"), F.max_by("width_px", o).alias("w1"), F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return out.select("track_id", (F.col("w1") - F.col("w0")).alias("growth"), F.when(F.col("w1") > F.col("w0"), "approach").when(F.col("w1") < F.col("w0"), "recede").otherwise("still").alias("direction"), "n", F.round("c", 6).alias("confidence"))


TRACK_TRAFFIC = sql("""SELECT track_id, w1 - w0 AS growth, CASE WHEN w1 > w0 THEN 'approach' WHEN w1 < w0 THEN 'recede' ELSE 'still' END AS direction, n, round(c, 6) AS confidence FROM
    (SELECT track_id, arg_min(width_px, row(ts, detection_id)) AS w0, arg_max(width_px, row(ts, detection_id)) AS w1, count(*) AS n, avg(confidence) AS c FROM det GROUP BY track_id)""")


def clip_scores(spark, sf_dir):
    """Plates read right, wrong and missed by device, and for all devices together."""
    truth = views.plates(spark, sf_dir).select((F.col("user_id") % 10).alias("camera_id"), "plate", F.lit(1).alias("t"))
    read = views.sightings(spark, sf_dir).groupBy("camera_id", "plate").agg(F.count("*").alias("n")).filter("n >= 2").select("camera_id", "plate", F.lit(1).alias("r"))
    j = truth.join(read, ["camera_id", "plate"], "full")
    hit, wrong, missed = F.count_if(F.col("t").isNotNull() & F.col("r").isNotNull()), F.count_if(F.col("t").isNull()), F.count_if(F.col("r").isNull())
    return j.rollup("camera_id").agg(hit.alias("correct"), wrong.alias("wrong"), missed.alias("missed")).select(F.coalesce(F.col("camera_id").cast("string"), F.lit("all")).alias("camera"), "correct", "wrong", "missed")


CLIP_SCORES = sql("""SELECT coalesce(CAST(camera_id AS VARCHAR), 'all') AS camera, count(*) FILTER (t = 1 AND r = 1) AS correct, count(*) FILTER (t IS NULL) AS wrong, count(*) FILTER (r IS NULL) AS missed
    FROM (SELECT user_id % 10 AS camera_id, plate, 1 AS t FROM plate_of) FULL JOIN (SELECT camera_id, plate, 1 AS r FROM sighting GROUP BY ALL HAVING count(*) >= 2) USING (camera_id, plate) GROUP BY ROLLUP (camera_id)""")


def precision(spark, sf_dir):
    """Average precision by class of width, with the monotone envelope."""
    d = views.detections(spark, sf_dir)
    band = fields.banded(F.col("width_px"), [(40, "SMALL"), (120, "MEDIUM")], "LARGE")
    rows = d.select("detection_id", band.alias("band"), "confidence", ((F.col("detection_id") * 7) % 10 < F.col("confidence") * 10).alias("hit")).withColumnRenamed("detection_id", "id")
    out = windows.average_precision(rows, ["band"], "confidence", "hit", 2000)
    return out.select("band", F.round("ap", 6).alias("ap"), "hits", "predictions")


PRECISION = sql("""SELECT band, round(sum(CASE WHEN hit THEN env ELSE 0 END) / 2000, 6) AS ap, CAST(max(tp) AS BIGINT) AS hits, count(*) AS predictions FROM (SELECT *, max(tp / CAST(n AS DOUBLE)) OVER (PARTITION BY band ORDER BY confidence DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env
    FROM (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY band ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER (PARTITION BY band ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT detection_id AS id, CASE WHEN width_px < 40 THEN 'SMALL' WHEN width_px < 120 THEN 'MEDIUM' ELSE 'LARGE' END AS band, confidence, (detection_id * 7) % 10 < confidence * 10 AS hit FROM det))) GROUP BY band""")


def error_buckets(spark, sf_dir):
    """Outcomes by band and tag, splits that share blocks, and devices that miss plates."""
    d = views.detections(spark, sf_dir)
    band = fields.banded(F.col("width_px"), [(40, "SMALL"), (120, "MEDIUM")], "LARGE")
    outcome = F.when(F.col("confidence") > 0.6, "hit").when(F.col("confidence") > 0.3, "false").otherwise("miss")
    tags = fields.tags(night=F.hour("ts") < 6, far=F.col("width_px") < 60, person=F.col("class_name") == "person")
    return d.withColumn("tag", F.explode(tags)).withColumn("band", band).withColumn("o", outcome).groupBy("band", "tag").agg(*(F.count_if(F.col("o") == o).alias(o) for o in ("hit", "false", "miss")))


ERROR_BUCKETS = sql("""SELECT band, tag, count(*) FILTER (o = 'hit') AS hit, count(*) FILTER (o = 'false') AS false, count(*) FILTER (o = 'miss') AS miss FROM (SELECT CASE WHEN width_px < 40 THEN 'SMALL' WHEN width_px < 120 THEN 'MEDIUM' ELSE 'LARGE' END AS band,
    CASE WHEN confidence > 0.6 THEN 'hit' WHEN confidence > 0.3 THEN 'false' ELSE 'miss' END AS o, unnest(list_filter([CASE WHEN hour(ts) < 6 THEN 'night' END, CASE WHEN width_px < 60 THEN 'far' END, CASE WHEN class_name = 'person' THEN 'person' END], lambda x: x IS NOT NULL)) AS tag FROM det) GROUP BY ALL""")


def leakage(spark, sf_dir):
    """Blocks of a device whose rows are in more than one split."""
    d = views.detections(spark, sf_dir)
    split = F.when(F.col("detection_id") % 50 < 33, "train").when(F.col("detection_id") % 50 < 42, "val").otherwise("test")
    out = d.groupBy("camera_id", F.floor(F.col("detection_id") / 100).alias("block")).agg(F.array_sort(F.collect_set(split)).alias("s"))
    return out.filter(F.size("s") > 1).select("camera_id", "block", F.array_join("s", ",").alias("splits"))


LEAKAGE = sql("""SELECT camera_id, CAST(floor(detection_id / 100) AS BIGINT) AS block, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT *, CASE WHEN detection_id % 50 < 33 THEN 'train' WHEN detection_id % 50 < 42 THEN 'val' ELSE 'test' END AS s FROM det) GROUP BY ALL HAVING count(DISTINCT s) > 1""")


def missing_plates(spark, sf_dir):
    """Devices by the share of vehicles without a plate, of three vehicles or more."""
    d = views.detections(spark, sf_dir).filter(F.col("class_name").isin(*VEHICLES))
    v = d.groupBy("camera_id", "track_id").agg(F.max(F.col("width_px") >= 190).alias("plate"))
    out = v.groupBy("camera_id").agg(F.count("*").alias("vehicles"), F.count_if("plate").alias("plates")).filter("vehicles >= 3")
    return out.select("camera_id", "vehicles", F.round(1 - F.col("plates") / F.col("vehicles"), 6).alias("missing"))


MISSING_PLATES = sql("""SELECT camera_id, count(*) AS vehicles, round(1 - count(*) FILTER (p) / count(*), 6) AS missing FROM (SELECT camera_id, track_id, bool_or(width_px >= 190) AS p FROM det WHERE class_name IN ('car','motorcycle','truck','bus') GROUP BY ALL) GROUP BY camera_id HAVING count(*) >= 3""")


def day_numbers(spark, sf_dir):
    """A running, padded number for each row of a day."""
    d = views.detections(spark, sf_dir).withColumn("day", F.to_date("ts"))
    found = windows.numbered(d, ["day"], F.hour("ts") * 60 + F.minute("ts"), ["ts", "detection_id"], "n")
    return found.select("detection_id", F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("number"))


DAY_NUMBERS = sql("SELECT detection_id, strftime(ts, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, detection_id) AS VARCHAR), 5, '0') AS number FROM det")


def neighbour_frames(spark, sf_dir):
    """H5, H6, H3: picked frames with two neighbours to each side, once each, without groups that hold a doubtful box."""
    d = views.detections(spark, sf_dir)
    doubt = d.groupBy("camera_id", F.floor(F.col("detection_id") / 50).alias("g")).agg(F.bool_or(F.col("confidence") < 0.01).alias("doubt")).filter("not doubt")
    picks = d.filter("width_px >= 196").withColumn("g", F.floor(F.col("detection_id") / 50)).join(doubt, ["camera_id", "g"], "left_semi")
    return picks.select("camera_id", F.explode(F.sequence(F.col("detection_id") - 2, F.col("detection_id") + 2)).alias("frame")).distinct()


NEIGHBOUR_FRAMES = sql("""SELECT DISTINCT camera_id, unnest(range(detection_id - 2, detection_id + 3)) AS frame FROM det d WHERE width_px >= 196 AND NOT EXISTS (SELECT 1 FROM det e WHERE e.camera_id = d.camera_id AND floor(e.detection_id / 50) = floor(d.detection_id / 50) AND e.confidence < 0.01)""")


def ingest_verdicts(spark, sf_dir):
    """Rows of a batch with the code of the first rule that they break, replays counted once."""
    d = views.detections(spark, sf_dir)
    cams = views.cameras(spark, sf_dir).select("camera_id", "installation_status", "department")
    batch = d.withColumn("camera_id", F.when(F.col("detection_id") % 40 == 0, 99_999).otherwise(F.col("detection_id") % 100)).union(d.filter("detection_id % 25 = 0").withColumn("camera_id", F.col("detection_id") % 100))
    once = tables.latest(batch, ["detection_id"], ["camera_id"])
    j = once.join(cams, "camera_id", "left")
    rules = [("UNKNOWN_CAMERA", F.col("installation_status").isNull()), ("CAMERA_NOT_COMMISSIONED", F.col("installation_status") != "COMMISSIONED"), ("CAMERA_OUT_OF_SCOPE", F.col("department") == "AFRICA"), ("INVALID_TIMESTAMP", F.col("ts") > F.lit("2024-01-29 00:05:00").cast("timestamp"))]
    return tables.classified(j, rules).groupBy(F.coalesce("reject_code", F.lit("ACCEPTED")).alias("code")).agg(F.count("*").alias("n"), F.min("detection_id").alias("least"))


INGEST_VERDICTS = sql(
    """SELECT code, count(*) AS n, min(detection_id) AS least FROM (SELECT o.detection_id, CASE WHEN installation_status IS NULL THEN 'UNKNOWN_CAMERA' WHEN installation_status <> 'COMMISSIONED' THEN 'CAMERA_NOT_COMMISSIONED' WHEN department = 'AFRICA' THEN 'CAMERA_OUT_OF_SCOPE'
    WHEN ts > TIMESTAMP '2024-01-29 00:05:00' THEN 'INVALID_TIMESTAMP' ELSE 'ACCEPTED' END AS code FROM once o LEFT JOIN cam c ON c.camera_id = o.cid) GROUP BY code""",
    once="SELECT detection_id, ts, max(CASE WHEN detection_id % 40 = 0 THEN 99999 ELSE detection_id % 100 END) AS cid FROM det GROUP BY ALL",
)


def incidents_reopened(spark, sf_dir):
    """I4: incidents of a track, reopened under a suffixed id after two quiet days."""
    d = views.detections(spark, sf_dir).filter("class_name = 'person'").select("camera_id", "track_id", "ts")
    return _clock(tables.reopened(d, ["camera_id", "track_id"], 48 * HOUR, HOUR // 2), "first_seen", "last_seen")


INCIDENTS_REOPENED = sql("""SELECT camera_id, track_id, camera_id || '_' || track_id || CASE WHEN run > 0 THEN '_' || CAST(epoch_us(min(ts)) // 1800000000 AS VARCHAR) ELSE '' END AS incident_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM
    (SELECT *, sum(CASE WHEN gap > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id ORDER BY ts) AS run FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY camera_id, track_id ORDER BY ts) AS gap FROM det WHERE class_name = 'person')) GROUP BY camera_id, track_id, run""")


def flow(spark, sf_dir):
    """The mean direction of each region's last 300 votes, one for each track."""
    d = views.detections(spark, sf_dir).withColumn("region", F.col("width_px") % 12).withColumn("angle", F.radians(((F.col("detection_id") * 17) % 360).cast("double")))
    one = paging.best(d, ["region", "track_id"], [F.desc("ts"), F.desc("detection_id")], 1)
    last = paging.best(one, ["region"], [F.desc("ts"), F.desc("detection_id")], 300)
    return last.groupBy("region").agg(F.round(F.degrees(F.atan2(F.avg(F.sin("angle")), F.avg(F.cos("angle")))), 3).alias("heading"), F.count("*").alias("votes"))


FLOW = sql("""SELECT region, round(degrees(atan2(avg(sin(a)), avg(cos(a)))), 3) AS heading, count(*) AS votes FROM (SELECT * FROM (SELECT *, width_px % 12 AS region, radians(CAST((detection_id * 17) % 360 AS DOUBLE)) AS a FROM det
    QUALIFY row_number() OVER (PARTITION BY width_px % 12, track_id ORDER BY ts DESC, detection_id DESC) = 1) QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC, detection_id DESC) <= 300) GROUP BY region""")


def replays(spark, sf_dir):
    """Frames that repeat one of the same device within a day at nearly the same place."""
    d = views.detections(spark, sf_dir).select("detection_id", "camera_id", "class_name", F.unix_micros("ts").alias("us"), "width_px")
    # a frame looks for the last one before it of each width that is near enough: the row before it among those of that width
    near = d.withColumn("width", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.col("width_px") + k)))
    rows = d.select("camera_id", "class_name", F.col("width_px").alias("width"), "us", F.lit(0).alias("asks"), F.lit(None).cast("bigint").alias("detection_id"))
    both = rows.unionByName(near.select("camera_id", "class_name", "width", "us", F.lit(1).alias("asks"), "detection_id"))
    earlier = windows.W.partitionBy("camera_id", "class_name", "width").orderBy("us").rangeBetween(-24 * HOUR, -1)
    found = both.withColumn("last", F.max(F.when(F.col("asks") == 0, F.col("us"))).over(earlier))
    return found.filter("asks = 1 and last is not null").select(F.col("detection_id").alias("replay")).distinct()


REPLAYS = sql("""SELECT DISTINCT r.detection_id AS replay FROM det l JOIN det r ON l.camera_id = r.camera_id AND l.class_name = r.class_name AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 24 HOUR AND abs(l.width_px - r.width_px) <= 2""")


def sync_verdicts(spark, sf_dir):
    """What a sync makes of each device: created, updated, unchanged, conflict, stale."""
    c = views.cameras(spark, sf_dir).select("camera_id", "department", "health_status")
    old = c.filter("camera_id % 10 <> 1")
    new = c.filter("camera_id % 10 <> 2").withColumn("health_status", F.when(F.col("camera_id") % 3 == 0, "online").otherwise(F.col("health_status"))).withColumn("department", F.when(F.col("camera_id") % 17 == 0, "OTHER").otherwise(F.col("department")))
    return tables.verdicts(old, new, "camera_id", "department", ["health_status"])


SYNC_VERDICTS = sql("""SELECT camera_id, CASE WHEN camera_id % 10 = 1 THEN 'created' WHEN camera_id % 10 = 2 THEN 'stale' WHEN camera_id % 17 = 0 THEN 'conflict' WHEN camera_id % 3 = 0 AND health_status <> 'online' THEN 'updated' ELSE 'unchanged' END AS verdict FROM cam""")


def after_outage(spark, sf_dir):
    """The register after a source's outage and newer rows of some devices."""
    c = views.cameras(spark, sf_dir).select("camera_id", "department", "health_status", "installation_status")
    down = c.withColumn("health_status", F.when((F.col("department") == "ASIA") & (F.col("installation_status") == "COMMISSIONED"), "offline").otherwise(F.col("health_status")))
    newer = c.filter("camera_id % 9 = 0").withColumn("health_status", F.lit("online"))
    return tables.upserted(down, newer, ["camera_id"]).select("camera_id", "health_status")


AFTER_OUTAGE = sql("SELECT camera_id, CASE WHEN camera_id % 9 = 0 THEN 'online' WHEN department = 'ASIA' AND installation_status = 'COMMISSIONED' THEN 'offline' ELSE health_status END AS health_status FROM cam")


def outage_samples(spark, sf_dir):
    """The health samples of a source's outage, one for each device that isn't withdrawn, and the state after it."""
    c = views.cameras(spark, sf_dir).withColumn("installation_status", F.when(F.col("camera_id") % 11 == 4, "WITHDRAWN").otherwise(F.col("installation_status")))
    after, samples = tables.outage(c, "ASIA", "department", F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
    return after.select("camera_id", "health_status").join(samples.select("camera_id", "detail", "checked_at"), "camera_id", "left")


OUTAGE_SAMPLES = sql("""SELECT camera_id, CASE WHEN hit THEN 'offline' ELSE health_status END AS health_status, CASE WHEN hit THEN 'SOURCE_UNREACHABLE' END AS detail, CASE WHEN hit THEN TIMESTAMP '2024-01-31 12:00:00' END AS checked_at FROM (SELECT *, department = 'ASIA' AND camera_id % 11 <> 4 AS hit FROM cam)""")


def resources(spark, sf_dir):
    """Of each device's frames the latencies at half and at 95 in 100 (by index), the mean share of CPU and the most memory."""
    i = F.col("detection_id")
    d = views.detections(spark, sf_dir).select("camera_id", (F.col("confidence") * 1000).alias("ms"), (i * 31 % 100 / F.lit(100.0)).alias("cpu"), (i * 17 % 4096).alias("mb"))
    late = windows.at_shares(d, ["camera_id"], "ms", F.floor(F.col("ms") / 10), {"p50": 0.5, "p95": 0.95})
    used = d.groupBy("camera_id").agg(F.round(F.avg("cpu"), 6).alias("mean_cpu"), F.max("mb").alias("peak_mb"))
    return used.join(late, "camera_id").select("camera_id", F.round("p50", 6).alias("p50_ms"), F.round("p95", 6).alias("p95_ms"), "mean_cpu", "peak_mb")


RESOURCES = sql("""SELECT camera_id, round(ms[len(ms) // 2 + 1], 6) AS p50_ms, round(ms[CAST(floor(len(ms) * 0.95) AS INT) + 1], 6) AS p95_ms, round(cpu, 6) AS mean_cpu, mb AS peak_mb FROM (SELECT camera_id, list_sort(list(confidence * 1000)) AS ms, avg(detection_id * 31 % 100 / CAST(100 AS DOUBLE)) AS cpu, max(detection_id * 17 % 4096) AS mb FROM det GROUP BY camera_id)""")


def model_versions(spark, sf_dir):
    """Usage by model and the state of each entry by its last event."""
    o = table(spark, sf_dir, "orders")
    last = tables.latest(o.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    uses = o.groupBy("o_custkey").agg(F.count("*").alias("uses"), F.max("o_orderdate").alias("last_used"))
    return last.join(uses, "o_custkey").select("o_custkey", F.col("o_orderstatus").alias("state"), "uses", "last_used")


MODEL_VERSIONS = "SELECT o_custkey, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS state, count(*) AS uses, max(o_orderdate) AS last_used FROM orders GROUP BY o_custkey"


def policy_versions(spark, sf_dir):
    """The version of each policy entry, which rises when its value changes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return tables.versions(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_orderkey", "version")


POLICY_VERSIONS = """SELECT o_orderkey, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version FROM (SELECT *, CASE WHEN o_orderpriority = lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN 0 ELSE 1 END AS c FROM orders)"""


def vehicle_clusters(spark, sf_dir):
    """K1: readings of near plates within six hours of each other as one vehicle; those at two devices or more."""
    s = views.sightings(spark, sf_dir).withColumn("camera_id", F.col("sighting_id") % 100).select("sighting_id", "camera_id", "ts", "plate", "confidence")
    held = stored(joins.spells(s, "plate", 6 * 3600, "sighting_id"), "spells")
    near = joins.plate_pairs(s, s.select(F.col("plate").alias("watched"))).filter("plate < watched")
    near = stored(near.select("plate", F.col("watched").alias("other")), "near")
    roots = components(stored(joins.spell_links(held, near, "plate", 6 * 3600), "links"))
    named = held.join(roots, "node", "left").select("plate", "bucket", F.coalesce("root", "node").alias("root"))
    j = s.withColumn("bucket", joins.spell_of(6 * 3600)).join(named, ["plate", "bucket"])
    out = j.groupBy("root").agg(F.countDistinct("camera_id").alias("cameras"), F.count("*").alias("readings"), F.max("confidence").alias("best"), F.max_by("plate", F.struct("confidence", "sighting_id")).alias("plate"))
    return out.filter("cameras > 1").select(F.col("root").alias("vehicle"), "cameras", "readings", F.round("best", 6).alias("best"), "plate")


VEHICLE_CLUSTERS = sql(
    """SELECT vehicle, count(DISTINCT camera_id) AS cameras, count(*) AS readings, round(max(confidence), 6) AS best, arg_max(plate, row(confidence, sighting_id)) AS plate FROM (SELECT n AS sighting_id, min(r) AS vehicle FROM reach GROUP BY n) JOIN
    (SELECT sighting_id, sighting_id % 100 AS camera_id, plate, confidence FROM sighting) USING (sighting_id) GROUP BY vehicle HAVING count(DISTINCT camera_id) > 1""",
    edge=f"SELECT l.sighting_id AS a, r.sighting_id AS b FROM sighting l JOIN sighting r ON l.sighting_id <> r.sighting_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 21600000000 AND levenshtein(l.plate, r.plate) <= 2 AND {duck_distance('l.plate', 'r.plate')} <= 1.0",
    reach="SELECT a AS n, a AS r FROM edge UNION SELECT b, r FROM reach JOIN edge ON a = n",
)


def votes(spark, sf_dir):
    """The winning text of each track, its share, confidence, alternates and support."""
    s = views.sightings(spark, sf_dir)
    won = voting.string_vote(s, ["track_id"], "plate", "confidence", "sighting_id")
    sup = voting.support(s, won, ["track_id"], "plate", "observations")
    return won.join(sup, "track_id").select("track_id", "text", "crops", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"), "won", "alternates", "exact_sources", "near_sources")


VOTES = sql(
    """SELECT t.track_id, text, crops, round(share, 6) AS share, round(share * strength, 6) AS confidence, crops >= 2 AS won, coalesce(alternates, '') AS alternates, exact_sources, near_sources FROM
    (SELECT track_id, plate AS text, crops, share, 1 - pow(1 - least(p, 1.0), n) AS strength FROM ranked WHERE place = 1) t LEFT JOIN (SELECT track_id, string_agg(plate, ',' ORDER BY place) AS alternates FROM ranked WHERE place BETWEEN 2 AND 4 GROUP BY track_id) a USING (track_id)
    JOIN (SELECT s.track_id, count(DISTINCT s.observations) FILTER (s.plate = r.plate) AS exact_sources, count(DISTINCT s.observations) FILTER (levenshtein(s.plate, r.plate) <= 1) AS near_sources FROM sighting s JOIN ranked r ON r.track_id = s.track_id AND r.place = 1 GROUP BY s.track_id) u USING (track_id)""",
    ranked="SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, plate) AS place, w / sum(w) OVER (PARTITION BY track_id) AS share FROM (SELECT track_id, plate, sum(confidence) AS w, count(DISTINCT sighting_id) AS crops, avg(confidence) AS p, count(*) AS n FROM sighting GROUP BY ALL)",
)


def _misread(spark, sf_dir):
    """Readings of tracks, some of them with a glyph too many, one or two too few, or one confused."""
    i, p = F.col("sighting_id"), F.col("plate")
    other = F.char((65 + i % 26).cast("int"))
    text = F.when(i % 7 == 0, F.concat(F.substring(p, 1, 4), other, F.expr("substr(plate, 5)"))).when(i % 7 == 1, F.concat(F.substring(p, 1, 2), F.expr("substr(plate, 4)")))
    text = text.when(i % 7 == 2, F.concat(F.substring(p, 2, 3), F.expr("substr(plate, 6)"))).when(i % 7 == 3, F.concat(F.substring(p, 1, 4), other, F.expr("substr(plate, 6)"))).otherwise(p)
    return views.sightings(spark, sf_dir).withColumn("plate", text)


MISREAD = """SELECT sighting_id, track_id, confidence, observations, CASE sighting_id % 7 WHEN 0 THEN substr(plate, 1, 4) || chr(CAST(65 + sighting_id % 26 AS INT)) || substr(plate, 5) WHEN 1 THEN substr(plate, 1, 2) || substr(plate, 4)
    WHEN 2 THEN substr(plate, 2, 3) || substr(plate, 6) WHEN 3 THEN substr(plate, 1, 4) || chr(CAST(65 + sighting_id % 26 AS INT)) || substr(plate, 6) ELSE plate END AS plate FROM sighting"""


def fused(spark, sf_dir):
    """L1: the vote of each track's readings, aligned and under the likeliest layout, with agreement, prior, confidence and alternates."""
    found = voting.fused_reads(_misread(spark, sf_dir), "track_id", "plate", "confidence", F.col("observations") % 2 == 0)
    return found.select("track_id", "fused", *(F.round(c, 6).alias(c) for c in ("share", "agreement", "prior", "confidence")), "supported", "sr_disagree", "alternates")


_SLOTS = ", ".join(f"({len(template)}, '{name}', {weight}, {i}, '{slot}')" for name, template, weight in plates.LAYOUTS for i, slot in enumerate(template, 1))
FUSED = sql(
    """SELECT track_id, fused, round(share, 6) AS share, round(agreement, 6) AS agreement, round(prior, 6) AS prior, supported, sr_disagree, coalesce(alternates, '') AS alternates,
    round(share * (0.5 + 0.5 * prior) * agreement * (CASE WHEN sr_disagree THEN 0.6 ELSE 1.0 END), 6) AS confidence FROM won
    JOIN (SELECT track_id, sum(CASE WHEN e <= 1 THEN w ELSE 0 END) / sum(w) AS agreement, bool_or(e = 0) AS supported, string_agg(CASE WHEN place <= 3 AND e BETWEEN 1 AND 2 THEN plate END, ',' ORDER BY place) AS alternates FROM near GROUP BY track_id) USING (track_id)
    JOIN (SELECT track_id, count(DISTINCT t) > 1 AS sr_disagree FROM (SELECT track_id, sr, arg_max(plate, row(w, plate)) AS t FROM (SELECT track_id, plate, observations % 2 = 0 AS sr, sum(confidence) AS w FROM misread GROUP BY ALL) GROUP BY ALL) GROUP BY track_id) USING (track_id)""",
    misread=MISREAD,
    txt="SELECT track_id, plate, sum(confidence) AS w, max(confidence) AS top FROM misread GROUP BY ALL",
    anc="SELECT track_id, n, arg_min(plate, row(-top, plate)) AS anchor FROM txt JOIN (SELECT track_id, arg_max(n, row(w, n)) AS n FROM (SELECT track_id, length(plate) AS n, sum(w) AS w FROM txt GROUP BY ALL) GROUP BY track_id) USING (track_id) WHERE length(plate) = n GROUP BY ALL",
    steps="""SELECT DISTINCT anchor AS a, plate AS t, length(anchor) AS i, length(plate) AS j, CAST([] AS VARCHAR[]) AS glyphs FROM anc JOIN txt USING (track_id) UNION ALL
      SELECT a, t, CASE WHEN across OR missing THEN i - 1 ELSE i END, CASE WHEN across OR NOT missing THEN j - 1 ELSE j END, CASE WHEN across THEN list_prepend(t[j], glyphs) WHEN missing THEN list_prepend(NULL, glyphs) ELSE glyphs END FROM
      (SELECT *, j = 0 OR levenshtein(a[:i], t[:j]) = levenshtein(CASE WHEN i = 1 THEN '' ELSE a[:i - 1] END, t[:j]) + 1 AS missing FROM (SELECT *, j > 0 AND levenshtein(a[:i], t[:j]) = levenshtein(CASE WHEN i = 1 THEN '' ELSE a[:i - 1] END, CASE WHEN j <= 1 THEN '' ELSE t[:j - 1] END) + CAST(a[i] <> t[j] AS INT) AS across FROM steps WHERE i > 0))""",
    vote="SELECT *, w / sum(w) OVER (PARTITION BY track_id, i) AS share FROM (SELECT track_id, n, i, g, sum(w) AS w FROM (SELECT track_id, n, w, unnest(glyphs) AS g, unnest(range(1, n + 1)) AS i FROM anc JOIN txt USING (track_id) JOIN (SELECT * FROM steps WHERE i = 0) s ON s.a = anchor AND s.t = plate) WHERE g IS NOT NULL GROUP BY ALL)",
    slot=f"SELECT * FROM (VALUES {_SLOTS}) v(n, layout, weight, i, slot)",
    made="SELECT track_id, layout, weight, string_agg(g, '' ORDER BY i) AS text, avg(share) AS share FROM (SELECT track_id, v.n, layout, CAST(weight AS DOUBLE) AS weight, v.i, arg_min(g, row(-w, g)) AS g, arg_min(share, row(-w, g)) AS share FROM vote v JOIN slot s ON s.n = v.n AND s.i = v.i AND CASE slot WHEN 'A' THEN g BETWEEN 'A' AND 'Z' WHEN 'D' THEN g BETWEEN '0' AND '9' ELSE g = upper(slot) END GROUP BY ALL) GROUP BY track_id, layout, weight, n HAVING count(*) = n",
    plain="SELECT track_id, string_agg(g, '' ORDER BY i) AS text, avg(share) AS share FROM (SELECT track_id, i, arg_min(g, row(-w, g)) AS g, arg_min(share, row(-w, g)) AS share FROM vote GROUP BY ALL) GROUP BY track_id",
    p="SELECT text AS plate FROM made UNION SELECT text FROM plain",
    scored=_grammar_sql(),
    prior_of="SELECT p.plate AS text, coalesce(max(prior), 0) AS prior FROM p LEFT JOIN scored s ON s.plate = p.plate GROUP BY ALL",
    won="""SELECT track_id, b.text AS fused, b.share AS share, b.prior AS prior FROM (SELECT track_id, arg_max({'text': text, 'share': share, 'prior': prior}, row(share * pow(greatest(prior, 0.001), 0.3), weight, layout)) AS b FROM made JOIN prior_of USING (text) GROUP BY track_id
      UNION ALL SELECT track_id, {'text': text, 'share': share, 'prior': prior} FROM plain JOIN prior_of USING (text) WHERE track_id NOT IN (SELECT track_id FROM made))""",
    near="SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY e > 2 OR e = 0, w DESC, plate) AS place FROM (SELECT track_id, plate, w, levenshtein(plate, fused) AS e FROM txt JOIN won USING (track_id))",
)


#: Three readers of two kinds on each sighting; by track they agree, differ by a glyph, scatter, or see nothing.
READERS = """SELECT track_id, sighting_id div 2 AS crop, confidence AS w, reader, CASE WHEN reader = 'whole' THEN 'text' ELSE 'glyphs' END AS kind, CASE reader
    WHEN 'first' THEN CASE WHEN track_id % 7 IN (0, 4, 6) THEN plate WHEN track_id % 7 = 1 THEN next ELSE astray END
    WHEN 'second' THEN CASE WHEN track_id % 7 IN (0, 1, 2, 3, 6) THEN plate ELSE astray END
    ELSE CASE WHEN track_id % 7 IN (0, 4) AND sighting_id % 2 = 0 OR track_id % 7 = 2 AND sighting_id % 5 = 0 THEN plate WHEN track_id % 7 = 3 AND sighting_id % 7 = 0 THEN next WHEN track_id % 7 = 5 AND sighting_id % 4 = 0 THEN plate END END AS text
    FROM (SELECT s.sighting_id, s.track_id, s.confidence, p.plate, concat(substr(p.plate, 1, 9), CAST((CAST(substr(p.plate, 10, 1) AS INT) + 1) % 10 AS STRING)) AS next, concat(substr(p.plate, 1, 6), CAST(1000 + s.sighting_id % 9000 AS STRING)) AS astray,
      unnest(['first', 'second', 'whole']) AS reader FROM sighting s JOIN plate_of p ON p.user_id = s.track_id)"""


def vote_picks(spark, sf_dir):
    """L3: what the readers of each track settle on, and by which rule."""
    text = READERS.replace("FROM sighting s", "FROM {s} s").replace("JOIN plate_of p", "JOIN {p} p").replace("unnest(['first', 'second', 'whole'])", "explode(array('first', 'second', 'whole'))")
    rows = spark.sql(text, s=views.sightings(spark, sf_dir), p=views.plates(spark, sf_dir))
    return voting.vote_pick(rows, "track_id", "text", "w", "crop", "reader", "kind", "first")


VOTE_PICKS = sql(
    """SELECT track_id, CASE WHEN x.t IS NOT NULL THEN x.t WHEN m.text IS NOT NULL THEN m.text WHEN o.t IS NOT NULL THEN o.t WHEN f.text IS NULL OR f.text <> a.text THEN a.text ELSE f.text END AS text,
    CASE WHEN x.t IS NOT NULL THEN 'cross_reader' WHEN m.text IS NOT NULL THEN CASE WHEN m.opposed THEN 'contested' ELSE 'primary' END WHEN o.t IS NOT NULL THEN 'other_reader' WHEN f.text IS NULL OR f.text <> a.text THEN 'secondary' ELSE 'undecided' END AS rule
    FROM (SELECT track_id, arg_min(text, row(-w, text)) AS text FROM (SELECT track_id, text, sum(w) AS w FROM rd GROUP BY ALL) GROUP BY track_id) a LEFT JOIN crossed x USING (track_id) LEFT JOIN (SELECT * FROM judged WHERE reader = 'first') m USING (track_id)
    LEFT JOIN (SELECT track_id, arg_min(text, reader) AS t FROM judged WHERE reader <> 'first' AND backed AND NOT opposed GROUP BY track_id) o USING (track_id) LEFT JOIN (SELECT * FROM vote WHERE reader = 'first') f USING (track_id)""",
    rd=f"SELECT * FROM ({READERS.replace(' div ', ' // ').replace('AS STRING', 'AS VARCHAR')}) WHERE text IS NOT NULL",
    per="SELECT track_id, text, reader, kind, count(DISTINCT crop) AS n FROM rd GROUP BY ALL",
    tot="SELECT track_id, text, count(DISTINCT crop) AS n, (SELECT count(DISTINCT kind) FROM per WHERE per.track_id = rd.track_id AND per.text = rd.text AND per.n >= 2) AS kinds FROM rd GROUP BY track_id, text",
    vote="SELECT track_id, reader, kind, arg_min(text, row(-w, text)) AS text, arg_min(n, row(-w, text)) AS crops, max(w) / sum(w) AS share FROM (SELECT track_id, reader, kind, text, sum(w) AS w, count(DISTINCT crop) AS n FROM rd GROUP BY ALL) GROUP BY ALL",
    crossed="SELECT track_id, arg_min(text, row(-n, text)) AS t FROM tot t WHERE kinds >= 2 AND n >= 6 AND NOT EXISTS (SELECT 1 FROM tot u WHERE u.track_id = t.track_id AND u.text <> t.text AND u.n >= t.n AND levenshtein(u.text, t.text) <= 2) GROUP BY track_id",
    judged="""SELECT v.track_id, v.reader, v.text,
      NOT EXISTS (SELECT 1 FROM tot t WHERE t.track_id = v.track_id AND t.text = v.text AND t.kinds >= 2) AND EXISTS (SELECT 1 FROM vote o WHERE o.track_id = v.track_id AND o.reader <> v.reader AND o.crops >= 4 AND o.text <> v.text AND levenshtein(o.text, v.text) <= 2
        AND NOT (length(o.text) = length(v.text) - 1 AND levenshtein(o.text, v.text) = 1) AND NOT EXISTS (SELECT 1 FROM per p WHERE p.track_id = v.track_id AND p.reader = o.reader AND p.text = v.text AND p.n >= 4)) AS opposed,
      EXISTS (SELECT 1 FROM per p WHERE p.track_id = v.track_id AND p.text = v.text AND p.reader <> v.reader) OR (SELECT count(DISTINCT crop) FROM rd r WHERE r.track_id = v.track_id AND r.kind <> v.kind AND length(r.text) = length(v.text) AND levenshtein(r.text, v.text) = 1) >= 2 AS backed
      FROM vote v WHERE crops >= 4 AND share >= 0.3""",
)


def decisions(spark, sf_dir):
    """The first threshold that a reading misses, or its confirmation."""
    s = views.sightings(spark, sf_dir)
    reason = fields.first_reason(too_few=F.col("observations") >= 2, unsure=F.col("confidence") >= 0.3, implausible=plates.is_plausible(F.col("plate")), short=F.length("plate") >= 8)
    return s.select("sighting_id", reason.isNull().alias("confirmed"), reason.alias("reason"))


DECISIONS = sql(
    f"""SELECT sighting_id, reason IS NULL AS confirmed, reason FROM (SELECT sighting_id, CASE WHEN observations < 2 THEN 'too_few' WHEN confidence < 0.3 THEN 'unsure'
    WHEN NOT (length(plate) BETWEEN 6 AND 11 AND (substr(plate,1,2) IN ({", ".join(f"'{x}'" for x in (*plates.STATE_CODES, *plates.SPECIAL_SERIES))}))) THEN 'implausible' WHEN length(plate) < 8 THEN 'short' END AS reason FROM sighting)"""
)

QUERIES = {f.__name__: f for f in (
    camera_traffic, overview, district_coverage, ageing, footage_quality, plate_search, directory, source_report, frames, percentiles, size_bands, track_traffic, clip_scores, precision, error_buckets,
    leakage, missing_plates, day_numbers, neighbour_frames, ingest_verdicts, incidents_reopened, flow, replays, sync_verdicts, after_outage, outage_samples, resources, model_versions, policy_versions,
    vehicle_clusters, votes, fused, vote_picks, decisions,
)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
