"""Queries of records that people change: lists, pursuits, alerts, archives, audits, filled times and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import fields, plates
from fieldglass.operators import access, joins, tables
from fieldglass.operators.components import components
from fieldglass.plans import views
from fieldglass.plans.q_fields import STATES, _grammar_sql, duck_distance
from fieldglass.plans.views import sql, table
from fieldglass.sources import registers
from fieldglass.store import new_path, stored


def _acts(spark, sf_dir):
    """Acts on the entries of a list: O adds, F takes off, P is a possible sighting."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 997).alias("entry"), F.col("o_orderdate").alias("acted"), F.col("o_orderkey").alias("act"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("category"))


ACTS = "SELECT o_custkey % 997 AS entry, o_orderdate AS acted, o_orderkey AS act, o_orderstatus AS action, o_orderpriority AS category FROM orders"
BEFORE = """SELECT *, coalesce(last_value(CASE action WHEN 'O' THEN true WHEN 'F' THEN false END IGNORE NULLS) OVER w, false) AS active, coalesce(bool_or(action = 'O') OVER w, false) AS seen
    FROM acts WINDOW w AS (PARTITION BY entry ORDER BY acted, act ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
LIFE = """SELECT *, sum(CASE WHEN outcome IN ('created', 'reactivated') THEN 1 ELSE 0 END) OVER (PARTITION BY entry ORDER BY acted, act) AS spell FROM (SELECT *, CASE WHEN action = 'O' THEN CASE WHEN active THEN 'duplicate' WHEN seen THEN 'reactivated' ELSE 'created' END
    WHEN NOT active THEN 'refused' WHEN action = 'F' THEN 'ended' ELSE 'accepted' END AS outcome FROM before)"""
LIVES = {"acts": ACTS, "before": BEFORE, "life": LIFE}


def _lives(spark, sf_dir):
    return tables.life(_acts(spark, sf_dir), ["entry"], ["acted", "act"], "action", ["O"], ["F"])


def watch_changes(spark, sf_dir):
    """What became of each act: created, reactivated, duplicate, ended, accepted or refused."""
    return _lives(spark, sf_dir).select("act", "outcome", "spell")


WATCH_CHANGES = sql("SELECT act, outcome, CAST(spell AS BIGINT) AS spell FROM life", **LIVES)


def watch_standing(spark, sf_dir):
    """The list after all acts: since when an entry exists, whether it is active, and its category."""
    return tables.standing(_lives(spark, sf_dir), ["entry"], ["acted", "act"], ["category"])


WATCH_STANDING = sql(
    """SELECT entry, min(acted) FILTER (outcome = 'created') AS created, arg_max(outcome <> 'ended', row(acted, act)) FILTER (outcome IN ('created', 'reactivated', 'ended')) AS active,
    arg_max(category, row(acted, act)) FILTER (outcome IN ('created', 'reactivated')) AS category FROM life GROUP BY entry HAVING count(*) FILTER (outcome = 'created') > 0""",
    **LIVES,
)


def possible_sightings(spark, sf_dir):
    """Possible sightings of active pursuits, one for each pursuit, device and track, with their ids."""
    acts = _lives(spark, sf_dir).filter("action = 'P' and outcome = 'accepted'")
    seen = acts.select("entry", "spell", (F.col("act") % 10).alias("camera_id"), (F.col("act") % 3).alias("track")).distinct()
    return seen.select("entry", "spell", "camera_id", "track", F.concat(F.lit("poss_"), F.substring(F.sha1(F.concat_ws("_", F.lit("possible"), "entry", "spell", "camera_id", "track")), 1, 20)).alias("sighting_id"), F.lit(0.3).alias("confidence"))


POSSIBLE_SIGHTINGS = sql("SELECT DISTINCT entry, CAST(spell AS BIGINT) AS spell, act % 10 AS camera_id, act % 3 AS track, 'poss_' || substr(sha1('possible_' || entry || '_' || spell || '_' || (act % 10) || '_' || (act % 3)), 1, 20) AS sighting_id, CAST(0.3 AS DOUBLE) AS confidence FROM life WHERE action = 'P' AND outcome = 'accepted'", **LIVES)


def alert_states(spark, sf_dir):
    """Alerts with the first acknowledgement or dismissal, by whom and when, and later ones that change nothing."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") != "N")
    acts = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("acted"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", "acknowledged").otherwise("dismissed").alias("action"), F.col("l_suppkey").alias("who"))
    return tables.settled(table(spark, sf_dir, "orders").select("o_orderkey"), acts, ["o_orderkey"], ["acted", "line", "who"], "action", "who")


ALERT_STATES = """SELECT o_orderkey, state, actor, acted, coalesce(late, 0) AS late FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(CASE l_returnflag WHEN 'A' THEN 'acknowledged' ELSE 'dismissed' END, row(l_shipdate, l_linenumber, l_suppkey)) AS state,
    arg_min(l_suppkey, row(l_shipdate, l_linenumber, l_suppkey)) AS actor, arg_min(l_shipdate, row(l_shipdate, l_linenumber, l_suppkey)) AS acted, count(*) - 1 AS late FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def alert_list(spark, sf_dir):
    """Open alerts (those that nobody has acknowledged or dismissed) of a category since a time, the newest 400 of them cut before scope, with their priority."""
    settled = alert_states(spark, sf_dir).filter("state is not null").select(F.col("o_orderkey").alias("sighting_id"))
    s = views.sightings(spark, sf_dir).filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).join(settled, "sighting_id", "left_anti")
    w = views.watch_list(spark, sf_dir).filter(F.col("category").isin("stolen", "missing")).withColumnRenamed("plate", "watched")
    hits = joins.fuzzy_join(s.select("sighting_id", (F.col("sighting_id") % 100).alias("camera_id"), "ts", "plate"), w).orderBy(F.desc("ts"), F.desc("sighting_id"), "watched").limit(400)
    mine = access.readable(hits, views.cameras(spark, sf_dir), access.Caller(department="ASIA"))
    exact = F.col("distance") == 0
    return mine.select("sighting_id", "camera_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "watched", exact.alias("exact"), fields.priority(exact, F.col("category")).alias("priority"))


ALERT_LIST = sql(
    """SELECT sighting_id, sighting_id % 100 AS camera_id, ts, watched, d = 0 AS exact, CASE WHEN d <> 0 THEN 'review' WHEN category = 'stolen' THEN 'critical' ELSE 'high' END AS priority FROM
    (SELECT * FROM sighting JOIN near USING (plate) WHERE ts >= TIMESTAMP '2024-01-10' AND sighting_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N') ORDER BY ts DESC, sighting_id DESC, watched LIMIT 400) WHERE sighting_id % 100 IN (SELECT camera_id FROM cam WHERE department = 'ASIA')""",
    near=f"SELECT * FROM (SELECT s.plate, w.plate AS watched, category, {duck_distance('s.plate', 'w.plate')} AS d FROM (SELECT DISTINCT plate FROM sighting) s JOIN watch w ON category IN ('stolen', 'missing') AND levenshtein(s.plate, w.plate) <= 2) WHERE d <= 1.0",
)


def retention(spark, sf_dir):
    """Rows past retention go to the archive, all others stay; what both tables hold."""
    d = views.detections(spark, sf_dir)
    old = (F.col("ts") < F.lit("2024-01-08").cast("timestamp")) & F.col("class_name").rlike("^(car|bus)$")
    return tables.archived(d.select("detection_id", "camera_id", "ts", "class_name"), old, new_path(spark, "archive")).groupBy("part", "camera_id").agg(F.count("*").alias("n"), F.sum("detection_id").alias("ids"))


RETENTION = sql("SELECT CASE WHEN ts < TIMESTAMP '2024-01-08' AND class_name IN ('car','bus') THEN 'archived' ELSE 'kept' END AS part, camera_id, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM det GROUP BY ALL")


def audit_trail(spark, sf_dir):
    """One row for each act, refused ones too, appended in two turns."""
    acts, path = _lives(spark, sf_dir), new_path(spark, "audit")
    rows = acts.select("act", "entry", F.col("action"), F.when(F.col("outcome").isin("refused", "duplicate"), "denied").otherwise("success").alias("outcome"))
    tables.appended(rows.filter("act % 2 = 0"), path)
    return tables.appended(rows.filter("act % 2 <> 0"), path)


AUDIT_TRAIL = sql("SELECT act, entry, action, CASE WHEN outcome IN ('refused', 'duplicate') THEN 'denied' ELSE 'success' END AS outcome FROM life", **LIVES)


def filled_times(spark, sf_dir):
    """Readings without a video time get the nearest sample within 6 h where there is one now; others keep theirs."""
    q = views.footage(spark, sf_dir).select("camera_id", "ts", F.unix_micros("ts").alias("clock")).distinct()
    s = views.sightings(spark, sf_dir).select("sighting_id", "camera_id", "ts")
    known = s.filter("sighting_id % 3 <> 0").select("sighting_id", F.unix_micros("ts").alias("video_time"), F.lit(False).alias("filled"))
    found = joins.nearest(s.filter("sighting_id % 3 = 0"), q, "camera_id", "clock", 6 * 3600)
    return known.unionByName(found.select("sighting_id", F.col("clock").alias("video_time"), F.col("clock").isNotNull().alias("filled")))


FILLED_TIMES = sql("""SELECT sighting_id, CASE WHEN sighting_id % 3 <> 0 THEN epoch_us(ts) ELSE c END AS video_time, sighting_id % 3 = 0 AND c IS NOT NULL AS filled FROM sighting LEFT JOIN (SELECT s.sighting_id AS i, arg_min(epoch_us(q.ts), row(abs(epoch_us(q.ts) - epoch_us(s.ts)), q.ts)) AS c
    FROM sighting s JOIN quality q ON q.camera_id = s.camera_id AND abs(epoch_us(q.ts) - epoch_us(s.ts)) <= 21600000000 GROUP BY s.sighting_id) ON i = sighting_id""")


def graded_report(spark, sf_dir):
    """Readings of the plate report and those withheld, with the floor that they miss."""
    return registers.graded(views.sightings(spark, sf_dir)).select("sighting_id", "withheld")


GRADED_REPORT = sql(
    "SELECT sighting_id, CASE WHEN confidence < 0.10 THEN 'confidence' WHEN coalesce(prior, 0) < 0.12 THEN 'grammar' END AS withheld FROM sighting LEFT JOIN (SELECT plate, max(prior) AS prior FROM scored GROUP BY plate) USING (plate)",
    p="SELECT DISTINCT plate FROM sighting",
    scored=_grammar_sql(),
)


def report_lines(spark, sf_dir):
    """The Markdown table of readings, plates and vehicles of each device, written and read back as lines."""
    per = registers.graded(views.sightings(spark, sf_dir)).groupBy("camera_id").agg(F.count_if(F.col("withheld").isNull()).alias("readings"), F.count_if(F.col("withheld").isNotNull()).alias("withheld"), F.countDistinct("track_id").alias("vehicles"))
    path = new_path(spark, "report")
    registers.write_markdown(per, ["camera_id", "readings", "withheld", "vehicles"], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


REPORT_LINES = sql(
    """SELECT '| camera_id | readings | withheld | vehicles |' AS line UNION ALL SELECT '| --- | --- | --- | --- |' UNION ALL
    SELECT '| ' || camera_id || ' | ' || count(*) FILTER (confidence >= 0.10 AND coalesce(prior, 0) >= 0.12) || ' | ' || count(*) FILTER (confidence < 0.10 OR coalesce(prior, 0) < 0.12) || ' | ' || count(DISTINCT track_id) || ' |'
    FROM sighting LEFT JOIN (SELECT plate, max(prior) AS prior FROM scored GROUP BY plate) USING (plate) GROUP BY camera_id""",
    p="SELECT DISTINCT plate FROM sighting",
    scored=_grammar_sql(),
)


def ground_truth(spark, sf_dir):
    """Truth files of several devices with comment rows, read back."""
    path = new_path(spark, "truth")
    p = views.plates(spark, sf_dir).withColumn("camera", (F.col("user_id") % 5).cast("string"))
    registers.write_truth(p.select("camera", F.when(F.col("user_id") % 9 == 0, F.concat(F.lit("#"), F.col("user_id"))).otherwise(F.col("user_id").cast("string")).alias("vehicle"), "plate"), path)
    return registers.ground_truth(spark, path).select("camera", "vehicle", "plate")


GROUND_TRUTH = sql("SELECT CAST(user_id % 5 AS VARCHAR) AS camera, CAST(user_id AS VARCHAR) AS vehicle, plate FROM plate_of WHERE user_id % 9 <> 0")


def merged_vehicles(spark, sf_dir):
    """K3, K4: tracks with the same plate within 15 h or one edit apart within 3 h are one vehicle; its smallest track if it is sure enough."""
    s = views.sightings(spark, sf_dir)
    t = s.groupBy("camera_id", "track_id", F.col("plate")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("confidence").alias("best"), F.min("sighting_id").alias("record"))
    t = stored(t, "records")
    near = stored(joins.edit_join(t, t.select(F.col("plate").alias("watched")), 1), "near")
    a = t.join(near, "plate").select(F.col("camera_id").alias("c"), F.col("watched").alias("p"), "edits", F.struct("record", "first", "last").alias("a"))
    b = t.select(F.col("camera_id").alias("c"), F.col("plate").alias("p"), F.struct("record", "first", "last").alias("b"))
    gap = (F.greatest(F.unix_micros("a.first"), F.unix_micros("b.first")) - F.least(F.unix_micros("a.last"), F.unix_micros("b.last"))) / 3.6e9
    linked = a.join(b, ["c", "p"]).filter((F.col("a.record") < F.col("b.record")) & (gap <= F.when(F.col("edits") == 0, 15.0).otherwise(3.0)))
    roots = components(linked.select(F.col("a.record").alias("a"), F.col("b.record").alias("b")))
    whole = t.join(roots, F.col("record") == F.col("node"), "left").withColumn("vehicle", F.coalesce("root", "record"))
    out = whole.groupBy("vehicle").agg(F.min("track_id").alias("track_id"), F.max_by("plate", F.struct("best", "record")).alias("plate"), F.max("best").alias("best"), F.count("*").alias("records"))
    return out.filter((F.col("best") >= 0.3) & plates.is_plausible(F.col("plate"))).withColumn("best", F.round("best", 6))


MERGED_VEHICLES = sql(
    f"""SELECT vehicle, min(track_id) AS track_id, arg_max(plate, row(best, record)) AS plate, round(max(best), 6) AS best, count(*) AS records FROM (SELECT n, min(r) AS vehicle FROM reach GROUP BY n) JOIN rec ON n = record GROUP BY vehicle
    HAVING max(best) >= 0.3 AND length(arg_max(plate, row(best, record))) BETWEEN 6 AND 11 AND substr(arg_max(plate, row(best, record)), 1, 2) IN ({STATES})""",
    rec="SELECT camera_id, track_id, plate, min(ts) AS first, max(ts) AS last, max(confidence) AS best, min(sighting_id) AS record FROM sighting GROUP BY ALL",
    edge="SELECT a.record AS a, b.record AS b FROM rec a JOIN rec b ON a.camera_id = b.camera_id AND a.record <> b.record AND levenshtein(a.plate, b.plate) <= 1 AND (epoch_us(greatest(a.first, b.first)) - epoch_us(least(a.last, b.last))) / 3.6e9 <= CASE WHEN a.plate = b.plate THEN 15 ELSE 3 END",
    reach="SELECT record AS n, record AS r FROM rec UNION SELECT b, r FROM reach JOIN edge ON a = n",
)


QUERIES = {f.__name__: f for f in (watch_changes, watch_standing, possible_sightings, alert_states, alert_list, retention, audit_trail, filled_times, graded_report, report_lines, ground_truth, merged_vehicles)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
