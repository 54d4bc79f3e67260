"""Queries of the scalar functions: plates, places, times, identifiers and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import fields, geo, plates
from fieldglass.plans import views
from fieldglass.plans.views import sql

STATES = ", ".join(f"'{s}'" for s in plates.STATE_CODES)
SERIES = ", ".join(f"'{s}'" for s in plates.SPECIAL_SERIES)
PAIRS = ", ".join(f"'{x}'" for p in plates.CONFUSED for x in (p, p[::-1]))
REGION = ((21.0, 69.0), (23.5, 69.5), (24.0, 73.0), (21.5, 73.5))


def duck_distance(a: str, b: str) -> str:
    """The weighted edit distance of two cleaned plates in DuckDB."""
    cost = f"CASE WHEN substr({a}, CAST(i[1] AS INT), 1) = substr({b}, CAST(j[1] AS INT), 1) THEN 0.0 WHEN list_contains([{PAIRS}], substr({a}, CAST(i[1] AS INT), 1) || substr({b}, CAST(j[1] AS INT), 1)) THEN 0.35 ELSE 1.0 END"
    wrap = lambda n: f"list_transform(range(1, length({n}) + 1), lambda x: [CAST(x AS DOUBLE)])"
    cell = f"list_append(cur, least(prev[CAST(j[1] AS INT) + 1] + 0.5, cur[CAST(j[1] AS INT)] + 0.5, prev[CAST(j[1] AS INT)] + {cost}))"
    row = f"list_reduce({wrap(b)}, lambda cur, j: {cell}, [i[1] * 0.5])"
    first = f"list_transform(range(0, length({b}) + 1), lambda x: CAST(x AS DOUBLE) * 0.5)"
    table = f"list_reduce({wrap(a)}, lambda prev, i: {row}, {first})"
    return f"CASE WHEN {a} = {b} THEN 0.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN CAST(greatest(length({a}), length({b})) AS DOUBLE) ELSE ({table})[length({b}) + 1] END"


def _written(spark, sf_dir):
    """Plates as people write them: spaces, dashes, lower case, a country mark, nothing at all."""
    p, u = views.plates(spark, sf_dir), F.col("user_id")
    spaced = F.concat(F.substring("plate", 1, 2), F.lit(" "), F.expr("substr(plate, 3)"))
    raw = F.when(u % 6 == 0, F.concat(F.lit("IND "), spaced)).when(u % 6 == 1, F.lower("plate")).when(u % 6 == 2, F.concat(F.lit("21 bh "), F.expr("substr(plate, 7)"), F.lit("aa"))).when(u % 6 == 3, F.concat_ws("-", F.lit("ind"), "plate")).when(u % 6 == 4, F.substring("plate", 3, 8)).otherwise(F.lit(None))
    return p.select("user_id", raw.alias("raw"))


WRITTEN = "SELECT user_id, CASE user_id % 6 WHEN 0 THEN 'IND ' || substr(plate,1,2) || ' ' || substr(plate,3) WHEN 1 THEN lower(plate) WHEN 2 THEN '21 bh ' || substr(plate,7) || 'aa' WHEN 3 THEN 'ind-' || plate WHEN 4 THEN substr(plate,3,8) END AS raw FROM plate_of"


def plate_forms(spark, sf_dir):
    """Normalised forms, state and plausibility of written plates."""
    raw, c = F.col("raw"), F.col("cleaned")
    forms = _written(spark, sf_dir).select("user_id", plates.clean(raw).alias("cleaned"), plates.registry_form(raw).alias("registry"), plates.grammar_form(raw).alias("grammar"))
    return forms.select("user_id", "cleaned", "registry", "grammar", plates.state_of(c).alias("state"), plates.is_plausible(c).alias("plausible"))


PLATE_FORMS = sql(
    f"""SELECT *, length(cleaned) BETWEEN 6 AND 11 AND state IS NOT NULL AS plausible FROM (SELECT user_id, cleaned, registry, grammar,
    CASE WHEN substr(cleaned,1,2) IN ({STATES}, {SERIES}) THEN substr(cleaned,1,2)
    WHEN regexp_matches(cleaned, '^[0-9][0-9]..') AND substr(cleaned,3,2) IN ({SERIES}) THEN substr(cleaned,3,2) END AS state
    FROM (SELECT user_id, regexp_replace(g, '^IND', '') AS cleaned, g AS registry, g AS grammar
    FROM (SELECT user_id, regexp_replace(upper(coalesce(raw,'')), '[^A-Z0-9]', '', 'g') AS g FROM written)))""",
    written=WRITTEN,
)


def plate_distance(spark, sf_dir):
    """Weighted distance and similarity of every reading and watched plate that may match."""
    seen, watch = views.sightings(spark, sf_dir).select("plate").distinct(), views.watch_list(spark, sf_dir).select(F.col("plate").alias("watched"))
    a, b = F.col("plate"), F.col("watched")
    # an office's plates are dealt to 64 groups that each meet all of its watched ones, in a number of partitions that holds
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = seen.withColumns({"office": F.substring(a, 3, 2), "dealt": F.pmod(F.xxhash64(a), F.lit(64)).cast("int")}).repartition(parts, "office", "dealt")
    watch = watch.withColumns({"office": F.substring(b, 3, 2), "dealt": F.explode(F.sequence(F.lit(0), F.lit(63)))}).repartition(parts, "office", "dealt")
    near = seen.join(watch, ["office", "dealt"]).select("plate", "watched", plates.distances(a, b).alias("d"))
    return near.select("plate", "watched", F.round("d", 6).alias("distance"), F.round(plates.similarity(a, b, F.col("d")), 6).alias("similarity"))


PLATE_DISTANCE = sql(
    """SELECT plate, watched, round(d, 6) AS distance, round(greatest(0.0, 1 - d / greatest(length(plate), length(watched), 1)), 6) AS similarity
    FROM (SELECT s.plate, w.plate AS watched, """
    + duck_distance("s.plate", "w.plate")
    + """ AS d FROM (SELECT DISTINCT plate FROM sighting) s JOIN watch w ON substr(s.plate,3,2) = substr(w.plate,3,2))"""
)


def plate_origin(spark, sf_dir):
    """State and office of each reading, with the district where the office is in a checked list."""
    office = plates.rto_of(F.col("plate"))
    known = views.table(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("rto"), F.col("n_name").alias("district"))
    seen = views.sightings(spark, sf_dir).select("plate").distinct().select("plate", office["state"].alias("state"), office["rto"].alias("rto"))
    return seen.join(known, "rto", "left").select("plate", "state", "rto", F.when(F.col("state") == "GJ", F.col("district")).alias("district"), F.coalesce((F.col("state") == "GJ") & F.col("district").isNotNull(), F.lit(False)).alias("verified"))


PLATE_ORIGIN = sql("""SELECT plate, o.state, o.rto, CASE WHEN state = 'GJ' THEN n_name END AS district, coalesce(state = 'GJ' AND n_name IS NOT NULL, false) AS verified
    FROM (SELECT plate, CASE WHEN regexp_matches(plate, '^[A-Z]{2}\\s*[0-9]') THEN substr(plate,1,2) END AS state,
    CASE WHEN regexp_matches(plate, '^[A-Z]{2}\\s*[0-9]') THEN lpad(regexp_extract(plate, '^[A-Z]{2}\\s*([0-9]{1,2})', 1), 2, '0') END AS rto FROM (SELECT DISTINCT plate FROM sighting)) o
    LEFT JOIN nation ON lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') = o.rto""")


def plate_grammar(spark, sf_dir):
    """Layout, prior, reasons, coerced form and overlay test of each reading."""
    p = F.col("plate")
    score = F.col("score")
    return views.sightings(spark, sf_dir).select("plate").distinct().withColumn("score", plates.grammar(p)).select(
        "plate", F.round(score["prior"], 6).alias("prior"), score["layout"].alias("layout"), score["valid"].alias("valid"), F.array_join(score["reasons"], ",").alias("reasons"), plates.coerced(p).alias("coerced"), plates.looks_like_overlay(p).alias("overlay")
    )


def _grammar_sql() -> str:
    """A row for each plate and layout that it matches, by patterns; penalties as factors and names."""
    k = plates.PENALTIES
    outside = " OR ".join(f"(substr(plate,1,2) = '{s}' AND CAST(substr(plate,3,2) AS INT) NOT BETWEEN {lo} AND {hi})" for s, (lo, hi) in plates.DISTRICTS.items() if s != plates.HOME_STATE)
    office = f"substr(plate,1,2) = '{plates.HOME_STATE}' AND CAST(substr(plate,3,2) AS INT) NOT BETWEEN 1 AND {len(plates.HOME_OFFICES)}"
    rows = []
    for name, template, weight in plates.LAYOUTS:
        against = []
        if template.startswith("AAD"):
            against += [("unknown_state", f"substr(plate,1,2) NOT IN ({STATES})"), ("other_state", f"substr(plate,1,2) IN ({STATES}) AND substr(plate,1,2) <> 'GJ'")]
            if template.startswith("AADD"):
                against += [("unknown_office", office), ("district_out_of_range", outside), ("district_00", f"substr(plate,1,2) IN ({STATES}) AND substr(plate,3,2) = '00'")]
            if "A" in template[4:]:
                against.append(("rare_series_letter", "regexp_matches(regexp_replace(substr(plate,5,7), '[0-9]', '', 'g'), '[IO]')"))
        elif name == "bharat":
            against.append(("implausible_year", "substr(plate,1,2) NOT BETWEEN '19' AND '35'"))
        factors = "".join(f" * (CASE WHEN {c} THEN {k[r]} ELSE 1.0 END)" for r, c in against)
        names = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in against if r != "other_state") or "NULL"
        pattern = "".join({"A": "[A-Z]", "D": "[0-9]"}.get(c, c.upper()) for c in template)
        more = " AND substr(plate,1,2) = 'DL'" if name.startswith("dl_short") else ""
        rows.append(f"SELECT plate, CAST({weight} AS DOUBLE){factors} AS prior, '{name}' AS layout, concat_ws(',', {names}) AS reasons FROM p WHERE regexp_matches(plate, '^{pattern}$'){more}")
    return " UNION ALL ".join(rows)


def _coerced_sql() -> str:
    cases = lambda m, i: f"CASE substr(p.plate,{i},1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE substr(p.plate,{i},1) END"
    whole = lambda template: " || ".join(cases(plates.TO_LETTER if t == "A" else plates.TO_DIGIT, i + 1) for i, t in enumerate(template))
    return f"nullif(CASE length(p.plate) WHEN 10 THEN {whole('AADDAADDDD')} WHEN 9 THEN {whole('AADDADDDD')} END, p.plate)"


PLATE_GRAMMAR = sql(
    f"""SELECT p.plate, round(coalesce(b.prior, 0), 6) AS prior, b.layout, b.layout IS NOT NULL AS valid, coalesce(b.reasons, 'no_format_match') AS reasons, {_coerced_sql()} AS coerced,
    ({" OR ".join(f"contains(p.plate, '{w}')" for w in plates.OVERLAY_WORDS)}) OR regexp_matches(p.plate, '(AM|PM|HRS)$') OR regexp_matches(p.plate, '^[0-9]{{3,4}}(AM|PM)') OR regexp_matches(p.plate, '[0-9]{{8}}')
    OR (regexp_matches(p.plate, '^[0-9]{{6}}')) OR (regexp_matches(p.plate, '^[0-9]{{4}}') AND left(p.plate, 4) BETWEEN '2020' AND '2039') OR (regexp_matches(p.plate, '[0-9]{{4}}$') AND right(p.plate, 4) BETWEEN '2020' AND '2039')
    OR (length(regexp_replace(p.plate, '[^0-9]', '', 'g')) >= 6 AND regexp_matches(p.plate, '^[0-9][0-9]') AND substr(p.plate,3,2) <> 'BH') AS overlay
    FROM p LEFT JOIN (SELECT plate, prior, layout, reasons FROM scored QUALIFY row_number() OVER (PARTITION BY plate ORDER BY prior DESC, layout DESC) = 1) b ON p.plate = b.plate""",
    p="SELECT DISTINCT plate FROM sighting",
    scored=_grammar_sql(),
)


def partial_match(spark, sf_dir):
    """Readings that agree with a plate of which two glyphs can't be read."""
    truth = views.plates(spark, sf_dir).select(F.concat(F.substring("plate", 1, 4), F.lit("??"), F.substring("plate", 7, 4)).alias("partial"), F.substring("plate", 1, 4).alias("head"), F.substring("plate", 7, 4).alias("tail"))
    seen = views.sightings(spark, sf_dir).select("plate").distinct()
    joined = seen.join(truth, (F.substring("plate", 1, 4) == truth["head"]) & (F.substring("plate", 7, 4) == truth["tail"]))  # all glyphs that can be read
    return joined.filter(plates.matches_partial(F.col("plate"), F.col("partial"))).select("plate", "partial")


PARTIAL_MATCH = sql("""SELECT s.plate, t.partial FROM (SELECT DISTINCT plate FROM sighting) s JOIN (SELECT substr(plate,1,4) || '??' || substr(plate,7,4) AS partial FROM plate_of) t
    ON length(s.plate) = length(t.partial) AND s.plate LIKE replace(t.partial, '?', '_')""")


def scene_text(spark, sf_dir):
    """Readings that are a signboard's text, for the devices that see the sign."""
    signs = spark.createDataFrame([("3", "GJ03DVAB"), ("7", "GJ20")], "part string, sign string")
    seen = views.sightings(spark, sf_dir).select("camera_id", "plate").distinct()
    hit = F.col("camera_id").cast("string").contains(F.col("part")) & (F.substring("plate", 1, 2) == F.substring("sign", 1, 2)) & (F.levenshtein("plate", "sign", 3) >= 0)
    flagged = seen.join(F.broadcast(signs), hit, "left_semi").withColumn("sign_text", F.lit(True))
    return seen.join(flagged, ["camera_id", "plate"], "left").select("camera_id", "plate", F.coalesce("sign_text", F.lit(False)).alias("sign_text"))


SCENE_TEXT = sql("""SELECT DISTINCT camera_id, plate, EXISTS (SELECT 1 FROM (VALUES ('3','GJ03DVAB'), ('7','GJ20')) v(part, sign)
    WHERE contains(CAST(camera_id AS VARCHAR), part) AND substr(plate,1,2) = substr(sign,1,2) AND levenshtein(plate, sign) <= 3) AS sign_text FROM sighting""")


def register_fields(spark, sf_dir):
    """Ids, words, zones, masks, places and ages of register rows."""
    c, s = views.cameras(spark, sf_dir), F.col("camera_id").cast("string")
    zone = F.when(F.col("camera_id") % 3 == 0, F.concat("district", F.lit(" / "), "department")).when(F.col("camera_id") % 3 == 1, F.concat(F.lit("/ "), "district")).otherwise(F.lit(""))
    caps = F.array_compact(F.array(F.lit("metadata"), F.lit("health"), F.when(F.col("installation_status") == "COMMISSIONED", "live"), F.when(F.col("installation_status") == "COMMISSIONED", "playback")))
    return c.select(
        "camera_id",
        fields.device_id(F.lit("CAM"), F.upper(F.substring("department", 1, 3)), F.col("district"), F.concat(F.lit("src-"), s)).alias("device"),
        fields.folded(F.concat(F.lit(" "), F.upper("health_status")), fields.HEALTH_WORDS, "unknown").alias("health"),
        fields.joined_zone(zone).alias("zone"),
        F.array_join(caps, ",").alias("capabilities"),
        fields.host_of(F.concat(F.lit("rtsp://user:pw@10.0.0."), s, F.lit(":554/live?x=1"))).alias("host"),
        fields.masked_number(F.concat(F.lit("+91 98765-"), F.lpad(s, 5, "0"))).alias("phone"),
        fields.place_text(zone, F.lit(" "), F.col("district"), F.lit("")).alias("place"),
        fields.age_years(F.col("installation_date"), F.lit("2024-02-01").cast("date")).alias("age"),
        F.format_string("%s (%s) at %.2f,%.2f", "name", "department", "latitude", "longitude").alias("sms"),
    )


REGISTER_FIELDS = sql("""SELECT camera_id, 'CAM-' || upper(substr(department,1,3)) || '-' || (CASE WHEN length(regexp_replace(district,'[^A-Za-z]','','g')) >= 3 THEN upper(substr(regexp_replace(district,'[^A-Za-z]','','g'),1,3)) ELSE 'GEN' END)
      || '-' || (CASE WHEN length(s) < 4 THEN lpad(s,4,'0') ELSE s END) AS device,
    CASE health_status WHEN 'online' THEN 'online' WHEN 'degraded' THEN 'degraded' ELSE 'offline' END AS health,
    CASE camera_id % 3 WHEN 0 THEN district || ' / ' || department WHEN 1 THEN district ELSE '' END AS zone,
    CASE WHEN installation_status = 'COMMISSIONED' THEN 'metadata,health,live,playback' ELSE 'metadata,health' END AS capabilities,
    '10.0.0.' || s || ':554' AS host, '********' || right('9198765' || lpad(s,5,'0'), 4) AS phone,
    CASE camera_id % 3 WHEN 0 THEN district || ' / ' || department || ', ' || district WHEN 1 THEN '/ ' || district || ', ' || district ELSE district END AS place,
    round(date_diff('day', installation_date, DATE '2024-02-01') / CAST(365.25 AS DOUBLE), 2) AS age,
    printf('%s (%s) at %.2f,%.2f', name, department, latitude, longitude) AS sms FROM (SELECT *, CAST(camera_id AS VARCHAR) AS s FROM cam)""")


def clock_fields(spark, sf_dir):
    """Wall clocks, epochs and dates of two source dialects, there and back."""
    d, ts = views.detections(spark, sf_dir), F.col("ts")
    wall = F.when(F.col("detection_id") % 50 == 0, F.lit("not a time")).otherwise(fields.local_text(F.date_trunc("second", ts)))
    day = F.when(F.col("detection_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(F.col("detection_id") % 3 == 1, F.date_format(ts, "dd-MM-yyyy")).otherwise(F.concat(F.date_format(ts, "dd/MM/yyyy"), F.when(F.col("detection_id") % 50 == 2, " x").otherwise("")))
    made = d.select("detection_id", wall.alias("wall"), F.unix_millis("ts").cast("string").alias("ms"), day.alias("day"))
    return made.select("detection_id", F.col("wall").alias("local"), fields.wall_clock_utc(F.col("wall")).cast("timestamp_ntz").alias("utc"), fields.epoch_utc(F.col("ms")).cast("timestamp_ntz").alias("from_epoch"), fields.any_date(F.col("day")).alias("date"))


CLOCK_FIELDS = sql("""SELECT detection_id, CASE WHEN detection_id % 50 = 0 THEN 'not a time' ELSE strftime(ts + INTERVAL 330 MINUTE, '%d-%m-%Y %H:%M:%S') END AS local,
    CASE WHEN detection_id % 50 <> 0 THEN date_trunc('second', ts) END AS utc, date_trunc('millisecond', ts) AS from_epoch,
    CASE WHEN detection_id % 3 = 2 AND detection_id % 50 = 2 THEN NULL ELSE CAST(ts AS DATE) END AS date FROM det""")


def geo_fields(spark, sf_dir):
    """Distances, reach and shapes of devices of one district."""
    c, parts = views.cameras(spark, sf_dir).select("camera_id", "district", "latitude", "longitude"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a district's devices are dealt to 64 groups that each meet all of the district, in a number of partitions that holds
    a = c.withColumns({"dealt": F.pmod(F.xxhash64("camera_id"), F.lit(64)).cast("int"), "in_region": geo.in_polygon(F.col("latitude"), F.col("longitude"), list(REGION))}).repartition(parts, "district", "dealt").alias("a")
    b = c.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(63)))).repartition(parts, "district", "dealt").alias("b")
    pairs = a.join(b, (F.col("a.district") == F.col("b.district")) & (F.col("a.dealt") == F.col("b.dealt")) & (F.col("a.camera_id") < F.col("b.camera_id")))
    box = lambda t: [F.col(f"{t}.longitude"), F.col(f"{t}.latitude"), F.col(f"{t}.longitude") + 2.0, F.col(f"{t}.latitude") + 2.0]
    km = geo.haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return pairs.select(
        F.col("a.camera_id").alias("a"), F.col("b.camera_id").alias("b"), F.round(km, 3).alias("km"), F.round(geo.reach_km(km / 10), 3).alias("reach"),
        F.round(geo.iou(box("a"), box("b")), 6).alias("iou"), F.round(geo.inside_share(box("a"), box("b")), 6).alias("inside"),
        F.col("a.in_region").alias("in_region"),
    )


def duck_km(a: str, b: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"


def _crossings() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(REGION, REGION[1:] + REGION[:1], strict=True):
        if y1 != y2:
            out.append(f"CASE WHEN ({y1} > a.longitude) <> ({y2} > a.longitude) AND a.latitude < CAST({x2 - x1} AS DOUBLE) * (a.longitude - {y1}) / {y2 - y1} + {x1} THEN 1 ELSE 0 END")
    return "(" + " + ".join(out) + ") % 2 = 1"


GEO_FIELDS = sql(
    f"""SELECT a, b, round(km, 3) AS km, round(least(25, greatest(3, km / 10 / 60 * 60)), 3) AS reach, round(inter / (8 - inter), 6) AS iou, round(inter / 4, 6) AS inside, in_region
    FROM (SELECT a.camera_id AS a, b.camera_id AS b, {duck_km("a", "b")} AS km, greatest(0, least(a.longitude, b.longitude) + 2 - greatest(a.longitude, b.longitude)) * greatest(0, least(a.latitude, b.latitude) + 2 - greatest(a.latitude, b.latitude)) AS inter,
    {_crossings()} AS in_region FROM cam a JOIN cam b ON a.district = b.district AND a.camera_id < b.camera_id)"""
)


def appearance(spark, sf_dir):
    """Bhattacharyya similarity of consecutive histograms."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(geo.histogram_similarity(F.col("h"), F.col("next")), 6).alias("similarity"))


APPEARANCE = """SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: sqrt(abs(CAST(a.embedding[i] AS DOUBLE)) * abs(CAST(b.embedding[i] AS DOUBLE)))))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: abs(CAST(x AS DOUBLE)))) * list_sum(list_transform(b.embedding, lambda x: abs(CAST(x AS DOUBLE))))), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def stable_ids(spark, sf_dir):
    """Deterministic ids and the hash split by device and block of frames."""
    d = views.detections(spark, sf_dir)
    key = F.concat_ws(":", F.lit("seed"), "camera_id", F.floor(F.col("detection_id") / 20))
    return d.select("detection_id", fields.stable_id("det_", F.col("camera_id"), F.col("track_id"), F.col("class_name")).alias("stable_id"), fields.hash_split(key).alias("split"))


STABLE_IDS = sql("""SELECT detection_id, 'det_' || substr(sha1(camera_id || '|' || track_id || '|' || class_name), 1, 20) AS stable_id,
    CASE WHEN r < 0.70 THEN 'train' WHEN r < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST(CAST(('0x' || substr(sha256('seed:' || camera_id || ':' || CAST(floor(detection_id / 20) AS BIGINT)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS r FROM det)""")


def classes(spark, sf_dir):
    """Bands, tags, penalties, footage quality, calibration and priorities."""
    d = views.detections(spark, sf_dir)
    w, p, i = F.col("width_px"), F.least(F.greatest(F.col("confidence"), F.lit(0.001)), F.lit(0.999)), F.col("detection_id")
    luma = (i * 37) % 256
    band = fields.banded(w, [(20, "EXTREMELY_TINY"), (40, "VERY_SMALL"), (60, "SMALL"), (120, "MEDIUM")], "LARGE")
    marks = fields.tags(tiny=w < 40, dark=luma < 85, bright=luma > 200, low_conf=p < 0.35)
    penalty = F.when(w < 40, 1.5).when(w < 60, 0.75).otherwise(0.0) + F.when(luma < 70, 1.0).when(luma < 105, 0.5).otherwise(0.0)
    level = fields.banded(penalty, [(0.5, "EASY"), (1.25, "MODERATE"), (2.0, "HARD"), (3.0, "VERY_HARD")], "EXTREME")
    shown = F.when(luma < 8, "blackout").when((i * 11) % 100 < 5, "corrupted").when(luma > 230, "overexposed").when(luma < 60, "low_light").when(w < 30, "blurred").otherwise("normal")
    return d.select("detection_id", band.alias("band"), F.array_join(marks, "|").alias("marks"), penalty.alias("penalty"), level.alias("level"), shown.alias("footage"),
                    F.round(1 / (1 + F.exp(-F.log(p / (1 - p)) / 1.7)), 6).alias("calibrated"), fields.priority(i % 2 == 0, F.col("class_name")).alias("priority"))


CLASSES = sql("""SELECT detection_id, CASE WHEN w < 20 THEN 'EXTREMELY_TINY' WHEN w < 40 THEN 'VERY_SMALL' WHEN w < 60 THEN 'SMALL' WHEN w < 120 THEN 'MEDIUM' ELSE 'LARGE' END AS band,
    array_to_string(list_filter([CASE WHEN w < 40 THEN 'tiny' END, CASE WHEN luma < 85 THEN 'dark' END, CASE WHEN luma > 200 THEN 'bright' END, CASE WHEN p < 0.35 THEN 'low_conf' END], lambda x: x IS NOT NULL), '|') AS marks,
    penalty, CASE WHEN penalty < 0.5 THEN 'EASY' WHEN penalty < 1.25 THEN 'MODERATE' WHEN penalty < 2 THEN 'HARD' WHEN penalty < 3 THEN 'VERY_HARD' ELSE 'EXTREME' END AS level,
    CASE WHEN luma < 8 THEN 'blackout' WHEN (detection_id * 11) % 100 < 5 THEN 'corrupted' WHEN luma > 230 THEN 'overexposed' WHEN luma < 60 THEN 'low_light' WHEN w < 30 THEN 'blurred' ELSE 'normal' END AS footage,
    round(1 / (1 + exp(-ln(p / (1 - p)) / CAST(1.7 AS DOUBLE))), 6) AS calibrated, CASE WHEN detection_id % 2 <> 0 THEN 'review' WHEN class_name IN ('stolen','wanted') THEN 'critical' ELSE 'high' END AS priority
    FROM (SELECT *, CAST(CASE WHEN w < 40 THEN 1.5 WHEN w < 60 THEN 0.75 ELSE 0 END + CASE WHEN luma < 70 THEN 1.0 WHEN luma < 105 THEN 0.5 ELSE 0 END AS DOUBLE) AS penalty
    FROM (SELECT detection_id, class_name, width_px AS w, (detection_id * 37) % 256 AS luma, least(greatest(confidence, CAST(0.001 AS DOUBLE)), CAST(0.999 AS DOUBLE)) AS p FROM det))""")


def json_fields(spark, sf_dir):
    """Typed fields of a JSON column, absent ones null."""
    e = views.table(spark, sf_dir, "events")
    parsed = F.from_json("props", "struct<k: int, missing: boolean>")
    return e.select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.k").cast("double").alias("k_double"), parsed["missing"].alias("missing"))


JSON_FIELDS = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_double, CAST(json_extract_string(props, '$.missing') AS BOOLEAN) AS missing FROM events"

QUERIES = {
    "plate_forms": plate_forms, "plate_distance": plate_distance, "plate_origin": plate_origin, "plate_grammar": plate_grammar, "partial_match": partial_match,
    "scene_text": scene_text, "register_fields": register_fields, "clock_fields": clock_fields, "geo_fields": geo_fields, "appearance": appearance,
    "stable_ids": stable_ids, "classes": classes, "json_fields": json_fields,
}
ORACLES = {
    "plate_forms": PLATE_FORMS, "plate_distance": PLATE_DISTANCE, "plate_origin": PLATE_ORIGIN, "plate_grammar": PLATE_GRAMMAR, "partial_match": PARTIAL_MATCH,
    "scene_text": SCENE_TEXT, "register_fields": REGISTER_FIELDS, "clock_fields": CLOCK_FIELDS, "geo_fields": GEO_FIELDS, "appearance": APPEARANCE,
    "stable_ids": STABLE_IDS, "classes": CLASSES, "json_fields": JSON_FIELDS,
}
