"""Queries of incident rules, track fragments and decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators import decoding, fragments, scenetext, tracks
from fieldglass.plans import views
from fieldglass.plans.q_fields import REGION
from fieldglass.plans.views import sql

FRAME = ["camera_id", "frame"]


def _boxes(spark, sf_dir):
    """A box for each detection: 20 consecutive rows of a device's block are a frame."""
    i = F.col("detection_id")
    x, y = ((i * 7) % 40).cast("double"), ((i * 13) % 40).cast("double")
    d = views.detections(spark, sf_dir)
    return d.select("detection_id", F.col("class_name"), F.floor(i / 2000).alias("camera_id"), F.floor(i / 20).alias("frame"), (i % 20).alias("track_id"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 40).alias("y2"), "confidence", F.col("confidence").alias("decel"))


BOXES = """SELECT detection_id, class_name, CAST(floor(detection_id / 2000) AS BIGINT) AS camera_id, CAST(floor(detection_id / 20) AS BIGINT) AS frame, detection_id % 20 AS track_id, CAST((detection_id * 7) % 40 AS DOUBLE) AS x1, CAST((detection_id * 13) % 40 AS DOUBLE) AS y1, confidence AS decel FROM det"""
PAIRS = """SELECT a.camera_id, a.frame, a.track_id AS ta, b.track_id AS tb, a.decel AS da, b.decel AS db, a.class_name AS ca, b.class_name AS cb, greatest(0, 40 - abs(a.x1 - b.x1)) * greatest(0, 40 - abs(a.y1 - b.y1)) AS inter FROM boxes a JOIN boxes b ON a.camera_id = b.camera_id AND a.frame = b.frame AND a.track_id < b.track_id"""


def collisions(spark, sf_dir):
    """Boxes of one frame that overlap without nesting while both brake and two others flow on."""
    out = tracks.collisions(_boxes(spark, sf_dir), FRAME)
    return out.withColumn("iou", F.round("iou", 6))


COLLISIONS = sql("SELECT camera_id, frame, ta AS track_a, tb AS track_b, round(inter / (3200 - inter), 6) AS iou FROM pairs WHERE inter / (3200 - inter) >= 0.18 AND inter / 1600 < 0.85 AND da >= 0.4 AND db >= 0.4 AND (SELECT count(*) FILTER (decel < 0.1) FROM boxes q WHERE q.camera_id = pairs.camera_id AND q.frame = pairs.frame) >= 2", boxes=BOXES, pairs=PAIRS)


def wrong_way(spark, sf_dir):
    """Tracks that go against a region's dominant sense."""
    d = views.detections(spark, sf_dir)
    sense = F.when((F.col("detection_id") * 7919) % 100 < 4, "against").otherwise("along")
    votes = d.select("track_id", (F.col("width_px") % 12).alias("region"), F.when(F.col("track_id") % 23 == 0, sense).otherwise("along").alias("sense"))
    return tracks.wrong_way(votes, ["region"], "sense", 40, 0.85, 0.08)


WRONG_WAY = sql(
    """SELECT DISTINCT v.track_id, region, sense, n, total FROM votes v JOIN (SELECT *, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS total, max(n) OVER (PARTITION BY region) AS most FROM (SELECT region, sense, count(DISTINCT track_id) AS n FROM votes GROUP BY ALL)) p USING (region, sense)
    WHERE total >= 40 AND most >= 0.85 * total AND n < 0.08 * total""",
    votes="SELECT track_id, width_px % 12 AS region, CASE WHEN track_id % 23 = 0 AND (detection_id * 7919) % 100 < 4 THEN 'against' ELSE 'along' END AS sense FROM det",
)


def _free_persons(spark, sf_dir):
    """Persons in no vehicle's box, among boxes that lie six times as far apart."""
    b = _boxes(spark, sf_dir).withColumns({"x1": F.col("x1") * 6, "y1": F.col("y1") * 6}).withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})
    return tracks.exposed(b.filter("class_name = 'person'"), b.filter("class_name <> 'person'"), FRAME)


def exposed_persons(spark, sf_dir):
    """Persons in no vehicle's box, and those inside a closed region."""
    free = _free_persons(spark, sf_dir).withColumns({"x1": F.col("x1") / 6, "y1": F.col("y1") / 6})
    return free.select("detection_id", geo.in_polygon(F.col("x1") / 10 + 20, F.col("y1") / 10 + 69, list(REGION)).alias("intrusion"))


def _inside() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(REGION, REGION[1:] + REGION[:1], strict=True):
        if y1 != y2:
            out.append(f"CASE WHEN ({y1} > y1 / 10 + 69) <> ({y2} > y1 / 10 + 69) AND x1 / 10 + 20 < CAST({x2 - x1} AS DOUBLE) * (y1 / 10 + 69 - {y1}) / {y2 - y1} + {x1} THEN 1 ELSE 0 END")
    return "(" + " + ".join(out) + ") % 2 = 1"


EXPOSED_PERSONS = sql(
    f"""SELECT detection_id, {_inside()} AS intrusion FROM boxes a WHERE class_name = 'person' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.class_name <> 'person' AND a.camera_id = b.camera_id AND a.frame = b.frame
    AND greatest(0, 40 - 6 * abs(a.x1 - b.x1)) * greatest(0, 40 - 6 * abs(a.y1 - b.y1)) / (3200 - greatest(0, 40 - 6 * abs(a.x1 - b.x1)) * greatest(0, 40 - 6 * abs(a.y1 - b.y1))) >= 0.05)""",
    boxes=BOXES,
)


def traffic_rates(spark, sf_dir):
    """Of each device the tracks a minute (25 frames a second), boxes a frame, and the share of boxes that others hide."""
    b = _boxes(spark, sf_dir)
    hidden = tracks.occlusion(b, FRAME).groupBy("camera_id").agg(F.count("*").alias("hidden"))
    per = b.groupBy("camera_id").agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("frame").alias("frames"), F.count("*").alias("boxes")).join(hidden, "camera_id", "left")
    return per.select(
        "camera_id", F.round(F.col("tracks") * 1500.0 / F.col("frames"), 1).alias("tracks_per_min"), F.round(F.col("boxes") / F.col("frames"), 2).alias("per_frame"), F.round(F.coalesce("hidden", F.lit(0)) / F.col("boxes"), 3).alias("occlusion")
    )


TRAFFIC_RATES = sql(
    """SELECT camera_id, round(tracks * 1500.0 / frames, 1) AS tracks_per_min, round(boxes / CAST(frames AS DOUBLE), 2) AS per_frame, round(coalesce(hidden, 0) / CAST(boxes AS DOUBLE), 3) AS occlusion
    FROM (SELECT camera_id, count(DISTINCT track_id) AS tracks, count(DISTINCT frame) AS frames, count(*) AS boxes FROM boxes GROUP BY camera_id) LEFT JOIN (SELECT camera_id, count(*) AS hidden FROM (SELECT camera_id, frame, ta FROM pairs WHERE inter > 480 UNION SELECT camera_id, frame, tb FROM pairs WHERE inter > 480) GROUP BY camera_id) USING (camera_id)""",
    boxes=BOXES,
    pairs=PAIRS,
)


def wrong_heading(spark, sf_dir):
    """Tracks whose heading is rare in a region where another one clearly dominates."""
    d = views.detections(spark, sf_dir)
    sector = F.when((F.col("detection_id") * 7919) % 100 < 3, F.lit(6)).when(F.col("detection_id") % 4 == 0, F.lit(1)).otherwise(0)
    votes = d.filter("class_name <> 'person'").groupBy("track_id", (F.col("width_px") % 6).alias("region")).agg(F.min_by(sector, "detection_id").alias("sector"))
    return tracks.wrong_way(votes, ["region"], "sector", 50, 0.60, 0.05)


WRONG_HEADING = sql(
    """SELECT DISTINCT v.track_id, region, sector, n, total FROM votes v JOIN (SELECT *, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS total, max(n) OVER (PARTITION BY region) AS most FROM (SELECT region, sector, count(DISTINCT track_id) AS n FROM votes GROUP BY ALL)) p USING (region, sector)
    WHERE total >= 50 AND most >= 0.60 * total AND n < 0.05 * total""",
    votes="SELECT track_id, width_px % 6 AS region, arg_min(CASE WHEN (detection_id * 7919) % 100 < 3 THEN 6 WHEN detection_id % 4 = 0 THEN 1 ELSE 0 END, detection_id) AS sector FROM det WHERE class_name <> 'person' GROUP BY ALL",
)


def exposure_spells(spark, sf_dir):
    """Persons that are in no vehicle for two frames or longer, with at most three frames between."""
    return tracks.spells(_free_persons(spark, sf_dir).select("camera_id", "track_id", "frame"), ["camera_id", "track_id"], "frame", 3, 2)


EXPOSURE_SPELLS = sql(
    """SELECT camera_id, track_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame) AS run FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY camera_id, track_id ORDER BY frame) AS gap
    FROM (SELECT * FROM boxes a WHERE class_name = 'person' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.class_name <> 'person' AND a.camera_id = b.camera_id AND a.frame = b.frame
    AND greatest(0, 40 - 6 * abs(a.x1 - b.x1)) * greatest(0, 40 - 6 * abs(a.y1 - b.y1)) / (3200 - greatest(0, 40 - 6 * abs(a.x1 - b.x1)) * greatest(0, 40 - 6 * abs(a.y1 - b.y1))) >= 0.05)))) GROUP BY camera_id, track_id, run HAVING max(frame) - min(frame) >= 2""",
    boxes=BOXES,
)


def plate_owners(spark, sf_dir):
    """Proposals of a frame's plates, one track for each plate: the surest, then that of the smaller vehicle."""
    b = _boxes(spark, sf_dir).withColumns({"id": F.col("detection_id"), "score": F.round("confidence", 1), "area": (F.col("detection_id") % 7).cast("double"), "track_id": F.col("track_id") % 12})
    return tracks.one_per_plate(b, FRAME)


PLATE_OWNERS = sql(
    "SELECT camera_id, frame, id, track_id FROM walk WHERE taken",
    boxes=BOXES.replace("confidence AS decel", "round(confidence, 1) AS score"),
    numbered="SELECT camera_id, frame, detection_id AS id, track_id % 12 AS track_id, x1, y1, row_number() OVER (PARTITION BY camera_id, frame ORDER BY score DESC, detection_id % 7, detection_id) AS k FROM boxes",
    walk="""SELECT camera_id, frame, id, track_id, k, true AS taken, [{'t': track_id, 'x': x1, 'y': y1}] AS kept FROM numbered WHERE k = 1 UNION ALL SELECT camera_id, frame, id, track_id, k, free, CASE WHEN free THEN list_append(kept, {'t': track_id, 'x': x1, 'y': y1}) ELSE kept END FROM
    (SELECT n.*, w.kept, len(list_filter(w.kept, lambda q: q.t <> n.track_id AND greatest(0, 40 - abs(q.x - n.x1)) * greatest(0, 40 - abs(q.y - n.y1)) / (3200 - greatest(0, 40 - abs(q.x - n.x1)) * greatest(0, 40 - abs(q.y - n.y1))) >= 0.5)) = 0 AS free
    FROM walk w JOIN numbered n ON n.camera_id = w.camera_id AND n.frame = w.frame AND n.k = w.k + 1)""",
)


def duplicate_tracks(spark, sf_dir):
    """K2, K3: tracks of one device whose boxes agree in three frames or more."""
    return tracks.duplicates(_boxes(spark, sf_dir), FRAME)


DUPLICATE_TRACKS = sql("SELECT camera_id, ta AS a, tb AS b FROM pairs GROUP BY camera_id, ta, tb HAVING count(*) >= 3 AND (quantile_cont(inter / (3200 - inter), 0.5) >= 0.6 OR quantile_cont(inter / 1600, 0.5) >= 0.85)", boxes=BOXES, pairs=PAIRS)


def linked_objects(spark, sf_dir):
    """K2: fragments of tracks joined where one goes on as another, as numbered objects."""
    d = views.detections(spark, sf_dir)
    frame = F.unix_micros("ts") / 3.6e9
    t = d.groupBy("camera_id", F.col("track_id").alias("track"), F.floor(F.unix_micros("ts") / (72 * 3.6e9)).alias("piece")).agg(F.min("detection_id").alias("track_id"), F.count("*").alias("frames"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.min_by("width_px", F.struct("ts", "detection_id")).cast("double").alias("first_x"), F.max_by("width_px", F.struct("ts", "detection_id")).cast("double").alias("last_x"))
    edges = tracks.continuations(t, "camera_id", 12.0, 10.0)
    return tracks.objects(t, edges, 3)


#: Of each device 20 lanes of boxes of 40 x 30: vehicles that lose their ids (two of them behind each other), second boxes, parked ones, and noise.
LANES = """SELECT camera_id, slot + 20 * (k // life) AS track_id, 2 * k AS frame, x AS x1, y AS y1, x + 40 AS x2, y + 30 AS y2, CASE WHEN slot IN (5, 14) THEN 'motorcycle' WHEN slot BETWEEN 10 AND 12 THEN 'truck' ELSE 'car' END AS class_name,
    CASE WHEN slot = 16 THEN confidence / 2 ELSE confidence END AS confidence FROM
    (SELECT *, CAST(CASE WHEN slot = 8 THEN 2 * 3 * k + 15 + wobble WHEN slot < 13 THEN 2 * (2 + (slot % 10) % 3) * k + slot // 10 + wobble WHEN slot < 17 THEN 1000 + 150 * greatest(slot, 14) + wobble ELSE (detection_id * 131) % 1500 END AS DOUBLE) AS x,
      CAST(CASE WHEN slot = 8 THEN 700 WHEN slot < 13 THEN 100 * (slot % 10) + slot // 10 WHEN slot < 17 THEN 50 ELSE 1000 + (detection_id * 71) % 900 END AS DOUBLE) AS y FROM
      (SELECT detection_id, confidence, detection_id // 2000 AS camera_id, (detection_id % 2000) // 20 AS k, detection_id % 20 AS slot, (detection_id * 7) % 3 AS wobble,
        CASE WHEN detection_id % 20 = 8 THEN 19 WHEN detection_id % 20 < 13 THEN 12 + detection_id % 20 WHEN detection_id % 20 < 17 THEN 15 ELSE 2 END AS life FROM det))
    WHERE k % life >= CASE WHEN slot < 10 THEN slot % 4 WHEN slot BETWEEN 13 AND 16 THEN 5 ELSE 0 END AND NOT (slot = 13 AND k >= 50) AND NOT (slot = 14 AND k < 50)"""


def _lanes(spark, sf_dir):
    """The boxes of LANES: the arithmetic of its SQL over the detections."""
    d = views.detections(spark, sf_dir)
    return spark.sql(LANES.replace("FROM det)", "FROM {d})").replace("//", "div"), d=d)


def physical_vehicles(spark, sf_dir):
    """K2: tracks of lanes joined to physical vehicles: second boxes, parked ids and continuations, strongest first."""
    return fragments.link_fragments(_lanes(spark, sf_dir))


_INTER = "greatest(0, 40 - abs({a} - {b})) * greatest(0, 30 - abs({c} - {d}))"
_IOU = f"({_INTER} / (2400 - {_INTER}))"
PHYSICAL_VEHICLES = sql(
    """SELECT camera_id, track_id, vehicle FROM whole LEFT JOIN (SELECT camera_id, track_id, vehicle FROM rooted JOIN (SELECT camera_id, root, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY min(first), root) AS INT) AS vehicle
    FROM rooted GROUP BY camera_id, root HAVING sum(n) >= 3) USING (camera_id, root)) USING (camera_id, track_id)""",
    lane=LANES,
    whole="SELECT camera_id, track_id, count(*) AS n, min(frame) AS first, max(frame) AS last, arg_min(x1, frame) AS xa, arg_min(y1, frame) AS ya, arg_max(x1, frame) AS xz, arg_max(y1, frame) AS yz, quantile_cont(x1, 0.5) AS mx, quantile_cont(y1, 0.5) AS my, CASE WHEN min(class_name) = 'motorcycle' THEN 2 ELSE 4 END AS family, max(confidence) AS score FROM lane GROUP BY ALL",
    ends="""SELECT camera_id, track_id, count(*) FILTER (sqrt((x1 - mx) * (x1 - mx) + (y1 - my) * (y1 - my)) < 0.25 * sqrt(1200)) AS near, arg_max(x1, frame) FILTER (frame - first <= 25) AS xb, arg_max(y1, frame) FILTER (frame - first <= 25) AS yb,
      arg_min(x1, frame) FILTER (last - frame <= 25) AS xe, arg_min(y1, frame) FILTER (last - frame <= 25) AS ye, min(frame) FILTER (last - frame <= 25) AS fe FROM lane JOIN whole USING (camera_id, track_id) GROUP BY ALL""",
    told="""SELECT *, n >= 3 AND near >= 0.8 * n AS standing, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) < 0.15 * sqrt(1200) AS still_begin, last = fe OR sqrt((xz - xe) * (xz - xe) + (yz - ye) * (yz - ye)) < 0.15 * sqrt(1200) AS still_end,
      CASE WHEN last > fe THEN (xz - xe) / CAST(last - fe AS DOUBLE) ELSE 0 END AS vx, CASE WHEN last > fe THEN (yz - ye) / CAST(last - fe AS DOUBLE) ELSE 0 END AS vy FROM whole JOIN ends USING (camera_id, track_id)""",
    kept="SELECT * FROM told WHERE NOT (standing AND score < 0.65)",
    twice=f"""SELECT camera_id, a, b FROM (SELECT l.camera_id, l.track_id AS a, r.track_id AS b, {_IOU.format(a="l.x1", b="r.x1", c="l.y1", d="r.y1")} AS o, {_INTER.format(a="l.x1", b="r.x1", c="l.y1", d="r.y1")} / 1200 AS cover FROM lane l JOIN lane r ON l.camera_id = r.camera_id AND l.frame = r.frame AND l.track_id < r.track_id
      SEMI JOIN kept p ON p.camera_id = l.camera_id AND p.track_id = l.track_id SEMI JOIN kept q ON q.camera_id = r.camera_id AND q.track_id = r.track_id) GROUP BY camera_id, a, b HAVING count(*) >= 3 AND (quantile_cont(o, 0.5) >= 0.6 OR quantile_cont(cover, 0.5) >= 0.85)""",
    parked=f"SELECT a.camera_id, a.track_id AS a, b.track_id AS b FROM kept a JOIN kept b ON a.camera_id = b.camera_id AND a.family = b.family AND a.track_id < b.track_id WHERE a.standing AND b.standing AND greatest(a.first, b.first) - least(a.last, b.last) <= 3000 AND {_IOU.format(a='a.mx', b='b.mx', c='a.my', d='b.my')} >= 0.5",
    sure="SELECT * FROM twice UNION SELECT * FROM parked UNION SELECT camera_id, b, a FROM twice UNION SELECT camera_id, b, a FROM parked",
    reach="SELECT camera_id, track_id, track_id AS root FROM kept UNION SELECT s.camera_id, s.b, r.root FROM reach r JOIN sure s ON s.camera_id = r.camera_id AND s.a = r.track_id AND r.root < s.b",
    met=f"""SELECT a.camera_id, a.track_id AS a, b.track_id AS b, b.first - a.last AS gap, a.still_end AND b.still_begin AND b.n >= 3 AS stood, {_IOU.format(a="a.xz", b="b.xa", c="a.yz", d="b.ya")} AS o,
      sqrt((a.xz + 20 + a.vx * (b.first - a.last) - (b.xa + 20)) * (a.xz + 20 + a.vx * (b.first - a.last) - (b.xa + 20)) + (a.yz + 15 + a.vy * (b.first - a.last) - (b.ya + 15)) * (a.yz + 15 + a.vy * (b.first - a.last) - (b.ya + 15))) / sqrt(1200) AS drift
      FROM kept a JOIN kept b ON a.camera_id = b.camera_id AND a.family = b.family AND a.track_id <> b.track_id AND b.first > a.last AND b.first - a.last <= 3000""",
    ordered="SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY cost, a, b) AS k FROM (SELECT camera_id, a, b, CASE WHEN stood THEN 1 - o + gap / CAST(3000 AS DOUBLE) ELSE drift + 0.5 * gap / 50 END AS cost FROM met WHERE CASE WHEN stood THEN o >= 0.5 ELSE gap <= 50 AND drift <= 0.6 END)",
    walk="""SELECT camera_id, CAST(0 AS BIGINT) AS k, [CAST(-1 AS BIGINT)] AS nexts, [CAST(-1 AS BIGINT)] AS prevs, map_from_entries(list((track_id, root))) AS roots FROM (SELECT camera_id, track_id, min(root) AS root FROM reach GROUP BY ALL) GROUP BY camera_id
      UNION ALL SELECT camera_id, k, CASE WHEN ok THEN list_append(nexts, a) ELSE nexts END, CASE WHEN ok THEN list_append(prevs, b) ELSE prevs END, CASE WHEN ok THEN map_from_entries(list_transform(map_entries(roots), lambda e: (e.key, CASE WHEN e.value = greatest(ra, rb) THEN least(ra, rb) ELSE e.value END))) ELSE roots END
      FROM (SELECT *, NOT list_contains(nexts, a) AND NOT list_contains(prevs, b) AND ra <> rb AS ok FROM (SELECT w.camera_id, o.k, o.a, o.b, w.nexts, w.prevs, w.roots, w.roots[o.a] AS ra, w.roots[o.b] AS rb FROM walk w JOIN ordered o ON o.camera_id = w.camera_id AND o.k = w.k + 1))""",
    rooted="SELECT w.camera_id, k.track_id, k.n, k.first, w.roots[k.track_id] AS root FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY k DESC) = 1) w JOIN kept k ON k.camera_id = w.camera_id",
)


def decoded_texts(spark, sf_dir):
    """The best text of a matrix of glyph chances by a prefix beam, and its whole chance."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda x: F.exp(x.cast("double") * 8))).alias("m"))
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    shares = F.transform("m", lambda row: F.transform(row, lambda x: x / total(row)))
    return decoding.decode(e.select("vec_id", shares.alias("m")), "vec_id", "m", "ABCDEFG").select("vec_id", "text", F.round("score", 5).alias("score"))


def _slot_matrices(spark, sf_dir):
    """Ten or eleven rows of 37 chances for each vector: glyphs of a plate stand out by the vector's own values."""
    e = views.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    value = lambda t, g: F.exp(F.element_at("embedding", ((t * 37 + g * 5) % 64 + 1).cast("int")).cast("double") * 12)
    rows = F.transform(F.sequence(F.lit(0), 9 + F.col("vec_id").cast("int") % 2), lambda t: F.transform(F.sequence(F.lit(0), F.lit(36)), lambda g: value(t, g)))
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.transform(rows, lambda row: F.transform(row, lambda x: x / total(row))).alias("m"))


def slot_plates(spark, sf_dir):
    """The three likeliest plates of each matrix of slots under the layouts, with confusion and the layouts' priors."""
    return decoding.slot_texts(_slot_matrices(spark, sf_dir), "vec_id", "m", 16, 3).select("vec_id", "text", F.round("score", 5).alias("score"), "place")


def shown_targets(spark, sf_dir):
    """How well the pictures of each group show the texts that are looked for in it, relative to their best path."""
    e = views.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda x: F.exp(x.cast("double") * 8)))
    pictures = e.select((F.col("vec_id") % 97).alias("track"), F.col("vec_id").alias("picture"), (F.col("vec_id") * 7 % 10).alias("quality"), F.transform(m, lambda row: F.transform(row, lambda x: x / total(row))).alias("m"))
    wanted = e.select((F.col("vec_id") % 97).alias("track"), F.concat(*(F.substring(F.lit("ABCDEFG"), (F.col("vec_id") * k % 7 + 1).cast("int"), F.lit(1)) for k in (1, 3, 5))).alias("target"))
    return decoding.target_scores(pictures, wanted, "track", "m", "ABCDEFG").select("track", "target", F.round("score", 5).alias("score"), "pictures")


#: Candidate boxes by vector: five spots a device; one in three shows the spot's own picture, the others theirs.
SIGNS = """SELECT vec_id AS id, vec_id % 3 AS camera_id, vec_id * 4 AS frame, vec_id % 11 AS track_id, CAST(200 * (vec_id // 3 % 5) + vec_id % 4 AS DOUBLE) AS x1, CAST(100 + vec_id % 3 AS DOUBLE) AS y1, CAST(200 * (vec_id // 3 % 5) + vec_id % 4 + 40 + vec_id % 5 AS DOUBLE) AS x2, CAST(115 AS DOUBLE) AS y2,
    CAST(vec_id % 7 * 60 AS DOUBLE) AS v1, CAST(0 AS DOUBLE) AS w1, CAST(vec_id % 7 * 60 + 200 AS DOUBLE) AS v2, CAST(150 AS DOUBLE) AS w2, CASE WHEN vec_id // 15 % 3 = 0 THEN vec_id // 3 % 5 ELSE vec_id END AS shows FROM embeddings WHERE embedding IS NOT NULL"""


def scene_signs(spark, sf_dir):
    """K5: candidate boxes that show a text of the scene: the same spot and picture behind other vehicles, among the forty before."""
    e = views.table(spark, sf_dir, "embeddings")
    rows = spark.sql(SIGNS.replace("FROM embeddings", "FROM {e}").replace("//", "div"), e=e)
    pictures = e.select(F.col("vec_id").alias("shows"), F.transform("embedding", lambda x: x.cast("double")).alias("picture"))
    return scenetext.static_text(rows.join(pictures, "shows").drop("shows"), 40)


_SPOT = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_CARS = "greatest(0, least(a.v2, b.v2) - greatest(a.v1, b.v1)) * greatest(0, least(a.w2, b.w2) - greatest(a.w1, b.w1))"
SCENE_SIGNS = sql(
    """SELECT DISTINCT camera_id, id_b AS id FROM near JOIN (SELECT DISTINCT camera_id AS c, id_a AS s FROM near WHERE n_b < n_a AND other) ON c = camera_id AND s = id_a""",
    sign=SIGNS,
    pic="""SELECT s.*, row_number() OVER (PARTITION BY camera_id ORDER BY frame, id) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS q FROM sign s JOIN embeddings ON vec_id = shows""",
    near=f"""SELECT a.camera_id, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, a.track_id <> b.track_id AND abs(a.frame - b.frame) >= 30 AND {_CARS} / ((a.v2 - a.v1) * (a.w2 - a.w1) + (b.v2 - b.v1) * (b.w2 - b.w1) - {_CARS}) < 0.7 AS other FROM pic a JOIN pic b ON a.camera_id = b.camera_id AND abs(a.n - b.n) <= 40
      WHERE {_SPOT} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_SPOT}) >= 0.6 AND list_inner_product(a.q, b.q) / sqrt(list_inner_product(a.q, a.q) * list_inner_product(b.q, b.q)) >= 0.85""",
)


def finalised_tracks(spark, sf_dir):
    """The best crop of each track, and those whose plate stands still while the vehicle moves."""
    i, t = F.col("detection_id"), F.col("track_id")
    still = t % 5 == 0
    reads = views.detections(spark, sf_dir).filter("class_name <> 'person'").select(
        "camera_id", "track_id", i.alias("id"), F.col("confidence").alias("quality"), F.when(still, i % 3).otherwise(i * 7 % 200).cast("double").alias("px"), F.when(still, F.lit(1.0)).otherwise((i * 3 % 90).cast("double")).alias("py"),
        F.when(t % 10 == 0, i % 20).otherwise(i * 7 % 400).cast("double").alias("vx"), (i % 9).cast("double").alias("vy"),
    )
    found = tracks.finalised(reads, ["camera_id", "track_id"])
    return found.select("camera_id", "track_id", "boxes", "best", F.round("plate_moved", 6).alias("plate_moved"), F.round("vehicle_moved", 6).alias("vehicle_moved"), "overlay")


FINALISED_TRACKS = sql(
    """SELECT camera_id, track_id, boxes, best, round(pm, 6) AS plate_moved, round(vm, 6) AS vehicle_moved, boxes >= 3 AND pm < 3 AND vm > 30 AS overlay FROM (SELECT camera_id, track_id, count(*) AS boxes, arg_min(detection_id, row(-confidence, detection_id)) AS best,
    sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)) AS pm, sqrt(pow(max(vx) - min(vx), 2) + pow(max(vy) - min(vy), 2)) AS vm FROM (SELECT *, CASE WHEN track_id % 5 = 0 THEN detection_id % 3 ELSE detection_id * 7 % 200 END AS px, CASE WHEN track_id % 5 = 0 THEN 1 ELSE detection_id * 3 % 90 END AS py,
    CASE WHEN track_id % 10 = 0 THEN detection_id % 20 ELSE detection_id * 7 % 400 END AS vx, detection_id % 9 AS vy FROM det WHERE class_name <> 'person') GROUP BY ALL)"""
)


QUERIES = {f.__name__: f for f in (collisions, wrong_way, wrong_heading, exposed_persons, exposure_spells, plate_owners, traffic_rates, duplicate_tracks, linked_objects, physical_vehicles, decoded_texts, slot_plates, shown_targets, scene_signs, finalised_tracks)}
ORACLES = {"collisions": COLLISIONS, "wrong_way": WRONG_WAY, "wrong_heading": WRONG_HEADING, "exposure_spells": EXPOSURE_SPELLS, "plate_owners": PLATE_OWNERS, "exposed_persons": EXPOSED_PERSONS, "traffic_rates": TRAFFIC_RATES, "duplicate_tracks": DUPLICATE_TRACKS, "physical_vehicles": PHYSICAL_VEHICLES, "scene_signs": SCENE_SIGNS, "finalised_tracks": FINALISED_TRACKS}
