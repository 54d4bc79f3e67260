import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators import access, decoding, joins, tables, windows
from fieldglass.operators.components import components
from fieldglass.sources import registers

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (7, 9), (9, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gap_equal_to_the_limit_stays(spark):
    df = spark.createDataFrame([(1, at(0), 1), (1, at(120), 2), (1, at(241), 3)], "k int, ts timestamp, id int")
    assert [r.session for r in windows.sessions(df, ["k"], ["ts"], 120_000_000).orderBy("id").collect()] == [0, 0, 1]


def test_pass_is_anchored_at_its_first_time(spark):
    rows = [(1, at(0), 1, "A", 0.5, 1), (1, at(60), 2, "B", 0.9, 2), (1, at(90), 3, "C", 0.1, 1), (1, at(91), 4, "D", 0.2, 1)]
    got = windows.same_pass(spark.createDataFrame(rows, "k int, ts timestamp, id bigint, plate string, confidence double, observations int"), ["k"], 90_000_000).orderBy("id").collect()
    assert [(r.id, r.plate, r.observations, r.folded) for r in got] == [(1, "B", 4, 3), (4, "D", 1, 1)]


def test_passes_keep_repeated_rows_and_null_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice((1, 2, None)), at(rng.randrange(300)), rng.randrange(30), rng.choice("ABC"), rng.choice((0.1, 0.5, 0.9, None)), rng.randrange(5)) for _ in range(150)]
    rows += rows[:40] + [(1, None, 1, "A", 0.5, 1), (3, at(5), None, None, None, None)]
    got = windows.same_pass(spark.createDataFrame(rows, "k int, ts timestamp, id bigint, plate string, confidence double, observations int").repartition(3), ["k"], 20_000_000).collect()
    want = []
    for k in (1, 2, 3, None):
        passes = []
        for r in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], -1 if r[2] is None else r[2])):
            if not passes or (r[1] - passes[-1][0][1]).total_seconds() > 20:
                passes.append([])
            passes[-1].append(r)
        for p in passes:
            sure = [r[4] for r in p if r[4] is not None]
            seen = [r[5] for r in p if r[5] is not None]
            want.append((k, p[0][1], p[0][2], max(sure, default=None), sum(seen) if seen else None, len(p)))
    assert sorted(((r.k, r.ts, r.id, r.confidence, r.observations, r.folded) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.folded for r in got) == len(rows) - 1


def test_throttle_counts_from_the_last_that_fired(spark):
    df = spark.createDataFrame([(1, at(s), s) for s in (0, 10, 19, 20, 39, 41)], "k int, ts timestamp, id int")
    assert [r.id for r in windows.throttled(df, ["k"], 20_000_000).orderBy("id").collect()] == [0, 20, 41]


def test_nearest_and_asof(spark):
    rng = random.Random(2)
    facts = [(k, at(rng.randrange(1000)), i) for i, k in enumerate(rng.choices((1, 2, 3), k=120))]
    samples = [(k, at(rng.randrange(1000)), i) for i, k in enumerate(rng.choices((1, 2), k=40))]
    f, s = spark.createDataFrame(facts, "k int, ts timestamp, id int"), spark.createDataFrame(samples, "k int, ts timestamp, v int")
    for r in joins.backward_asof(f, s, "k", "v").collect():
        before = [t for k, t, _ in samples if k == r.k and t <= r.ts]
        assert r.sampled_at == (max(before) if before else None)
    for r in joins.nearest(f, s, "k", "v", 50).collect():
        near = sorted((abs((t - r.ts).total_seconds()), t) for k, t, _ in samples if k == r.k and abs((t - r.ts).total_seconds()) <= 50)
        assert r.sampled_at == (near[0][1] if near else None)


def test_band_join_has_both_ends(spark):
    df = spark.createDataFrame([(i, at(s)) for i, s in enumerate((0, 59, 60, 61, 120, 180))], "id int, ts timestamp")
    got = {(r.l.id, r.r.id) for r in joins.band_join(df, df, 60).collect()}
    times = (0, 59, 60, 61, 120, 180)
    assert got == {(a, b) for a, b in itertools.product(range(6), repeat=2) if 0 <= times[b] - times[a] <= 60}


def test_reach(spark):
    rng = random.Random(3)
    places = [(i, 20 + rng.random() * 2, 70 + rng.random() * 2) for i in range(150)]
    df = spark.createDataFrame(places, "camera_id int, latitude double, longitude double")
    starts = df.filter("camera_id < 3").withColumn("m", F.col("camera_id") * 10.0)
    got = {r.camera_id for r in joins.reach_join(starts, df, F.col("m")).collect()}

    def km(a, b):
        la, lo, lb, lp = map(np.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))

    assert got == {p[0] for p in places if any(km(places[i], p) <= min(25, max(3, i * 10.0)) for i in range(3))}


def test_average_precision_envelope(spark):
    rows = [(1, 0.9, True), (2, 0.8, False), (3, 0.7, True), (4, 0.6, True), (5, 0.5, False)]
    df = spark.createDataFrame(rows, "id int, s double, hit boolean").withColumn("k", F.lit(1))
    r = windows.average_precision(df, ["k"], "s", "hit", 4).first()
    assert r.ap == pytest.approx((1.0 + 0.75 + 0.75) / 4) and r.hits == 3


def test_polygon_and_boxes(spark):
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 0.5), (-0.1, 0.5)], "x double, y double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert [r.i for r in df.select(geo.in_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False, False]
    box = lambda *v: [F.lit(float(x)) for x in v]
    r = df.select(geo.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), geo.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), geo.inside_share(box(0, 0, 4, 4), box(1, 1, 2, 2)).alias("c")).first()
    assert (round(r.a, 6), r.b, r.c) == (round(1 / 7, 6), 0.0, 1.0)


def test_access():
    with pytest.raises(ValueError):
        access.with_reason(" short ")
    assert access.with_reason("long enough ") == "long enough"


def test_versions_and_verdicts(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None), (1, 6, "b")], "k int, t int, v string")
    assert [r.version for r in tables.versions(log, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]
    old, new = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "a", None)], "k int, o string, f int"), spark.createDataFrame([(1, "a", 2), (2, "b", 1), (4, "a", None), (5, "a", 1)], "k int, o string, f int")
    assert {r.k: r.verdict for r in tables.verdicts(old, new, "k", "o", ["f"]).collect()} == {1: "updated", 2: "conflict", 3: "stale", 4: "unchanged", 5: "created"}
    assert {r.verdict for r in tables.verdicts(old, new.limit(0), "k", "o", ["f"], sound=False).collect()} == {"unchanged"}


def test_decoders_equal_enumeration():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), size=4)
    chances = {}
    for path in itertools.product(range(3), repeat=4):
        text = tuple(c for c, _ in itertools.groupby(path) if c)
        chances[text] = chances.get(text, 0) + np.prod([p[i, c] for i, c in enumerate(path)])
    for text, chance in chances.items():
        assert decoding.text_score(np.log(p), list(text)) == pytest.approx(np.log(chance))
    best = decoding.beam(np.log(p), 1000)
    assert best[0][0] == max(chances, key=chances.get) and best[0][1] == pytest.approx(np.log(max(chances.values())))


def test_registers(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"source":"x","vehicles":[{"registration_number":"gj 1","make":"a"},{"registration_number":"GJ1","make":"b"},{"registration_number":null}]}')
    assert [(r.registration_number, r.make) for r in registers.vehicles(spark, str(tmp_path / "v.json")).collect()] == [("GJ1", "b")]
    (tmp_path / "w.json").write_text('{"vehicles":[{"registration_number":"x","owner_name":"somebody"}]}')
    with pytest.raises(ValueError, match="owner_name"):
        registers.vehicles(spark, str(tmp_path / "w.json"))
    (tmp_path / "cam1.csv").write_text("vehicle,tracks,plate,legibility,vehicle_type,side,notes\n1,1+2,GJ??,readable,car,left,\n#2,3,,,,,\n")
    assert [(r.camera, r.vehicle, r.plate) for r in registers.ground_truth(spark, str(tmp_path / "cam1.csv")).collect()] == [("cam1", "1", "GJ??")]


def test_signature(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "batch string, id int, plate string")
    r = registers.signed_payload(df, "key").first()
    assert r.signature == hmac.new(b"key", r.body.encode(), hashlib.sha256).hexdigest()


def test_nearest_plates_two_and_three_edits_away(spark):
    import random

    from fieldglass.plans.q_joins import nearest_plates

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    wanted = ["".join(rng.choices("ABCDEFGH234579", k=rng.choice((3, 6, 9, 10)))) for _ in range(60)] + ["KA01AB1234"]
    readings = ["KA01XY1234", "KA01ABZZZ4"]
    for w in wanted[:-1]:
        r = list(w)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(r) + 1)
            r[k : k + rng.choice((0, 1, 1))] = rng.choice(("", "X", "Y"))
        readings.append("".join(r))
    got = nearest_plates(spark.createDataFrame([(r,) for r in readings], "plate string"), spark.createDataFrame([(w,) for w in wanted], "watched string"), 3).collect()
    want = {w: min((edits(r, w), r) for r in readings) for w in wanted}
    assert {r.wanted: (r.edits, r.plate) for r in got} == {w: m for w, m in want.items() if m[0] <= 3}
    assert {m[0] for m in want.values()} >= {2, 3}


def test_continuations_are_cheapest_first_without_one_group(spark):
    import random

    from fieldglass.operators import tracks

    rng = random.Random(2)
    data = []
    for i in range(120):
        first = rng.randint(0, 60) / 2
        data.append((i % 2, i, first, first + rng.randint(0, 6) / 2, float(rng.randint(0, 9)), float(rng.randint(0, 9))))
    df = spark.createDataFrame(data, "camera_id int, track_id bigint, first_frame double, last_frame double, first_x double, last_x double")
    pairs = sorted(((b[2] - a[3]) / 12.0 + abs(b[4] - a[5]) / 5.0, a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] != b[1] and 0 < b[2] - a[3] <= 12.0 and abs(b[4] - a[5]) <= 5.0)
    nexts, prevs, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in nexts and b not in prevs:
            nexts.add(a)
            prevs.add(b)
            want.add((a, b))
    got = tracks.continuations(df, "camera_id", 12.0, 5.0)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want) and want
