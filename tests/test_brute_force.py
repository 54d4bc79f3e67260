"""Operators and queries against plain versions of them."""

import hashlib
import hmac
import itertools
import json
import math
import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass import store
from fieldglass.operators import decoding, joins, tables, tracks, windows
from fieldglass.operators.components import components
from fieldglass.plans import catalogue, views

T0 = datetime(2024, 1, 1)
GLYPHS = "AB01"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_join(spark, most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choices(GLYPHS, k=rng.randint(0, 8))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "plate string")
    got = {(r.plate, r.watched): r.edits for r in joins.edit_join(df, df.withColumnRenamed("plate", "watched"), most).collect()}
    assert got == {(a, b): edits(a, b) for a in words for b in words if edits(a, b) <= most}


@pytest.mark.parametrize("closed", [True, False])
def test_anchored_passes(spark, closed):
    rng = random.Random(3)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(2), at(rng.randrange(400)), i) for i in range(500)]
    rows += [("z", 0, at(5 * i), 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, j int, ts timestamp, id bigint").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    got = {r.id: (r.anchor // 1_000_000 - int(T0.timestamp()), r.first) for r in windows.anchored(df, ["k", "j"], 20_000_000, closed).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, by = {}, defaultdict(list)
    for k, j, t, i in rows:
        by[k, j].append(((t - T0).seconds, i))
    for group in by.values():
        anchor = None
        for t, i in sorted(group):
            first = anchor is None or (t - anchor > 20 if closed else t - anchor >= 20)
            anchor = t if first else anchor
            want[i] = (anchor, first)
    assert got == want


def test_chained_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("pq"), at(rng.randrange(3000)), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint")
    pairs = [(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and abs((a[1] - b[1]).total_seconds()) <= 30]
    want = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    links = joins.chained(df, ["k"], 30, "id")
    assert {r.node: r.root for r in components(links).collect()} == want
    assert links.count() <= 2 * len(rows)


def test_near_in_time(spark):
    rng = random.Random(5)
    rows = [(i, at(rng.randrange(600)), 20 + rng.random() * 3, 70 + rng.random() * 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, latitude double, longitude double")

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (a[2], a[3], b[2], b[3]))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))

    got = {(r.l.id, r.r.id) for r in joins.near_in_time(df, df, 60, 40.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if 0 <= (b[1] - a[1]).total_seconds() <= 60 and km(a, b) <= 40}


@pytest.mark.parametrize("steps", [1, 7, 1024])
def test_average_precision_in_ranges(spark, steps):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.choice((rng.random(), 0.5, 1.0, 0.0)), rng.random() < 0.4) for i in range(400)]
    got = {r.k: r.ap for r in windows.average_precision(spark.createDataFrame(rows, "k string, id int, s double, hit boolean"), ["k"], "s", "hit", 50, steps).collect()}
    for k in "ab":
        ranked = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        hits = list(itertools.accumulate(int(r[3]) for r in ranked))
        precision = [h / (n + 1) for n, h in enumerate(hits)]
        envelope = list(itertools.accumulate(precision[::-1], max))[::-1]
        assert got[k] == pytest.approx(sum(e for e, r in zip(envelope, ranked, strict=True) if r[3]) / 50)


def test_life_of_entries(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(4), i, rng.choice("SSEP")) for i in range(200)]
    got = {r.t: (r.outcome, r.spell) for r in tables.life(spark.createDataFrame(rows, "k int, t int, act string"), ["k"], ["t"], "act", ["S"], ["E"]).collect()}
    active, spell = {}, defaultdict(int)
    for k, t, act in rows:
        if act == "S":
            outcome = "duplicate" if active.get(k) else "reactivated" if k in active else "created"
            spell[k] += outcome != "duplicate"
            active[k] = True
        elif active.get(k):
            outcome = "ended" if act == "E" else "accepted"
            active[k] = act != "E"
        else:
            outcome = "refused"
        assert got[t] == (outcome, spell[k])


def test_linked_objects(spark, sf_dir):
    """The registered query against cheapest-first matching and numbering in plain Python."""
    det = views.detections(spark, sf_dir).collect()
    pieces = defaultdict(list)
    for r in det:
        us = int(r.ts.timestamp() * 1_000_000)
        pieces[r.camera_id, r.track_id, us // int(72 * 3.6e9)].append((us, r.detection_id, r.width_px))
    rows = []
    for (camera, _, _), seen in pieces.items():
        seen.sort()
        rows.append((camera, min(i for _, i, _ in seen), len(seen), seen[0][0] / 3.6e9, seen[-1][0] / 3.6e9, float(seen[0][2]), float(seen[-1][2])))
    near = [((b[3] - a[4]) / 12 + abs(b[5] - a[6]) / 10, a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and 0 < b[3] - a[4] <= 12 and abs(b[5] - a[6]) <= 10]
    used_a, used_b, root = set(), set(), {r[1]: r[1] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in sorted(near):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            a, b = sorted((find(a), find(b)))
            root[b] = a
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], find(r[1])].append(r)
    number, order = {}, defaultdict(list)
    for (camera, key), group in groups.items():
        if sum(r[2] for r in group) >= 3:
            order[camera].append((min(r[3] for r in group), key))
    for camera, found in order.items():
        number |= {(camera, key): n + 1 for n, (_, key) in enumerate(sorted(found))}
    want = sorted((r[1], r[0], number.get((r[0], find(r[1])), 0)) for r in rows)
    got = sorted((r.track_id, r.camera_id, r.object or 0) for r in catalogue.QUERIES["linked_objects"](spark, sf_dir).collect())
    assert got == want and any(n for _, _, n in want)


def test_alert_payloads_are_signed(spark, sf_dir):
    listed = {r.plate: r.category for r in views.watch_list(spark, sf_dir).collect()}
    batches = defaultdict(list)
    for r in views.sightings(spark, sf_dir).collect():
        if r.plate in listed:
            batches[f"{r.camera_id}/{r.ts.date()}"].append({"sighting_id": r.sighting_id, "plate": r.plate, "category": listed[r.plate]})
    want = {}
    for key, alerts in batches.items():
        body = json.dumps(sorted(alerts, key=lambda a: a["sighting_id"]), separators=(",", ":"))
        want[key] = (len(body), hmac.new(b"test-key", body.encode(), hashlib.sha256).hexdigest())
    assert {r.batch: (r.size, r.signature) for r in catalogue.QUERIES["alert_payloads"](spark, sf_dir).collect()} == want


def test_beam_finds_the_best_text():
    """A wide beam against the sums over all paths of a small matrix."""
    rng = np.random.default_rng(8)
    for _ in range(5):
        log_p = np.log(rng.dirichlet(np.ones(3), size=5))
        chance = defaultdict(float)
        for path in itertools.product(range(3), repeat=5):
            text = tuple(k for k, _ in itertools.groupby(path) if k != decoding.BLANK)
            chance[text] += math.exp(sum(log_p[i, c] for i, c in enumerate(path)))
        best = max(chance, key=chance.get)
        found, score = decoding.beam(log_p, 10_000)[0]
        assert found == best and math.exp(score) == pytest.approx(chance[best])
        assert math.exp(decoding.text_score(log_p, list(best))) == pytest.approx(chance[best])


def test_occlusion(spark):
    rng = random.Random(9)
    boxes = [(f, t, *(x := (rng.random() * 50, rng.random() * 50)), x[0] + 5 + rng.random() * 30, x[1] + 5 + rng.random() * 30) for f in range(8) for t in range(9)]
    got = {(r.frame, r.track_id) for r in tracks.occlusion(spark.createDataFrame(boxes, "frame int, track_id int, x1 double, y1 double, x2 double, y2 double"), ["frame"]).collect()}
    want = set()
    for f, t, x1, y1, x2, y2 in boxes:
        for g, u, a1, b1, a2, b2 in boxes:
            if f == g and t != u and max(0, min(x2, a2) - max(x1, a1)) * max(0, min(y2, b2) - max(y1, b1)) > 0.3 * (x2 - x1) * (y2 - y1):
                want.add((f, t))
    assert got == want


def test_jobs_leave_only_results(spark):
    root = store.shared_dir(spark)
    before = set(os.listdir(root))
    with store.job(spark, "outer") as result:
        with store.job(spark, "inner") as inner:
            store.stored(spark.range(5), "step")
            kept = inner(spark.range(7))
        assert kept.count() == 7
        last = result(kept.filter("id > 2"))
    assert last.count() == 4
    assert len(set(os.listdir(root)) - before) == 1
    with pytest.raises(ZeroDivisionError), store.job(spark, "broken"):
        store.stored(spark.range(5), "step")
        1 / 0
    assert len(set(os.listdir(root)) - before) == 1


def test_group_sizes_decide_bands(spark):
    rows = [("few", float(i)) for i in range(1, 10)] + [("many", float(i % 3)) for i in range(60)]
    from fieldglass.functions import fields

    got = {r.k: r.e for r in spark.createDataFrame(rows, "k string, w double").groupBy("k").agg(fields.derived_bands(F.col("w")).alias("e")).collect()}
    seen = [w for k, w in rows if k == "many" and w > 0]
    edges = [float(np.quantile(seen, q)) for q in fields.BAND_SHARES]
    for i in range(1, 4):
        edges[i] = max(edges[i], edges[i - 1] + 1)
    assert got == {"few": [20.0, 40.0, 60.0, 120.0], "many": edges}


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_moving_rank(spark, batch):
    rng = random.Random(10)
    rows = [(rng.choice(("a", "b", None)), at(rng.randrange(500)) if rng.random() < 0.97 else None, i, rng.choice((None, -70_000, 3, 5, 255, 256, 257, 70_000, rng.randrange(40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r.id: r.rank_value for r in windows.moving_rank(df, ["k"], "v", 100_000_000, 20_000_000, 0.7, 5).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, t, i, _ in rows:
        if t is not None:
            past = sorted(v for j, u, _, v in rows if j == k and u is not None and v is not None and 20 <= (t - u).total_seconds() <= 100)
            if len(past) >= 5:
                want[i] = past[int(0.7 * len(past))]
    assert got == want and len(want) > 100


def test_numbers_of_rows(spark):
    rng = random.Random(11)
    rows = [(rng.choice(("a", None)), rng.choice((None, *range(50))), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(4)
    got = {r.id: r.n for r in windows.numbered(df, ["k"], F.floor(F.col("t") / 7), ["t", "id"], "n").collect()}
    want = {}
    for k in ("a", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1], r[2]))
        want |= {r[2]: n for n, r in enumerate(mine, 1)}
    assert got == want


@pytest.mark.parametrize("batch", ["10000", "11"])
def test_damaged_frames_do_not_move_the_level(spark, batch):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), i, rng.choice((2.0, 100.0)), rng.choice((1.0, 50.0)), rng.choice((None, 1.0, 1.3, 1.7, 2.0, 2.4, 4.0, rng.uniform(1, 3)))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, luma double, focus double, grid double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r.t: (r.damaged, r.level) for r in windows.damaged_frames(df, ["k"], ["t"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in "ab":
        sound = []
        for _, t, luma, focus, grid in (r for r in rows if r[0] == k):
            level = None
            for g in sound:
                level = g if level is None else 0.95 * level + 0.05 * g
            limit = 3.0 if len(sound) < 20 else max(1.8, 1.4 * level)
            evidence = grid is not None and not (luma <= 8 and focus <= 5)
            damaged = evidence and grid >= limit
            if evidence and not damaged:
                sound.append(grid)
            assert got[t] == (damaged, pytest.approx(level) if level is not None else None)
    assert any(d for d, _ in got.values())
