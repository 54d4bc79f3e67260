"""Findings of the third round, each with the smallest table that shows it."""

import random
import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import fields, plates
from fieldglass.operators import joins, tracks
from fieldglass.plans import catalogue
from fieldglass.sources import registers
from fieldglass.streaming import incidents


def test_device_ids_keep_long_numbers(spark):
    df = spark.createDataFrame([("src-7",), ("src-1234",), ("src-10033",), ("src-1003399",), ("src-ab",)], "s string")
    got = [r.d for r in df.select(fields.device_id(F.lit("CAM"), F.lit("ASI"), F.lit("Nation"), F.col("s")).alias("d")).collect()]
    assert [g.rsplit("-", 1)[1] for g in got] == ["0007", "1234", "10033", "1003399", "AB"]


def test_plate_report_rounds_as_its_sql(spark):
    # 253.75 / 500 * 1000 is just below 507.5
    df = spark.createDataFrame([(1, "GJ26ZT2203", 253.75 / 500, 5), (2, "GJ26ZT2203", 0.1235, 1), (3, "GJ26ZT2203", None, 1)], "sighting_id long, plate string, confidence double, observations int")
    assert [(r.sighting, r.confidence, r.sure) for r in registers.plate_report(df).collect()] == [("1", "0.507", "yes"), ("2", "0.124", "no")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plate_distance_shares_an_office_between_tasks(spark, sf_dir):
    plan = _plan(catalogue.QUERIES["plate_distance"](spark, sf_dir))
    assert "dealt" in plan and "REPARTITION_BY_NUM" in plan


def test_distances_of_a_batch_equal_those_of_single_pairs(spark):
    rng = random.Random(1)
    some = ["", "GJ01AB1234", "ÄÖ0O", *("".join(rng.choice("GJ01AB60OD8BQ") for _ in range(rng.randint(1, 11))) for _ in range(40)), "G" * 300]
    df = spark.createDataFrame([(a, b) for a in some for b in some] + [(None, "GJ"), ("GJ", None)], "a string, b string")
    for r in df.select("a", "b", plates.distance(F.col("a"), F.col("b")).alias("d"), plates.distances("a", "b").alias("got")).collect():
        assert r.got == (None if r.d is None else pytest.approx(r.d)), r


def test_partial_match_joins_on_all_legible_glyphs(spark, sf_dir):
    plan = catalogue.QUERIES["partial_match"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "= tail" in plan


def test_devices_of_a_district_are_shared_between_tasks(spark, sf_dir):
    plan = _plan(catalogue.QUERIES["geo_fields"](spark, sf_dir))
    assert "dealt" in plan and "REPARTITION_BY_NUM" in plan


def test_match_join_finds_all_matches_among_few_candidates(spark):
    numbers = [f"GJ01AB{n:04d}" for n in range(0, 10000, 7)]
    odd = ["", "G", "GJ", "0J01AB0007", "GJO1AB0007", "0JO1AB0007", "GJ01A0007", "GJ01AB00077", "GJ01AB0", "GO1AB0007", "GJ01AB000"]
    df = spark.createDataFrame([(p,) for p in numbers[:300] + odd], "plate string")
    twin = df.withColumnRenamed("plate", "watched")
    every = df.crossJoin(twin).select("plate", "watched", plates.distances("plate", "watched").alias("d")).filter("d <= 1.0")
    want = {(r.plate, r.watched): r.d for r in every.collect()}
    assert {(r.plate, r.watched): r.distance for r in joins.plate_pairs(df, twin).collect()} == want
    many = spark.createDataFrame([(p,) for p in numbers], "plate string")
    found = joins.plate_pairs(many, many.withColumnRenamed("plate", "watched")).count()
    assert joins.match_join(many, many.withColumnRenamed("plate", "watched")).count() <= 1.1 * found


def test_continuations_in_bands_equal_the_greedy_choice(spark):
    rng = random.Random(2)
    ends = [(c, i, (b := rng.uniform(0, 30)), b + rng.uniform(0, 3), float(rng.randrange(60)), float(rng.randrange(60))) for c in (1, 2) for i in range(c * 1000, c * 1000 + 150)]
    df = spark.createDataFrame(ends, "camera_id long, track_id long, first_frame double, last_frame double, first_x double, last_x double")
    pairs = sorted(((b[2] - a[3]) / 12.0 + abs(b[4] - a[5]) / 10.0, a[1], b[1]) for a in ends for b in ends if a[0] == b[0] and a[1] != b[1] and 0 < b[2] - a[3] <= 12.0 and abs(b[4] - a[5]) <= 10.0)
    nexts, backs = {}, set()
    for _, a, b in pairs:
        if a not in nexts and b not in backs:
            nexts[a] = b
            backs.add(b)
    near = []
    store, tracks.stored = tracks.stored, lambda df, what: (near.append(store(df, what)) or near[-1]) if what == "near" else store(df, what)
    try:
        got = {r.a: r.b for r in tracks.continuations(df, "camera_id", 12.0, 10.0, few=16).collect()}
    finally:
        tracks.stored = store
    assert got == nexts and len(near) > 4


def test_occlusion_makes_no_pairs(spark, sf_dir):
    plan = catalogue.QUERIES["traffic_rates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Union" not in plan


def test_events_meet_those_of_near_devices(spark, sf_dir):
    plan = catalogue.QUERIES["event_correlation"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ASIN" not in plan.upper()  # no distance is taken for a pair of events


class _State:
    def __init__(self):
        self.held, self.reads = None, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        self.reads += 1
        return iter(()) if self.held is None else iter(self.held) if isinstance(self.held, list) else self.held

    def put(self, v):
        self.held = v

    def clear(self):
        self.held = None

    appendList = update = put  # noqa: N815


class _Map(dict):
    iterator = dict.items
    updateValue, removeKey = dict.__setitem__, dict.__delitem__  # noqa: N815


def test_boxes_that_wait_are_read_once_for_all_timers_that_are_due():
    d, timers = incidents.Detector(), set()
    d.waiting, d.clock, d.drop, d.tracks, d.fired, d.handle = _State(), _State(), _State(), _Map(), _Map(), SimpleNamespace(registerTimer=timers.add)
    rows = [SimpleNamespace(us=k * 200_000, track_id=i, label="car", x1=0.0, y1=0.0, x2=50.0, y2=50.0, pts=k * 200) for k in range(50) for i in range(3)]
    assert not list(d.handleInputRows((1,), rows, None)) and len(timers) == 11
    for t in sorted(timers):
        list(d.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 20_000), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
    assert d.waiting.reads == 1 and len(d.tracks) == 3
    last = max(timers)
    list(d.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: last), SimpleNamespace(getExpiryTimeInMs=lambda: last)))
    assert not d.tracks and not d.drop.exists() and not d.clock.exists()


def test_medians_are_taken_of_likely_duplicates_only(spark):
    rng = random.Random(3)
    rows = []
    for frame in range(9):
        for track in range(8):
            if rng.random() < 0.8:
                x, far = 30.0 * (track // 2), rng.choice((0.0, 0.0, 5.0, 9.0, 11.0, 40.0))
                rows.append((1, frame, track, x + track % 2 * far, 0.0, x + track % 2 * far + 40.0, 40.0 - track % 3))
    df = spark.createDataFrame(rows, "camera_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    by = {}
    for _, f, t, *box in rows:
        for _, g, u, *other in rows:
            if f == g and t < u:
                w, h = min(box[2], other[2]) - max(box[0], other[0]), min(box[3], other[3]) - max(box[1], other[1])
                areas, inter = sorted((x[2] - x[0]) * (x[3] - x[1]) for x in (box, other)), max(w, 0.0) * max(h, 0.0)
                by.setdefault((t, u), []).append((inter / (sum(areas) - inter), inter / areas[0], areas[0] / areas[1]))
    middle = {k: [statistics.median(c) for c in zip(*v, strict=True)] for k, v in by.items() if len(v) >= 3}
    want = {k for k, (iou, cover, ratio) in middle.items() if iou >= 0.6 or cover >= 0.85 and ratio >= 0.5}
    found = tracks.duplicates(df, ["camera_id", "frame"])
    assert {(r.a, r.b) for r in found.collect()} == want and 0 < len(want) < len(middle)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("percentile") < plan.index("Join Inner") and plan.count("Join Inner") == 3  # of likely pairs with both sides
