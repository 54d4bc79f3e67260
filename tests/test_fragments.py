"""Fragments of tracks against a plain version that tries pairs one after another."""

import math
import random
from collections import defaultdict
from statistics import median

import pytest

from fieldglass.operators import fragments, tracks

BOXES = "camera_id string, track_id bigint, frame bigint, x1 double, y1 double, x2 double, y2 double, class_name string, confidence double"


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a, b):
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def centre(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def size(b):
    return math.sqrt(max(area(b), 1))


def plain(rows, fps=25.0, same=(), looks=None, least=0.0):
    """Vehicle numbers by (device, track) for one device's boxes at a time."""
    out = {}
    devices = defaultdict(lambda: defaultdict(list))
    for device, track, frame, *box, name, score in rows:
        devices[device][track].append((frame, tuple(box), name, score))
    for device, seen in devices.items():
        for track in seen:
            seen[track].sort()
        middle = {t: tuple(median(r[1][k] for r in s) for k in range(4)) for t, s in seen.items()}
        stands = {t: len(s) >= 3 and sum(math.dist(centre(r[1]), centre(middle[t])) < 0.25 * size(middle[t]) for r in s) >= 0.8 * len(s) for t, s in seen.items()}
        live = [t for t, s in seen.items() if not (stands[t] and max(r[3] for r in s) < 0.65)]
        kind = {}
        for t in live:
            names = [r[2] for r in seen[t]]
            kind[t] = min(set(names), key=lambda n: (-names.count(n), n)) in fragments.TWO_WHEELED
        group = {t: {t} for t in live}

        def unite(a, b):
            if group[a] is not group[b]:
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]

        def alike(a, which_a, b, which_b):
            if looks is None:
                return True
            if (device, a) not in looks or (device, b) not in looks:
                return False
            h, g = looks[device, a][which_a], looks[device, b][which_b]
            return sum(math.sqrt(x * y) for x, y in zip(h, g, strict=True)) / math.sqrt(sum(h) * sum(g)) >= least

        for d, a, b in same:
            if d == device and a in group and b in group:
                unite(a, b)
        for a in live:
            for b in live:
                if a >= b or not alike(a, 1, b, 1):
                    continue
                at = {r[0]: r[1] for r in seen[a]}
                both = [(at[r[0]], r[1]) for r in seen[b] if r[0] in at]
                if len(both) >= 3 and (median(iou(*p) for p in both) >= 0.6 or (median(overlap(*p) / min(map(area, p)) for p in both) >= 0.85 and median(min(map(area, p)) / max(map(area, p)) for p in both) >= 0.5)):
                    unite(a, b)
                gap = max(seen[a][0][0], seen[b][0][0]) - min(seen[a][-1][0], seen[b][-1][0])
                if stands[a] and stands[b] and kind[a] == kind[b] and gap <= 120 * fps and iou(middle[a], middle[b]) >= 0.5:
                    unite(a, b)
        pairs = []
        for a in live:
            f, box = seen[a][-1][:2]
            began = next(r for r in seen[a] if f - r[0] <= fps)
            v = [0.0, 0.0] if began[0] == f else [(p - q) / (f - began[0]) for p, q in zip(centre(box), centre(began[1]), strict=True)]
            still = began[0] == f or math.dist(centre(box), centre(began[1])) < 0.15 * size(box)
            for b in live:
                g, new = seen[b][0][:2]
                gap = g - f
                if gap <= 0 or kind[a] != kind[b] or not alike(a, 2, b, 0):
                    continue
                second = [r for r in seen[b] if r[0] - g <= fps][-1][1]
                if still and math.dist(centre(second), centre(new)) < 0.15 * size(new) and len(seen[b]) >= 3 and gap <= 120 * fps:
                    if iou(box, new) >= 0.5:
                        pairs.append((1 - iou(box, new) + gap / (120 * fps), a, b))
                elif gap <= 2 * fps and 0.4 <= area(new) / area(box) <= 2.5:
                    due = [c + s * gap for c, s in zip(centre(box), v, strict=True)]
                    d = math.dist(due, centre(new)) / math.sqrt(max(area(box), area(new)))
                    if d <= 0.6:
                        pairs.append((d + 0.5 * gap / (2 * fps), a, b))
        used_a, used_b = set(), set()
        for _, a, b in sorted(pairs):
            if a not in used_a and b not in used_b and group[a] is not group[b]:
                used_a.add(a)
                used_b.add(b)
                unite(a, b)
        found = {id(g): g for g in group.values()}.values()
        kept = sorted((min(seen[t][0][0] for t in g), min(g), g) for g in found if sum(len(seen[t]) for t in g) >= 3)
        out |= {(device, t): None for t in seen}
        for n, (_, _, g) in enumerate(kept, 1):
            out |= {(device, t): n for t in g}
    return out


def scene(seed):
    """Vehicles that drive, follow, stand and lose their ids, on two devices with the same track numbers."""
    rng = random.Random(seed)
    rows = []
    for device in "pq":
        track = 0
        for _ in range(14):
            x, y, v = rng.uniform(0, 600), rng.uniform(0, 120), rng.choice((0, 0, 2.5, 4))
            w, h = rng.uniform(30, 60), rng.uniform(25, 45)
            name, score = rng.choice(("car", "car", "truck", "motorcycle")), rng.choice((0.5, 0.9, 0.9))
            frame, end = rng.randint(0, 80), rng.randint(150, 300)
            while frame < end:
                track += 1
                for _ in range(rng.choice((1, 2, 8, 20, 30))):
                    jitter = rng.uniform(-1.5, 1.5)
                    box = (x + v * frame + jitter, y, x + v * frame + jitter + w, y + h)
                    rows.append((device, track, frame, *box, name, score * rng.uniform(0.9, 1)))
                    if rng.random() < 0.4:
                        rows.append((device, track + 500, frame, *(c + 1.0 for c in box), "truck", score))
                    frame += rng.randint(1, 2)
                frame += rng.choice((1, 5, 20, 60))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_vehicles_equal_a_plain_version(spark, seed):
    rows = scene(seed)
    got = {(r.camera_id, r.track_id): r.vehicle for r in fragments.link_fragments(spark.createDataFrame(rows, BOXES).repartition(4)).collect()}
    want = plain(rows)
    assert got == want
    assert len({(d, n) for (d, _), n in want.items() if n}) < len(want) / 2 and None in want.values()


def test_a_plain_union_would_be_wrong(spark):
    """One behind the other: both fragments that begin are near both that end, yet two vehicles stay two."""
    rows = []
    for track, x, frames in ((1, 0, range(0, 20)), (2, 15, range(0, 20)), (3, 0, range(24, 40)), (4, 15, range(24, 40))):
        rows += [("p", track, f, x + 3.0 * f, 0.0, x + 3.0 * f + 40, 30.0, "car", 0.9) for f in frames]
    df = spark.createDataFrame(rows, BOXES)
    pairs = fragments.continuation_pairs(fragments.described(df, 25.0), 25.0, 50.0, 3000.0).collect()
    assert {(r.a.track_id, r.b.track_id) for r in pairs} == {(1, 3), (1, 4), (2, 3), (2, 4)}
    got = {r.track_id: r.vehicle for r in fragments.link_fragments(df).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2}


def test_known_groups_and_looks(spark):
    rows = scene(3)
    ids = sorted({(r[0], r[1]) for r in rows})
    rng = random.Random(4)
    same = [(*rng.choice(ids), rng.choice(ids)[1]) for _ in range(4)] + [("p", 99999, 1)]
    looks = {k: [[rng.random() + 0.1 for _ in range(4)] for _ in range(3)] for k in ids if rng.random() < 0.9}
    looked = spark.createDataFrame([(*k, *v) for k, v in looks.items()], "camera_id string, track_id bigint, early array<double>, middle array<double>, late array<double>")
    known = spark.createDataFrame(same, "camera_id string, a bigint, b bigint")
    found = fragments.link_fragments(spark.createDataFrame(rows, BOXES), same=known, appearance=looked, least_alike=0.9)
    assert {(r.camera_id, r.track_id): r.vehicle for r in found.collect()} == plain(rows, same=same, looks=looks, least=0.9)


def test_no_boxes(spark):
    assert fragments.link_fragments(spark.createDataFrame([], BOXES)).count() == 0


def test_duplicates_stay_within_a_device(spark):
    """Equal track numbers on several devices: frames of different devices don't add up."""
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [(d, t, 1, *box, "car", 0.9) for d in "abc" for t in (1, 2)] + [("d", t, f, *box, "car", 0.9) for f in (1, 2, 3) for t in (1, 2)]
    got = tracks.duplicates(spark.createDataFrame(rows, BOXES), ["camera_id", "frame"]).collect()
    assert [(r.camera_id, r.a, r.b) for r in got] == [("d", 1, 2)]
