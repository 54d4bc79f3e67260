"""Incidents on a stream against a plain version that looks at whole tracks."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

from fieldglass.plans import catalogue, q_streams
from fieldglass.store import new_path
from fieldglass.streaming import incidents, ingest

T0 = datetime(2024, 1, 1, 21, 59, 50)
ROWS = "camera_id bigint, ts timestamp, track_id bigint, label string, x1 double, y1 double, x2 double, y2 double, pts bigint"
ZONE = incidents.Zone([(0.6, 0.6), (1.0, 0.6), (1.0, 1.0), (0.6, 1.0)], frozenset(("person",)), (22, 6), 1.0)
FRAME = (800.0, 600.0)


def iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both), both / min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))


def plain(rows, zone=ZONE, frame=FRAME):
    """Every figure of a frame is made anew from all earlier places of a track."""
    out = set()
    devices = defaultdict(lambda: defaultdict(dict))
    for camera, ts, track, label, *box, pts in rows:
        if track is not None:
            devices[camera][(ts - T0).total_seconds()][track] = (label, tuple(box), pts)
    for camera, frames in devices.items():
        past, fired, exposed, inside, clock = defaultdict(list), {}, {}, {}, None

        def speeds(track, past=past):
            found = []
            for k in range(1, len(past[track])):
                p = past[track][max(0, k - 11) : k + 1]
                if p[-1][0] - p[0][0] > 0.05:
                    found.append((p[-1][0], sum(math.hypot(b[1] - a[1], b[2] - a[2]) / ((a[3] + b[3]) / 2) for a, b in zip(p, p[1:], strict=False)) / (p[-1][0] - p[0][0])))
            return found[-12:]

        def trusted(track, past=past):
            p = past[track][-12:]
            return len(p) >= 4 and all(b[0] - a[0] <= 1 and math.hypot(b[1] - a[1], b[2] - a[2]) / b[3] <= 1.5 for a, b in zip(p, p[1:], strict=False))

        def report(kind, who, begun, now, fired=fired, camera=camera):
            key = (kind, tuple(who[: 2 if kind == "COLLISION_CANDIDATE" else 1]))
            if now - fired.get(key, -1e9) >= 20:
                fired[key] = now
                out.add((camera, kind, tuple(who), round(begun, 3), round(now, 3)))

        for now in sorted(frames):
            seen = frames[now]
            pts = max((r[2] for r in seen.values() if r[2] is not None), default=None)
            if pts is not None:
                if clock is not None and pts < clock and (clock - pts > 2000 or pts < 300):
                    for state in (past, fired, exposed, inside):
                        state.clear()
                clock = pts
            for gone in [t for t, p in past.items() if p and now - p[-1][0] > 30]:
                for state in (past, exposed, inside):
                    state.pop(gone, None)
            for t, (_, b, _) in seen.items():
                past[t].append((now, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, max(b[3] - b[1], 1)))
            speed = {t: speeds(t) for t in seen}
            vehicle = {t: seen[t][0] in incidents.VEHICLES for t in seen}
            moving = {t for t in seen if vehicle[t] and speed[t] and speed[t][-1][1] > 0.45}
            judged = {t for t in seen if now - past[t][0][0] >= 1.2 and speed[t] and trusted(t)}
            square = {t: (past[t][-1][1] - past[t][-1][3] / 2, past[t][-1][2] - past[t][-1][3] / 2, past[t][-1][1] + past[t][-1][3] / 2, past[t][-1][2] + past[t][-1][3] / 2) for t in seen}
            hour = (T0 + timedelta(seconds=now)).hour
            for t in sorted(seen):
                label, b, _ = seen[t]
                if label in zone.labels and (hour >= 22 or hour < 6):
                    x, y = (b[0] + b[2]) / 2 / frame[0], b[3] / frame[1]
                    if 0.6 <= x < 1.0 and 0.6 <= y < 1.0:
                        inside.setdefault(t, now)
                        if now - inside[t] >= zone.dwell:
                            report("INTRUSION", [t], inside[t], now)
                    else:
                        inside.pop(t, None)
                if label == "person" and t in judged:
                    near = next((v for v in sorted(moving) if iou(square[t], square[v])[0] >= 0.05), None)
                    since, last = exposed.get(t, (None, None))
                    if near is not None:
                        since, last = (now if since is None else since), now
                    elif since is not None and now - last > 3:
                        since = None
                    exposed[t] = (since, last)
                    if since is not None and now - since >= 2:
                        report("PERSON_ON_CARRIAGEWAY", [t, *([near] if near is not None else [])], since, now)

            def brakes(t):
                half = len(speed[t]) // 2
                if half < 2 or not speed[t][-1][1] < 0.45:
                    return False
                (ta, va), (tb, vb) = ((sum(x for x, _ in p) / half, sum(v for _, v in p) / half) for p in (speed[t][:half], speed[t][-half:]))
                return tb - ta > 0.05 and (va - vb) / (tb - ta) >= 0.4

            def in_view(t):
                x1, y1, x2, y2 = seen[t][1]
                return y2 - y1 >= 0.06 * frame[1] and x1 > 0.02 * frame[0] and y1 > 0.02 * frame[1] and x2 < 0.98 * frame[0] and y2 < 0.98 * frame[1]

            for a in sorted(seen):
                for b in sorted(seen):
                    if a < b and all(vehicle[t] and t in judged and in_view(t) and brakes(t) for t in (a, b)):
                        over, part = iou(seen[a][1], seen[b][1])
                        if over >= 0.18 and part < 0.85 and sum(v not in (a, b) and trusted(v) for v in moving) >= 2:
                            report("COLLISION_CANDIDATE", [a, b], min(past[a][0][0], past[b][0][0]), now)
    return out


def scene(seed):
    """A road with traffic, persons that stand in it, vehicles that meet and stop, one lost for long, and a cut of the clock."""
    rng = random.Random(seed)
    rows = []
    for camera in (1, 2, 3):
        cars = [(10 + i, rng.uniform(-300, 300), 200 + 60 * (i % 3), rng.choice((20, 25, 30)) / 1.0) for i in range(7)]
        people = [(50 + i, rng.uniform(100, 700), rng.choice((200, 260, 320, 470)), rng.choice((0.0, 4.0))) for i in range(5)]
        for k in range(160):
            now, pts = 0.2 * k, (200 * k if k < 110 or camera == 2 else 200 * (k - 110))
            ts = T0 + timedelta(seconds=round(now, 3))
            for i, x, y, v in cars:
                at = x + v * k * 0.4
                if at < 760 and rng.random() < 0.97:
                    rows.append((camera, ts, i, "car", at, float(y), at + 70, y + 50.0, pts))
            for i, x, y, v in people:
                if not (i == 51 and 20 < k < 35):
                    at = x + v * math.sin(k / 9)
                    rows.append((camera, ts, i, "person", at, float(y), at + 20, y + 45.0, pts))
            for i, sign, start in ((80, 1, 100), (81, -1, 513)):
                at = start + sign * 15.6 * min(k, 12)
                rows.append((camera, ts, i, "truck", at, 100.0, at + 60, 160.0, pts))
    return rows


def run(spark, tmp_path, rows, parts, **more):
    path, out = str(tmp_path / "in"), new_path(spark, "incidents")
    end = [(-1, T0 + timedelta(hours=2), None, None, None, None, None, None, None)]
    ordered = sorted(rows, key=lambda r: r[1])
    size = -(-len(ordered) // parts)
    found = []
    with incidents.keyed_state(spark):
        for part in [ordered[k : k + size] for k in range(0, len(ordered), size)] + [end]:
            random.Random(3).shuffle(part)
            spark.createDataFrame(part, ROWS).repartition(3).write.mode("append").parquet(path)
            stream = spark.readStream.schema(ROWS).parquet(path)
            ingest.run_once(incidents.incidents(stream, ZONE, FRAME, **more), out, lambda batch, number: found.extend(batch.collect()))
    return {(r.camera_id, r.kind, tuple(r.tracks), round((r.begun - T0).total_seconds(), 3), round((r.raised - T0).total_seconds(), 3)) for r in found}, out, len(found)


def test_stream_equals_a_plain_version(spark, tmp_path):
    rows = scene(1)
    want = plain(rows)
    got, out, n = run(spark, tmp_path, rows, 3)
    assert got == want and n == len(want)
    assert {k for _, k, *_ in want} == {"INTRUSION", "PERSON_ON_CARRIAGEWAY", "COLLISION_CANDIDATE"}
    left = spark.read.format("state-metadata").load(f"{out}-progress").select("stateStoreName").distinct().collect()
    assert left
    for name in ("tracks", "fired"):
        assert spark.read.format("statestore").option("stateVarName", name).load(f"{out}-progress").count() == 0
    assert spark.read.format("statestore").option("stateVarName", "clock").load(f"{out}-progress").filter("value is not null").count() == 0


def test_query_equals_a_plain_version(spark, sf_dir):
    boxes = q_streams.traffic_boxes(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()
    rows = [(r.camera_id, r.ts, r.track_id, r.label, r.x1, r.y1, r.x2, r.y2, r.pts) for r in boxes]
    want = {(c, k, w[0], len(w)) for c, k, w, _, _ in plain(rows, q_streams.ZONE, q_streams.FRAME)} if rows else set()
    got = {(r.camera_id, r.kind, r.tracks[0], len(r.tracks)) for r in catalogue.QUERIES["stream_incidents"](spark, sf_dir).collect()}
    assert got == want and {k for _, k, *_ in got} >= {"PERSON_ON_CARRIAGEWAY", "COLLISION_CANDIDATE"}


def test_hours_may_pass_midnight():
    day = incidents.Zone([(0, 0), (1, 0), (1, 1)], hours=(8, 18))
    assert [ZONE.armed(3600 * h) for h in (5, 6, 21, 22, 23)] == [True, False, False, True, True]
    assert [day.armed(3600 * h) for h in (7, 8, 17, 18)] == [False, True, True, False] and incidents.Zone([]).armed(0)
    assert ZONE.holds(0.7, 0.7) and not ZONE.holds(0.5, 0.7)
