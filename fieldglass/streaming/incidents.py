"""Incidents on a stream of boxes: persons among moving traffic, collisions, intrusions.

A device's frames are judged in the order of their times, whatever order rows come
in: rows wait until the watermark has passed them. State is kept by device: the last
PLACES places and speeds of each track, when it was exposed or entered the zone, and
what was raised lately. Timers drop tracks that weren't seen for a while, so a device
that falls silent leaves nothing behind; a cut of its media clock drops all at once.

Speeds are in heights of the box a second, so they hold near and far. All tracks of a
frame are moved before any is judged.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Places that a track keeps; seconds that a track must last to be judged, and may be lost; seconds between two reports of one thing.
PLACES, LEAST_SECONDS, LOST_SECONDS, COOLDOWN = 12, 1.2, 30.0, 20.0
# What a motion must be to be trusted: places, longest gap in seconds, longest step in heights.
TRUSTED_PLACES, TRUSTED_GAP, TRUSTED_STEP = 4, 1.0, 1.5
# Heights a second from which on a vehicle moves.
MOVING = 0.45
# Overlap of a person with traffic, and seconds that it must last and that clear it.
EXPOSED_IOU, EXPOSED_SECONDS, CLEAR_SECONDS = 0.05, 2.0, 3.0
# Overlap of a collision, share of the smaller box that makes it one vehicle, braking of both, and vehicles that flow on.
COLLISION_IOU, NESTED, BRAKING, FLOWING = 0.18, 0.85, 0.40, 2
# Share of the frame's height that a box must have, and how near an edge it may be.
LEAST_HEIGHT, EDGE = 0.06, 0.02
# Milliseconds that a media clock jumps back at a cut, or where it begins anew.
CUT_BACK, CUT_BEGIN = 2000, 300
VEHICLES = frozenset(("car", "motorcycle", "scooter", "bus", "truck", "auto-rickshaw", "bicycle"))
PERSON = "person"

BOX = "us bigint, track_id bigint, label string, x1 double, y1 double, x2 double, y2 double, pts bigint"
TRACK = "label string, first double, last double, places array<struct<t:double,x:double,y:double,h:double>>, speeds array<struct<t:double,v:double>>, x1 double, y1 double, x2 double, y2 double, exposed_since double, exposed_last double, zone_since double"
INCIDENT = "camera_id bigint, kind string, tracks array<bigint>, begun timestamp, raised timestamp"


@dataclass
class Zone:
    """A closed region (corners in shares of the frame), whom it is closed to (none: all), the hours (UTC) and the seconds allowed."""

    corners: list[tuple[float, float]]
    labels: frozenset[str] = frozenset()
    hours: tuple[int, int] | None = None
    dwell: float = 2.0

    def armed(self, now: float) -> bool:
        if self.hours is None:
            return True
        hour, (start, end) = datetime.fromtimestamp(now, timezone.utc).hour, self.hours
        return start <= hour < end if start <= end else hour >= start or hour < end

    def holds(self, x: float, y: float) -> bool:
        inside = False
        for (ax, ay), (bx, by) in zip(self.corners, self.corners[1:] + self.corners[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
        return inside


@dataclass
class Track:
    """What is known of a track: its last places (time, centre, height) and speeds, and what it is in the middle of."""

    label: str
    first: float
    last: float
    places: list[tuple[float, float, float, float]] = field(default_factory=list)
    speeds: list[tuple[float, float]] = field(default_factory=list)
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    exposed_since: float | None = None
    exposed_last: float | None = None
    zone_since: float | None = None

    def move(self, now: float, label: str, box: tuple[float, float, float, float]) -> None:
        x1, y1, x2, y2 = self.box = box
        self.label, self.last = label, now
        self.places = [*self.places, (now, (x1 + x2) / 2, (y1 + y2) / 2, max(y2 - y1, 1.0))][-PLACES:]
        took = now - self.places[0][0]
        if len(self.places) > 1 and took > 0.05:
            way = sum(math.dist(a[1:3], b[1:3]) / ((a[3] + b[3]) / 2) for a, b in zip(self.places, self.places[1:], strict=False))
            self.speeds = [*self.speeds, (now, way / took)][-PLACES:]

    def speed(self) -> float | None:
        """The latest speed, if it is known."""
        return self.speeds[-1][1] if self.speeds else None

    def moves(self) -> bool:
        return self.label in VEHICLES and bool(self.speeds) and self.speeds[-1][1] > MOVING

    def braking(self) -> float | None:
        """How fast the mean speed falls from the earlier to the later half."""
        half = len(self.speeds) // 2
        if half < 2:
            return None
        (t0, v0), (t1, v1) = ([sum(c) / half for c in zip(*part, strict=True)] for part in (self.speeds[:half], self.speeds[-half:]))
        return (v0 - v1) / (t1 - t0) if t1 - t0 > 0.05 else None

    def trusted(self) -> bool:
        steps = zip(self.places, self.places[1:], strict=False)
        return len(self.places) >= TRUSTED_PLACES and all(b[0] - a[0] <= TRUSTED_GAP and math.dist(a[1:3], b[1:3]) / b[3] <= TRUSTED_STEP for a, b in steps)

    def judged(self, now: float) -> bool:
        return now - self.first >= LEAST_SECONDS and bool(self.speeds) and self.speeds[-1][0] == now and self.trusted()

    def in_view(self, frame: tuple[float, float] | None) -> bool:
        if frame is None:
            return True
        (w, h), (x1, y1, x2, y2) = frame, self.box
        return y2 - y1 >= LEAST_HEIGHT * h and x1 > EDGE * w and y1 > EDGE * h and x2 < w - EDGE * w and y2 < h - EDGE * h

    def square(self) -> tuple[float, float, float, float]:
        """A square of the box's height about its centre."""
        _, x, y, h = self.places[-1]
        return (x - h / 2, y - h / 2, x + h / 2, y + h / 2)


def _overlap(a: tuple, b: tuple) -> tuple[float, float]:
    """Intersection over union, and as a share of the smaller box."""
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    areas = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    whole, least = sum(areas) - both, min(areas)
    return (both / whole if whole > 0 else 0.0), (both / least if least > 0 else 0.0)


def judge(tracks: dict[int, Track], fired: dict[str, float], seen: list[int], now: float, zone: Zone | None, frame: tuple[float, float] | None) -> Iterator[tuple[str, list[int], float]]:
    """The incidents (kind, tracks, begun) of a frame whose tracks ``seen`` have moved; updates tracks and ``fired``."""

    def fire(kind: str, who: list[int]) -> bool:
        key = f"{kind} {' '.join(map(str, who))}"
        if now - fired.get(key, -math.inf) < COOLDOWN:
            return False
        fired[key] = now
        return True

    here = {i: tracks[i] for i in sorted(seen)}
    flowing = {i for i, t in here.items() if t.moves() and t.trusted()}
    for i, t in here.items():
        if zone and (not zone.labels or t.label in zone.labels) and zone.armed(now):
            w, h = frame or (1.0, 1.0)
            if not zone.holds((t.box[0] + t.box[2]) / 2 / w, t.box[3] / h):
                t.zone_since = None
            else:
                t.zone_since = now if t.zone_since is None else t.zone_since
                if now - t.zone_since >= zone.dwell and fire("INTRUSION", [i]):
                    yield "INTRUSION", [i], t.zone_since
        if t.label == PERSON and t.judged(now):
            near = next((j for j, v in here.items() if j != i and v.moves() and _overlap(t.square(), v.square())[0] >= EXPOSED_IOU), None)
            if near is not None:
                t.exposed_last = now
                t.exposed_since = now if t.exposed_since is None else t.exposed_since
            elif t.exposed_since is not None and now - t.exposed_last > CLEAR_SECONDS:
                t.exposed_since = None
            if t.exposed_since is not None and now - t.exposed_since >= EXPOSED_SECONDS and fire("PERSON_ON_CARRIAGEWAY", [i]):
                yield "PERSON_ON_CARRIAGEWAY", [i, *([near] if near is not None else [])], t.exposed_since
    brake = {i: t for i, t in here.items() if t.label in VEHICLES and t.judged(now) and t.in_view(frame) and t.speed() < MOVING and (t.braking() or 0.0) >= BRAKING}
    for i, a in brake.items():
        for j, b in brake.items():
            if i < j:
                iou, inside = _overlap(a.box, b.box)
                if iou >= COLLISION_IOU and inside < NESTED and len(flowing - {i, j}) >= FLOWING and fire("COLLISION_CANDIDATE", [i, j]):
                    yield "COLLISION_CANDIDATE", [i, j], min(a.first, b.first)


class Detector(StatefulProcessor):
    """The rules on the frames of a device; see the module's text."""

    def __init__(self, zone: Zone | None = None, frame: tuple[float, float] | None = None) -> None:
        self.zone, self.frame = zone, frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BOX)
        self.tracks = handle.getMapState("tracks", "track_id bigint", TRACK)
        self.fired = handle.getMapState("fired", "what string", "at double")
        self.clock = handle.getValueState("clock", "pts bigint")
        self.drop = handle.getValueState("drop", "ms bigint")  # when the last timer is due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found, timers = [], set()
        for r in rows:
            if r.track_id is not None and r.us is not None:
                found.append((r.us, r.track_id, r.label, r.x1, r.y1, r.x2, r.y2, r.pts))
                timers.add(-(-r.us // 1_000_000) * 1000)  # one for each second that rows came for
        if found:
            self.waiting.appendList(found)
        for t in timers:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all frames that the watermark has passed are whole, so the first of its timers judges them
        expired = expiredTimerInfo.getExpiryTimeInMs()
        until = max(expired, timerValues.getCurrentWatermarkInMs()) * 1000
        if not self.waiting.exists() and not (self.drop.exists() and expired >= self.drop.get()[0]):
            return
        frames, later = {}, []
        for r in self.waiting.get():
            if r[0] <= until:
                frames.setdefault(r[0], []).append(tuple(r))
            else:
                later.append(tuple(r))
        if frames:
            self.waiting.put(later) if later else self.waiting.clear()
        tracks, fired = self._load()
        clock = self.clock.get()[0] if self.clock.exists() else None
        out, changed = [], set()
        for us in sorted(frames):
            now, rows = us / 1e6, sorted(frames[us], key=lambda r: r[1:])
            pts = max((r[7] for r in rows if r[7] is not None), default=None)
            if pts is not None:
                if clock is not None and pts < clock and (clock - pts > CUT_BACK or pts < CUT_BEGIN):
                    tracks.clear()
                    fired.clear()
                clock = pts
            for i in [i for i, t in tracks.items() if now - t.last > LOST_SECONDS]:
                del tracks[i]
            for _, i, label, *box, _ in rows:
                if i not in tracks:
                    tracks[i] = Track(label or "", now, now)
                tracks[i].move(now, label or tracks[i].label, tuple(box))
                changed.add(i)
            out += [(kind, who, begun, now) for kind, who, begun in judge(tracks, fired, sorted({r[1] for r in rows}), now, self.zone, self.frame)]
        # no frame comes any more before the next that waits, or else before the watermark
        now = min(r[0] for r in later) / 1e6 if later else max(until / 1e6, timerValues.getCurrentWatermarkInMs() / 1e3)
        tracks = {i: t for i, t in tracks.items() if now - t.last <= LOST_SECONDS}
        fired = {k: t for k, t in fired.items() if now - t < max(COOLDOWN, LOST_SECONDS)}
        self._keep(tracks, fired, changed, clock, int(now * 1000))
        for kind, who, begun, raised in out:
            yield Row(camera_id=key[0], kind=kind, tracks=who, begun=_moment(begun), raised=_moment(raised))

    def _load(self) -> tuple[dict[int, Track], dict[str, float]]:
        tracks = {}
        for (i,), v in self.tracks.iterator():
            label, first, last, places, speeds, x1, y1, x2, y2, *spells = v
            tracks[i] = Track(label, first, last, [tuple(p) for p in places], [tuple(s) for s in speeds], (x1, y1, x2, y2), *spells)
        return tracks, {k: at for (k,), (at,) in self.fired.iterator()}

    def _keep(self, tracks: dict[int, Track], fired: dict[str, float], changed: set[int], clock: int | None, until: int) -> None:
        for (i,) in list(self.tracks.keys()):
            if i not in tracks:
                self.tracks.removeKey((i,))
        for i, t in tracks.items():
            if i in changed:
                self.tracks.updateValue((i,), (t.label, t.first, t.last, t.places, t.speeds, *t.box, t.exposed_since, t.exposed_last, t.zone_since))
        for (k,) in list(self.fired.keys()):
            if k not in fired:
                self.fired.removeKey((k,))
        for k, at in fired.items():
            self.fired.updateValue((k,), (at,))
        if not tracks and not fired and not self.waiting.exists():
            self.clock.clear()
            self.drop.clear()
            return
        if clock is not None:
            self.clock.update((clock,))
        due = until + int(LOST_SECONDS * 1000) + 1  # to drop what isn't seen again
        self.drop.update((due,))
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(round(seconds, 6), timezone.utc).replace(tzinfo=None)


def incidents(boxes: DataFrame, zone: Zone | None = None, frame: tuple[float, float] | None = None, delay: str = "10 seconds") -> DataFrame:
    """Incidents of a stream of boxes (camera_id, ts, track_id, label, x1, y1, x2, y2, pts).

    ``pts`` is the media clock in milliseconds (null: unknown). Rows without a track
    only move the watermark on. Rows that come later than ``delay`` are dropped.
    """
    rows = boxes.withWatermark("ts", delay).select("camera_id", "ts", F.unix_micros("ts").alias("us"), F.col("track_id").cast("bigint").alias("track_id"), "label", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("pts").cast("bigint").alias("pts"))
    return rows.groupBy("camera_id").transformWithState(Detector(zone, frame), INCIDENT, "Append", "EventTime")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A block in which streams are started with the state store that maps, lists and timers need."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
