from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldglass.plans import catalogue
from fieldglass.store import new_path
from fieldglass.streaming import ingest


def test_bursts_with_state(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, "blurred", t0 + timedelta(seconds=s)) for s in (0, 30, 59, 70, 90, 400, 420, 450)] + [(2, "blurred", t0 + timedelta(seconds=s)) for s in (0, 50, 100)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "camera_id bigint, quality string, ts timestamp").write.parquet(path)
    stream = spark.readStream.schema("camera_id bigint, quality string, ts timestamp").parquet(path)
    out = new_path(spark, "out")
    ingest.run_once(ingest.bursts(stream, 60_000_000, 3, 300_000_000), out, ingest.appended(out))
    got = sorted((r.camera_id, (r.raised - t0).seconds) for r in spark.read.parquet(out).collect())
    assert got == [(1, 59), (1, 450)]


def test_replays_and_lateness(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    cams = spark.createDataFrame([(1, "COMMISSIONED", "A"), (2, "SUSPENDED", "A"), (3, "COMMISSIONED", "B")], "camera_id bigint, installation_status string, department string")
    rows = [(1, 1, t0), (1, 1, t0), (2, 2, t0), (3, 3, t0), (4, 9, t0), (5, 1, t0 + timedelta(days=2))]
    spark.createDataFrame(rows, "detection_id bigint, camera_id bigint, ts timestamp").write.parquet(path)
    out = new_path(spark, "verdicts")
    stream = spark.readStream.schema("detection_id bigint, camera_id bigint, ts timestamp").parquet(path)
    ingest.run_once(ingest.verdicts(stream, cams, "A", F.lit(t0 + timedelta(days=1))), out, ingest.appended(out))
    got = {r.detection_id: r.reject_code for r in spark.read.parquet(out).collect()}
    assert got == {1: None, 2: "CAMERA_NOT_COMMISSIONED", 3: "CAMERA_OUT_OF_SCOPE", 4: "UNKNOWN_CAMERA", 5: "INVALID_TIMESTAMP"}
    spark.createDataFrame([(1, 1, t0), (6, 1, t0)], "detection_id bigint, camera_id bigint, ts timestamp").write.mode("append").parquet(path)
    ingest.run_once(ingest.verdicts(stream, cams, "A", F.lit(t0 + timedelta(days=1))), out, ingest.appended(out))
    assert sorted(r.detection_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6]


def test_stream_of_bursts_runs(spark, sf_dir):
    assert catalogue.QUERIES["stream_bursts"](spark, sf_dir).columns == ["camera_id", "quality", "raised"]


def test_a_broken_copy_holds_nothing_up_and_is_mended(spark, tmp_path):
    path, main, copy = str(tmp_path / "in"), new_path(spark, "main"), new_path(spark, "copy")
    write, broken = ingest.appended(copy), {1}

    def fragile(batch, number):
        if number in broken:
            batch.limit(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{copy}/batch={number}")
            raise OSError("disk full")
        write(batch, number)

    failed = []
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(path)
        stream = spark.readStream.schema("id bigint").parquet(path)
        ingest.run_once(stream, main, ingest.mirrored(ingest.appended(main), fragile, failed))
    assert spark.read.parquet(main).count() == 30 and [n for n, _ in failed] == [1]
    assert ingest.repair(spark, main, copy, write) == [1] and ingest.repair(spark, main, copy, write) == []
    assert sorted(r.id for r in spark.read.parquet(copy).collect()) == list(range(30))


def test_a_broken_source_stops_no_other(spark):
    got = {}

    def broken():
        raise TimeoutError("no answer")

    def late():
        return spark.range(3).select(F.raise_error(F.lit("bad row")).alias("x"))

    found = ingest.sweep(spark, {"a": lambda: spark.range(4), "b": broken, "c": late, "d": lambda: spark.range(2)}, lambda name, df: got.setdefault(name, df.collect()))
    rows = {r.source: (r.rows, r.error is None) for r in found.collect()}
    assert rows == {"a": (4, True), "b": (0, False), "c": (0, False), "d": (2, True)} and set(got) == {"a", "d"}


def test_plates_go_when_they_settle_or_are_full(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("A", k, t0 + timedelta(seconds=s)) for k, s in enumerate((0, 5, 9, 40, 41, 42, 43, 44, 90))] + [("B", 50, t0), ("Z", 99, t0 + timedelta(hours=1))]
    path, out = str(tmp_path / "in"), new_path(spark, "held")
    schema = "plate string, sighting_id bigint, ts timestamp"
    for part in (rows[:4], rows[4:10], rows[10:], [("Z", 100, t0 + timedelta(hours=2))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        ingest.run_once(ingest.settled_plates(spark.readStream.schema(schema).parquet(path), 20_000_000, 4, "1 minute"), out, ingest.appended(out))
    got = sorted((r.plate, list(r.ids), r.flushed) for r in spark.read.schema(ingest.HELD + ", batch int").parquet(out).collect())
    assert got == [("A", [0, 1, 2], "settled"), ("A", [3, 4, 5, 6], "full"), ("A", [7], "settled"), ("A", [8], "settled"), ("B", [50], "settled"), ("Z", [99], "settled")]


def test_broken_answers_are_rows_and_the_rest_loads(spark):
    import json

    from fieldglass.sources import answers

    good = json.dumps({"items": [{"id": "1", "n": 2}, {"n": 3}, {"id": "4", "n": None}]})
    lines = [
        {"source": "s", "request": "a", "attempt": 1, "status": 503}, {"source": "s", "request": "a", "attempt": 2, "status": 200, "body": good},
        {"source": "s", "request": "b", "attempt": 1, "status": 200, "body": good[:20]}, {"source": "s", "request": "c", "attempt": 1, "status": 401, "body": "{}"},
        {"source": "s", "request": "d", "attempt": 1, "timed_out": True}, {"source": "s", "request": "e", "attempt": 1, "status": 200, "body": '{"other": 1}'},
        {"source": "s", "request": "f", "attempt": 1, "status": 204, "body": '{"items": []}'}, {"source": "s", "request": "g", "attempt": 1, "status": 302, "body": good},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",), (None,), ("[1]",)], "value string")
    rows = answers.read(df, "id string, n int", "id")
    got = sorted(((r.request, r.attempt, r.item and r.item.id, r.error) for r in rows.collect() if r.request), key=str)
    assert got == sorted([("a", 1, None, "unavailable"), ("a", 2, "1", None), ("a", 2, None, "item"), ("a", 2, "4", None), ("b", 1, None, "protocol"), ("c", 1, None, "auth"), ("d", 1, None, "timeout"), ("e", 1, None, "protocol"), ("f", 1, None, None), ("g", 1, None, "protocol")], key=str)
    assert [r.error for r in rows.collect() if not r.request] == ["unreadable"] * 3
    last = answers.settled(rows)
    assert {(r.request, r.attempt) for r in last.collect() if r.request == "a"} == {("a", 2)} and last.filter("request is null").count() == 3
