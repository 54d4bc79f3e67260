import gzip
import io

import pytest

from fieldglass.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, digest int")


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\nx: y\r\n" + "é" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "http://h/a b\nc", ""), (102, "x", "z" * 300_000), (5, "again", rows[5][2]), (5, "again", rows[5][2])]
    df = pages(spark, [(*r, "mine", 1) for r in rows]).repartition(4)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, records_per_file=50)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    responses = {r.capture_id: int(r.metadata.fields.split(":")[1]) for r in got if r.record_type == "response"}
    for r in got:
        page = int(r.metadata.fields.split(":")[1])
        html = next(h or "" for i, _, h in rows if i == page)
        assert r.response.payload_bytes == len(html.encode()) and r.response.digest == warc.digest_of(html.encode())
        assert r.request.http_headers.startswith("GET ")
        if first[html] == page:
            assert r.record_type == "response" and bytes(r.response.payload).decode() == html and r.refers_to is None
        else:
            assert r.record_type == "revisit" and responses[r.refers_to] == first[html]


def test_small_payloads_and_empty(spark, tmp_path):
    df = pages(spark, [(1, "u", "same", "", 0), (2, "u", "same", "", 0)])
    warc.write_archives(df, str(tmp_path / "a"), least_bytes=5, compression="none")
    kinds = [r.record_type for r in warc.assemble(warc.read_archives(spark, str(tmp_path / "a"), False)).collect()]
    assert kinds == ["response", "response"]
    warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "b"))).count() == 0


def test_members_and_damage():
    records = list(warc.capture_records(1, "http://x", "body", None))
    members = b"".join(gzip.compress((r + warc.RECORD_END).encode()) for r in records)
    assert [h["warc-type"] for h, _ in warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(members)))] == ["response", "request", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(records[0].encode()[:-2])))
    (headers, block), *_ = warc.parse_records(io.BytesIO((records[0] + warc.RECORD_END).encode()))
    with pytest.raises(ValueError):
        warc._row(headers, block + b"x", True)
