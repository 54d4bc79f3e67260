import hashlib
import random

import pytest

from fieldglass.llm import media
from tests.llm.helpers import docs


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_that_of_the_format():
    for n in (0, 1, 27, 300):
        data = random.Random(n).randbytes(n)
        assert media.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 254, 255, 256, 15_999, 16_000, 16_320, 65_025, 65_026, 200_001])
def test_bytes_come_back(size):
    raw = random.Random(size).randbytes(size)
    stored = media.encode(raw)
    got = media.decode(stored)
    assert got["payload"] == media.padded(raw) and got["n_bytes"] == size
    assert len(got["payload"]) % 64 == 0 and got["payload"]
    assert got["seconds"] == len(got["payload"]) / media.RATE
    assert media.encode(raw) == stored


def test_damage_is_found():
    stored = bytearray(media.encode(b"some text" * 5000))
    for at in (0, 30, 500, len(stored) - 1):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    for cut in (len(stored) - 1, 100, 40):
        with pytest.raises(ValueError):
            media.decode(bytes(stored[:cut]))


def test_rows(spark):
    df = docs(spark)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    got = media.decode_media(media.encode_media(df)).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.payload in [media.padded(t) for t in texts[r.doc_id]]
        assert r.payload[: r.n_bytes] in texts[r.doc_id]
    same = {hashlib.sha256(r.media).hexdigest() for r in got if r.doc_id in (103, 104)}
    assert len(same) == 1
    assert media.decode_media(media.encode_media(docs(spark, []))).count() == 0
