"""Ogg media columns: texts stored as 8-bit samples in Ogg streams, and read back.

A stored form multiplexes two logical streams: one with the sample blocks, one
with a single packet that describes them. The reader trusts nothing: it verifies
each page's checksum and sequence number, reassembles packets from lacing values
across pages, splits the pages by stream serial and derives timestamps from
granule positions. Everything is row-wise, so the work follows the input splits.

Cases: null text counts as empty and is stored as one block of 64 zero bytes;
equal texts give equal bytes; rows that repeat are stored as often; an empty
table gives no rows; further columns are ignored; damaged bytes raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty

BLOCK = 64
PACKET = 16_000
RATE = 8_000
ROWS = 256
#: Fixed values of the Ogg page header (RFC 3533).
CAPTURE, CONTINUED, BEGIN, END, NO_GRANULE = b"OggS", 1, 2, 4, (1 << 64) - 1
HEADER = struct.Struct("<4sBBQIIIB")
SAMPLES, NOTES = b"\x7fPCM8le\x00", b"\x7fNotes\x00\x00"

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The Ogg checksum: CRC-32 most significant bit first, from zero, not inverted.

    zlib's is the mirrored one, so bytes and result are mirrored around it.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int) -> None:
        self.serial, self.sequence = serial, 0

    def page(self, body: bytes, lacing: bytes, granule: int, flags: int) -> bytes:
        head = HEADER.pack(CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(lacing))
        self.sequence += 1
        page = head + lacing + body
        return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]

    def packets(self, packets: list[bytes], granules: list[int]) -> Iterator[bytes]:
        """Pages that hold the packets; the last one ends the stream."""
        lacing, body, ends = bytearray(), b"".join(packets), []
        for p, g in zip(packets, granules, strict=True):
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            ends.append((len(lacing), g))
        at, ended, continued = 0, 0, 0
        for k in range(0, len(lacing), 255):
            part = bytes(lacing[k : k + 255])
            size, granule = sum(part), NO_GRANULE
            while ended < len(ends) and ends[ended][0] <= k + len(part):
                granule = ends[ended][1]
                ended += 1
            last = END if k + 255 >= len(lacing) else 0
            yield self.page(body[at : at + size], part, granule, continued | last)
            at += size
            continued = CONTINUED if part[-1] == 255 else 0


def padded(raw: bytes) -> bytes:
    """Bytes 0 appended, up to a positive multiple of BLOCK."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def encode(raw: bytes) -> bytes:
    """The Ogg bytes that hold ``raw``, padded, as 8-bit samples."""
    payload = padded(raw)
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    samples, notes = StreamWriter(serial), StreamWriter(serial + 1)
    head = SAMPLES + struct.pack("<IQ", RATE, len(payload))
    blocks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    out = [samples.page(head, bytes([len(head)]), 0, BEGIN)]
    note = NOTES + struct.pack("<Q", len(raw))
    out.append(notes.page(note, bytes([len(note)]), 0, BEGIN | END))
    out += samples.packets(blocks, granules)
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, sequence, lacing, body) of each page, checksums verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError(f"Ogg: a page header is cut off at byte {at}")
        capture, version, flags, granule, serial, sequence, checksum, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError(f"Ogg: no page begins at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"Ogg: the page at byte {at} is cut off")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise ValueError(f"Ogg: the page at byte {at} has a wrong checksum")
        yield flags, granule, serial, sequence, lacing, view[at + 27 + n : end]
        at = end


def streams(media: bytes) -> dict[int, dict]:
    """Packets, page count, granules and end of each logical stream by serial."""
    found: dict[int, dict] = {}
    for flags, granule, serial, sequence, lacing, body in pages(media):
        s = found.setdefault(serial, {"packets": [], "open": None, "pages": 0, "times": [], "ended": False})
        if s["ended"] or sequence != s["pages"] or bool(flags & BEGIN) != (sequence == 0):
            raise ValueError(f"Ogg: page {sequence} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError(f"Ogg: page {sequence} of stream {serial} loses part of a packet")
        at, parts = 0, s["open"] or []
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                parts.append(body[at : at + run])
                s["packets"].append(b"".join(parts))
                at, run, parts = at + run, 0, []
        if lacing and lacing[-1] == 255:
            parts.append(body[at : at + run])
            s["open"] = parts
        else:
            s["open"] = None
        if granule != NO_GRANULE:
            s["times"].append(granule)
        s["pages"] += 1
        s["ended"] = bool(flags & END)
    for serial, s in found.items():
        if not s["ended"] or s["open"] is not None or sorted(s["times"]) != s["times"]:
            raise ValueError(f"Ogg: stream {serial} isn't whole")
    return found


def decode(media: bytes) -> dict:
    """Payload, unpadded length, pages, packets, seconds and a feature string."""
    audio = notes = None
    for s in streams(media).values():
        if s["packets"][0].startswith(SAMPLES):
            audio = s
        elif s["packets"][0].startswith(NOTES):
            notes = s
    if not audio or not notes:
        raise ValueError("Ogg: a logical stream is missing")
    rate, size = struct.unpack_from("<IQ", audio["packets"][0], len(SAMPLES))
    (n_bytes,) = struct.unpack_from("<Q", notes["packets"][0], len(NOTES))
    payload = b"".join(audio["packets"][1:])
    if len(payload) != size or audio["times"][-1] != size:
        raise ValueError("Ogg: samples are missing")
    level = np.frombuffer(payload, np.uint8)
    seconds = audio["times"][-1] / rate
    mean = int(level.sum(dtype=np.int64)) / size
    feature = f"pages={audio['pages'] + notes['pages']};packets={len(audio['packets']) - 1};seconds={seconds:.6f};mean={mean:.4f};peak={int(level.max())}"
    return {"n_bytes": n_bytes, "payload": payload, "n_pages": audio["pages"] + notes["pages"], "n_packets": len(audio["packets"]) - 1, "seconds": seconds, "feature": feature}


ENCODED = "doc_id bigint, media binary"
DECODED = "doc_id bigint, media binary, n_bytes bigint, payload binary, n_pages int, n_packets int, seconds double, feature string"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and the Ogg bytes (``media``) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, ROWS):
            yield record_batch({"doc_id": part.column(0), "media": [encode(x) for x in part.column(1).to_pylist()]}, ENCODED)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("raw")).mapInArrow(run, ENCODED)


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, media and what :func:`decode` finds in it, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, ROWS):
            found = [decode(x) for x in part.column(1).to_pylist()]
            columns = {name: [x[name] for x in found] for name in ("n_bytes", "payload", "n_pages", "n_packets", "seconds", "feature")}
            yield record_batch(columns | {"doc_id": part.column(0), "media": part.column(1)}, DECODED)

    return media.select("doc_id", "media").mapInArrow(run, DECODED)
