"""The registered queries against their SQL, or against plain versions where there is none."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

from fieldglass.llm import htmltext, media
from fieldglass.llm.queries import ORACLES, PIECES, QUERIES, TOKENIZER, tokenizer_file
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLES[name], sf_dir)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_op1_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(TOKENIZER))
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in table(spark, sf_dir, "documents")}
    got = QUERIES["op1_packing"](spark, sf_dir).collect()
    held, placed = {}, {}
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        at = 0
        for start, length in sorted(held[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_op2_html(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op2_html"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "pages")
    assert len(got) == len(rows)
    for r in rows:
        text = htmltext.main_text(r.html or "", htmltext.trained())[0]
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_op7_ogg(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op7_ogg"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents")
    assert len(got) == len(rows)
    stored = {r.doc_id: bytes(r.media) for r in media.encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "media").collect()}
    features = {}
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert features.setdefault(r.text or "", g.feature) == g.feature


def test_op9_sentencepiece(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    got = {r.doc_id: r for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents")
    assert len(got) == len(rows)
    for r in rows:
        ids = model.encode(r.text or "")
        text = model.decode(ids)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (g.decoded_sha256, g.decoded_chars) == (hashlib.sha256(text.encode()).hexdigest(), len(text))
