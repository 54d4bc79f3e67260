import random
import time

import numpy as np
import pytest
import sentencepiece

from fieldglass.llm import pieces
from fieldglass.llm.queries import PIECES, tokenizer_file
from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def path():
    return tokenizer_file(PIECES)


@pytest.fixture(scope="module")
def model(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_and_texts_equal_the_library(path, model, sf_dir, spark):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "   ", "a▁b ▁▁ c", "  Hello  world\nfoo\t你 é", "x\0y", "<s> </s> <unk> <0x41>", "\n\n \n", "the" * 2000, "".join(rng.choices("abcthein你", k=3000)), "▁" * 900 + "x"]
    texts += ["".join(rng.choices("aAbB éß.,'!% tthein  12\n\tΣ你ё▁😀", k=50)) for _ in range(200)]
    coder = pieces.Encoder(path)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == model.decode(want)


def test_very_long_chunks_equal_the_library(path, model):
    """Chunks of 100,000 characters without a place to cut, beside short ones."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(300)]
    texts = ["".join(rng.choices(words, k=18_000))[:100_000], "x" * 100_000, "".join(rng.choices("日本語中文字体的是", k=20_000)), "one two " + "ab" * 200 + " three", "a" * 256 + " " + "a" * 257]
    coder = pieces.Encoder(path)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)


def test_small_caches_change_nothing(path, monkeypatch):
    texts = ["the river of light", "a house, under stone", "the house of light " * 50, "the river"]
    want = pieces.Encoder(path).encode(texts)
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 3)
    coder = pieces.Encoder(path)
    assert [coder.encode([t])[0] for t in texts] == want


def test_ranges_hold_every_occurrence(path):
    table = pieces.Pieces(path)
    text = np.frombuffer("▁the▁then▁other".encode("utf-32-le"), np.uint32).astype(np.int64)
    order = pieces.suffix_array(text, table.longest)
    whole = "▁the▁then▁other"
    assert [whole[i:] for i in order] == sorted(whole[i:] for i in range(len(whole)))
    low, high = pieces.piece_ranges(text, order, table)
    for p in ("the", "▁the", "he", "e", "other", "zzz"):
        if p in table.id_of:
            k = table.text.index(p)
            found = sorted(order[low[k] : high[k]].tolist())
            assert found == [i for i in range(len(whole)) if whole.startswith(p, i)]


def test_rows(spark, path, model):
    df = docs(spark)
    got = pieces.decode_ids(pieces.encode_texts(df, path), path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, len(model.encode(r.text or ""))) for r in df.collect())
    assert pieces.decode_ids(pieces.encode_texts(df.limit(0), path), path).count() == 0


def test_many_long_lines_take_time_in_proportion(path, model):
    """Lines without spaces that are longer than a chunk should be: each takes its own edges, none scans all."""
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcdefghijklmnoprstuvwx你好世界漢字", k=300)) for _ in range(1500)]
    encoder = pieces.Encoder(path)
    took = []
    for n in (300, 1500):
        began = time.process_time()
        ids = list(encoder.encode(["\n".join(lines[:n])]))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]
    assert np.frombuffer(ids[0], "<u4").tolist() == model.encode("\n".join(lines))
