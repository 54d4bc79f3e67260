import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldglass.llm import packing
from fieldglass.llm.queries import TOKENIZER, tokenizer_file

from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def path():
    return tokenizer_file(TOKENIZER)


def check(pieces, want, tiers=packing.TIERS):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for doc, texts in want.items():
        got = defaultdict(bytes)
        total = sum(len(t) for t in texts)
        assert sum(4 * r.length for r in by_doc[doc]) == total
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens * 4 == total
                got[doc] += r.ids
                at += r.length
            assert got[doc] == texts[0]
    assert set(by_doc) == set(want)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tiers[-1]
        padding += 0 if at & (at - 1) == 0 else tiers[-1] - at
    return padding


def test_every_id_is_packed_once_without_padding(spark, path):
    df = docs(spark).repartition(3)
    cache = packing.WordCache(path)
    want = defaultdict(list)
    for r in df.collect():
        ids = cache.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END_ID]
        want[r.doc_id].append(np.array(ids, "<u4").tobytes())
    assert check(packing.pack_documents(df, path).collect(), want) == 0
    assert check(packing.pack_documents(df, path, pool_tokens=5000).collect(), want) == 0


def test_cached_ids_equal_the_tokenizers(path):
    cache = packing.WordCache(path, size=50)
    texts = ["", "Don't STOP, it's İstanbul ΑΣ, x²y ½ 12,3 ÀÉ é ß ẞ", "a b\tc\r\nd", "<|endoftext|> x<|startoftext|>", "'ll ,'s word,' 'word", "é e ́x"]
    for text, ids in zip(texts, cache.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_tiers_groups_and_empty(spark, path):
    got = packing.pack_documents(docs(spark), path, tiers=(64, 128), step_tokens=512).toPandas()
    used = got.groupby("sequence_id").agg(tier=("tier", "first"), length=("length", "sum"), group=("step_group", "first"))
    assert (used["length"] == used["tier"]).all()
    loads = used.groupby("group")["length"].sum()
    assert loads.max() - loads.min() <= 2 * 128
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_crc_is_unsigned_and_little_endian(spark, path):
    from pyspark.sql import functions as F

    r = packing.pack_documents(docs(spark), path).withColumn("c", F.crc32("ids")).first()
    assert r.c == zlib.crc32(r.ids)


def test_a_word_has_one_entry_whatever_its_letters_and_marks(path):
    cache = packing.WordCache(path)
    list(cache.encode(["Stone, stone. STONE stone", "the Stone.\nÉté, été"]))
    assert set(cache) == {"stone", "the", "été", ",", ".", ""} and not cache.letters


def test_marks_and_small_letters_change_no_ids(path):
    rng = np.random.default_rng(3)
    texts = ["<|ENDOFTEXT|> x", "x., y", "IT'S. OK", "a\xa0. b", "\x1c. a", "ª. ²,", "", "Ǆ. ά"]
    texts += ["".join(rng.choice(list("aB .,'\n#s<|>3éÉ\xa0\tRµß\x85Σ"), rng.integers(1, 30))) for _ in range(3000)]
    cache = packing.WordCache(path)
    for text, ids in zip(texts, cache.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text
