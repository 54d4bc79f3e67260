"""Hierarchical multi-length packing of tokenised documents.

Each document is routed to the shortest context tier that holds it (512, 1024,
2048 or 4096 tokens by default; what exceeds the longest tier is first cut into
full windows). Every tier is packed on its own: a window starts with fragments
of its tier, and the gap that they leave is filled with whole fragments of
shorter tiers, the largest that fits first, and last with a cut fragment. So
windows close full. Closed windows are dealt to step groups of equal token
totals.

Windows are built inside a task from the rows of its input split, in pools of a
bounded number of tokens: there is no shuffle, a rerun task repeats its result
from the same split, and memory is bounded by the pool and the longest single
document. What a pool can't close is carried into the next one; at the end of a
task the rest is cut by powers of two, so it needs no padding either.

Cases: null or empty text gives the end token alone; repeated documents and ids
are packed as often as they occur; an empty table gives no rows; further input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import by_bytes, record_batch, sliced, text_or_empty

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
POOL_TOKENS = 1 << 21
STEP_TOKENS = 8 * 4096
CACHE_WORDS = 250_000
OUT_BYTES = 8 << 20
#: Marks that the tokenizer reads as one word together and that begin none of its contractions.
PUNCTUATION = ".,;:!?%&$#*|"
#: Texts that are cut at spaces alone. In others no character composes with its neighbours or changes its length in
#: lower case, no special token (found before that) can come up, and no point or comma follows a mark, with which it would be one word.
NOT_CUT = r"[^\x00-\x{ff}]|<\||[^\p{L}\p{N} \n][.,]"
#: Bytes of texts that are read together.
GROUP_BYTES = 2 << 20

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, tier int, step_group bigint, ids binary"
)


class WordCache(dict):
    """Ids of whole texts from cached ids of their space-separated chunks.

    The tokenizer drops white space and none of its pieces crosses any, so the
    ids of a text are those of its chunks in order. A chunk of letters and then
    common punctuation is two words to the tokenizer, and each goes straight to
    its BPE model; every other chunk is encoded in full. A full cache becomes the
    old one, from which chunks that come again are taken back, so frequent ones stay;
    that changes no result. Most texts are put in lower case, and the points and
    commas after their words split off, before they are cut, so a word has one entry.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.size = size
        self.old: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.old_letters: dict[str, bytes] = {}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, word: str) -> bytes:
        shown = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a word that is part of a chunk: as a chunk of its own it may be cached already."""
        known = self.get(word) or self.letters.get(word) or self.old.get(word)
        if known is None:
            known = self.letters[word] = self.old_letters.get(word) or self._ids(word)
        return known

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        word = low.rstrip(PUNCTUATION)
        if not word.isalpha() or not (low.isascii() or ("Σ" not in chunk and is_normalized("NFC", chunk))):
            return self._whole(chunk)
        if word == chunk:
            return self._ids(word)
        tail = low[len(word) :]
        if not tail:
            return self._letters(word)
        marks = self.letters.get(tail)
        if marks is None:
            marks = self.letters[tail] = self._whole(tail)
        return self._letters(word) + marks

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self._chunk(chunk) if chunk else b""
        self[chunk] = found
        return found

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        if len(self.letters) > self.size:
            self.old_letters, self.letters = self.letters, {}
        whole = pc.replace_substring(texts, "\n", " ")
        cut = pc.binary_join_element_wise(pc.utf8_lower(whole), "", " ")
        for mark in ".,":
            cut = pc.replace_substring(cut, f"{mark} ", f" {mark} ")
        chunks = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, NOT_CUT), whole, cut), " ")
        coded = chunks.values.dictionary_encode()
        ids = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))).take(coded.indices)
        return lists.offsets.to_numpy()[chunks.offsets.to_numpy()], lists.values.to_numpy()

    def encode_arrow(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of strings, of some at a time: where each one's begin (and where the last one's end), and the ids.

        A chunk that comes more than once is looked up once for all texts that are read together.
        """
        return map(self._group, by_bytes(texts, GROUP_BYTES))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for starts, ids in self.encode_arrow(pa.array(texts, pa.string())):
            for a, b in itertools.pairwise(starts.tolist()):
                yield ids[a:b].tobytes()


@functools.lru_cache(1)
def word_cache(path: str) -> WordCache:
    """The cache of this process, for all its tasks."""
    return WordCache(path)


class Fragment:
    """A run of ids of one document that no window holds yet."""

    __slots__ = ("doc", "ids", "start", "size", "total")

    def __init__(self, doc: int, ids: bytes, start: int, size: int, total: int) -> None:
        self.doc, self.ids, self.start, self.size, self.total = doc, ids, start, size, total

    def cut(self, size: int) -> tuple[Fragment, Fragment]:
        """The first ``size`` ids, and the rest."""
        return (
            Fragment(self.doc, self.ids, self.start, size, self.total),
            Fragment(self.doc, self.ids, self.start + size, self.size - size, self.total),
        )


class Shelf:
    """Fragments by size; takes the largest up to a size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: list[Fragment] = []

    def put(self, f: Fragment) -> None:
        at = bisect.bisect_right(self.sizes, f.size)
        self.sizes.insert(at, f.size)
        self.items.insert(at, f)

    def take(self, most: int) -> Fragment | None:
        at = bisect.bisect_right(self.sizes, most) - 1
        if at < 0:
            return None
        self.sizes.pop(at)
        return self.items.pop(at)

    def __len__(self) -> int:
        return len(self.items)


class TierPacker:
    """Packs the documents of one task; see the module's text."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.step_tokens = step_tokens
        self.shelves = [Shelf() for _ in self.tiers]
        self.tokens = 0

    def add(self, doc: int, ids: bytes) -> None:
        total = len(ids) // 4
        self.tokens += total
        rest = Fragment(doc, ids, 0, total, total)
        while rest.size > self.tiers[-1]:
            window, rest = rest.cut(self.tiers[-1])
            self._route(window)
        if rest.size:
            self._route(rest)

    def _route(self, f: Fragment) -> None:
        self.shelves[bisect.bisect_left(self.tiers, f.size)].put(f)

    def _fill(self, tier: int, window: list[Fragment], gap: int) -> int:
        """Fill the gap from this tier's and shorter shelves; returns what stays open."""
        for shelf in reversed(self.shelves[: tier + 1]):
            while gap and (f := shelf.take(gap)):
                window.append(f)
                gap -= f.size
        if gap:  # no whole fragment fits: cut one, from the shortest shelf that has any
            for shelf in self.shelves[: tier + 1]:
                if f := shelf.take(self.tiers[-1]):
                    head, tail = f.cut(gap)
                    window.append(head)
                    self._route(tail)
                    return 0
        return gap

    def close(self, last: bool) -> list[tuple[int, list[Fragment]]]:
        """Windows (tier, fragments) that are full; at the ``last`` call all that is left."""
        full: list[tuple[int, list[Fragment]]] = []
        for tier in reversed(range(len(self.tiers))):
            while self.shelves[tier] and (f := self.shelves[tier].take(self.tiers[tier])):
                window = [f]
                if self._fill(tier, window, self.tiers[tier] - f.size):
                    for f in window:
                        self._route(f)
                    break
                full.append((self.tiers[tier], window))
        if last:
            rest = [f for shelf in self.shelves for f in shelf.items]
            left = sum(f.size for f in rest)
            rest.reverse()
            while left:
                size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
                left -= size
                window, gap = [], size
                while gap:
                    f = rest.pop()
                    if f.size > gap:
                        f, tail = f.cut(gap)
                        rest.append(tail)
                    window.append(f)
                    gap -= f.size
                full.append((size, window))
            self.shelves = [Shelf() for _ in self.tiers]
        self.tokens = sum(sum(s.sizes) for s in self.shelves)
        return full

    def balance(self, windows: list[tuple[int, list[Fragment]]]) -> list[int]:
        """A step group for each window: longest first to the group with the fewest tokens."""
        groups = max(1, round(sum(size for size, _ in windows) / self.step_tokens))
        heap = [(0, g) for g in range(groups)]
        out = [0] * len(windows)
        for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
            load, g = heapq.heappop(heap)
            out[i] = g
            heapq.heappush(heap, (load + windows[i][0], g))
        return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int, pool: int, step: int) -> Iterator[pa.RecordBatch]:
    cache = word_cache(path)
    packer = TierPacker(tiers, step)
    end = np.array([end_id], "<u4").tobytes()
    first = TaskContext.get().partitionId() << 36
    sequences, groups = first, first
    columns = [field.split()[0] for field in SCHEMA.split(",")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return record_batch(dict(zip(columns, zip(*rows, strict=True), strict=True)), SCHEMA)

    def emit(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal sequences, groups
        windows = packer.close(last)
        dealt = packer.balance(windows)
        rows, size = [], 0
        for (tier, window), group in zip(windows, dealt, strict=True):
            at = 0
            for f in window:
                rows.append((f.doc, f.start, f.size, f.total, sequences, at, tier, groups + group, f.ids[4 * f.start : 4 * (f.start + f.size)]))
                at += f.size
                size += 4 * f.size
            sequences += 1
            if size >= OUT_BYTES:
                yield table(rows)
                rows, size = [], 0
        groups += max(dealt, default=-1) + 1
        if rows:
            yield table(rows)

    for batch in sliced(batches):
        for doc, ids in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1).to_pylist()), strict=True):
            packer.add(doc, ids + end)
            if packer.tokens >= pool:
                yield from emit(False)
    yield from emit(True)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences; one row for each piece.

    ``ids`` holds the piece's token ids (little-endian unsigned 32-bit), ``start``
    and ``length`` its place in the document, ``sequence_id`` and ``offset`` its
    place in a sequence, ``tier`` the sequence's length and ``step_group`` the
    training step it is dealt to. Null doc_ids stay null.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        lambda batches: _packed(batches, tokenizer_path, tiers, end_id, pool_tokens, step_tokens), SCHEMA
    )
