"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can cross (before runs of word marks, at line ends), and each
new chunk of a task's batches is encoded once: the new chunks are concatenated,
a suffix array over them is built by prefix doubling, every piece is
binary-searched for its range of suffixes (all pieces at once, one character a
step), and the ranges give the edges of a segmentation lattice.

The edges are sorted and relaxed for all chunks together. The public model is a
BPE one, whose result is not the path of the best total score, so relaxation
follows its merges: in every round each chunk takes, of the edges that span just
two neighbouring symbols, the one of the best score, leftmost first, and edges
that begin or end inside a symbol are dropped. That gives the same ids as the
model's own library. A chunk of more than LONG_CHUNK characters, which would need
many rounds, takes its edges, sorted by position, from a queue by score instead.
Characters without a piece become byte pieces.

Cases: null or empty text gives no ids; texts of spaces alone, or with the word
mark itself, are encoded as the library does, so a word mark decodes to a space;
repeated rows repeat; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty

MARK = "▁"
CACHE_CHUNKS = 400_000
BATCH_CHARS = 1_500_000
LONG_CHUNK = 256
#: Characters matched at a time, and bits for a piece's place: a chunk's number, a place and a position share 64 bits.
_SPAN, _PLACE_BITS = 2_000_000, 17
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
DECODED = "doc_id bigint, n_tokens bigint, ids binary, text string"
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Pieces:
    """The pieces of a model file: characters, scores, and ids of bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.score, self.byte = [], [], {}
        ids = []
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids.append(i)
                self.text.append(model.id_to_piece(i))
                self.score.append(model.get_score(i))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.text):
            raise ValueError("a piece crosses a place where texts are cut")
        if len(ids) >> _PLACE_BITS:
            raise ValueError("the model has too many pieces")
        self.unknown = model.unk_id()
        self.shown = [b""] * model.vocab_size()
        for i, p in zip(ids, self.text, strict=True):
            self.shown[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.shown[i] = bytes([b])
        self.longest = max(map(len, self.text))
        self.ids = np.array(ids, np.int64)
        self.places = np.unique(-np.array(self.score), return_inverse=True)[1].astype(np.int64)
        self.id_of = dict(zip(self.text, ids, strict=True))
        self.sizes = np.array([len(p) for p in self.text])
        self.codes = np.zeros((len(ids), self.longest), np.int64)
        for k, p in enumerate(self.text):
            self.codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by their next ``depth`` characters (by doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, done = np.argsort(rank), 1
    while done < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-done or None] = rank[done:] + 1 if done < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        done *= 2
        if fresh[-1] == len(fresh) - 1:
            break
    return order


def piece_ranges(text: np.ndarray, order: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The range of ``order`` whose suffixes begin with each piece; empty if none does."""
    padded = np.concatenate([text, np.full(pieces.longest, -1, np.int64)])
    low, high = np.zeros(len(pieces.ids), np.int64), np.full(len(pieces.ids), len(order), np.int64)

    def bound(at: int, live: np.ndarray, right: bool) -> np.ndarray:
        a, b, want = low[live].copy(), high[live].copy(), pieces.codes[live, at]
        while (a < b).any():
            mid = (a + b) // 2
            here = padded[order[np.minimum(mid, len(order) - 1)] + at]
            below = (here <= want) if right else (here < want)
            go = a < b
            a = np.where(go & below, mid + 1, a)
            b = np.where(go & ~below, mid, b)
        return a

    for at in range(pieces.longest):
        live = np.flatnonzero((pieces.sizes > at) & (low < high))
        if not len(live):
            break
        first, last = bound(at, live, False), bound(at, live, True)
        low[live], high[live] = first, last
    return low, high


def _relax(text: np.ndarray, chunk: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The position that ends each symbol, by where it starts (0 where no symbol does).

    ``place`` is each edge's place among all pieces by falling score.
    """
    until = np.arange(1, len(text) + 1)
    of = chunk[start]
    bits = max(1, int(len(text)).bit_length())
    order = np.argsort((of << (bits + _PLACE_BITS)) | (place << bits) | start)
    start, end, of = start[order], end[order], of[order]
    while len(start):
        middle = until[start]
        two = (middle < end) & (until[np.minimum(middle, len(text) - 1)] == end)
        at = np.flatnonzero(two)
        if not len(at):
            break
        first = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
        s, m, e = start[first], middle[first], end[first]
        until[s], until[m] = e, 0
        # an edge lives on while a symbol begins at its start and at its end, and something is left to merge
        begins = until[start] > 0
        stops = (end == len(text)) | (until[np.minimum(end, len(text) - 1)] > 0)
        live = begins & stops & (until[start] < end) & np.isin(of, of[first])
        start, end, of = start[live], end[live], of[live]
    return until


def _relax_queue(n: int, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As :func:`_relax`, for one chunk of ``n`` characters so long that rounds would be many: best edges come from a queue.

    Edges are sorted by position; one is found by its start and end when these come
    to span two symbols.
    """
    spans = start * (n + 1) + end
    order = np.argsort(spans)
    spans, place = spans[order], place[order]
    until = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and until[at] < n:
            to = until[until[at]]
            k = int(spans.searchsorted(at * (n + 1) + to))
            if k < len(spans) and spans[k] == at * (n + 1) + to:
                heapq.heappush(heap, (int(place[k]), at, to))

    for at in range(n):
        offer(at)
    while heap:
        _, at, to = heapq.heappop(heap)
        middle = until[at]
        if middle == 0 or middle >= to or until[middle] != to:
            continue
        until[at], until[middle] = to, 0
        if to < n:
            before[to] = at
        offer(at)
        offer(before[at])
    return np.array(until, np.int64)


def encode_chunks(chunks: list[str], pieces: Pieces) -> list[bytes]:
    """The ids (little-endian unsigned 32-bit) of each chunk; chunks are matched together."""
    text = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    breaks = np.zeros(len(text), np.int64)
    sizes = np.array([len(c) for c in chunks])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    gaps = starts[1:] - 1
    breaks[starts[1:]] = 1
    chunk = np.cumsum(breaks)
    matched = text.copy()
    matched[gaps] = -1
    order = suffix_array(matched, pieces.longest)
    low, high = piece_ranges(matched, order, pieces)
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = order[np.repeat(low, count) + offset]
    wide = pieces.sizes[piece] > 1
    end = start + pieces.sizes[piece]
    begin, stop, place = start[wide], end[wide], pieces.places[piece[wide]]
    long = sizes[chunk[begin]] > LONG_CHUNK
    until = _relax(text, chunk, begin[~long], stop[~long], place[~long])
    longs, edges = np.flatnonzero(sizes > LONG_CHUNK), np.flatnonzero(long)
    edges = edges[np.argsort(chunk[begin[edges]], kind="stable")]  # by chunk: each long chunk takes its run of edges
    cuts = np.searchsorted(chunk[begin[edges]], [*longs, len(chunks)])
    for k, first, last in zip(longs.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        of = edges[first:last]
        own = _relax_queue(int(sizes[k]), begin[of] - starts[k], stop[of] - starts[k], place[of])
        until[starts[k] : starts[k] + sizes[k]] = np.where(own > 0, own + starts[k], 0)
    # the id of a symbol is that of the edge with its start and end
    ids = np.full(len(text), -1, np.int64)
    fits = until[start] == end
    ids[start[fits]] = pieces.ids[piece[fits]]
    begins = np.flatnonzero(until > 0)
    begins = begins[~np.isin(begins, gaps)]
    found = ids[begins]
    width = np.ones(len(found), np.int64)
    lost = np.flatnonzero(found < 0)
    spelled = [[pieces.byte.get(b, pieces.unknown) for b in chr(c).encode("utf-8", "replace")] for c in text[begins[lost]].tolist()]
    width[lost] = [len(x) for x in spelled]
    flat = np.repeat(found, width)
    flat[np.repeat(found < 0, width)] = [i for x in spelled for i in x]
    cut = 4 * np.concatenate([[0], np.cumsum(width)])[[*np.searchsorted(begins, starts), len(begins)]]
    raw, cut = flat.astype("<u4").tobytes(), cut.tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    """Encodes whole texts; keeps the ids of chunks it has met, up to a bound."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.ids})
        if len(self.ids) + len(new) > CACHE_CHUNKS:
            self.ids = {c: self.ids[c] for chunks in cut for c in chunks if c in self.ids}
        for group in _groups(new, _SPAN):
            self.ids.update(zip(group, encode_chunks(group, self.pieces), strict=True))
        return [b"".join(map(self.ids.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids as encode gives them; byte pieces that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.pieces.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this process, for all its tasks."""
    return Encoder(path)


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters together."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of pieces and their ids for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist(), BATCH_CHARS):
                ids = coder.encode(group)
                yield record_batch({"doc_id": batch.column(0).slice(at, len(group)), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}, ENCODED)
                at += len(group)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (as encode_texts gives them) with the text of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in sliced(batches):
            columns = {name: part.column(i) for i, name in enumerate(("doc_id", "n_tokens", "ids"))}
            yield record_batch(columns | {"text": [coder.decode(x) for x in part.column(2).to_pylist()]}, DECODED)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
