"""Language identification, word first with backoff to character n-grams.

Training counts every word of every labelled document by language in Spark.
Words go to the model with their log frequency per language; the types of words
also give the counts of their character n-grams of 3, 2 and 1 letters. A word
that the model knows is scored by its frequencies alone. Any other word is read
left to right in n-grams: the longest known one at each place counts, falling
back to a shorter one where it is unseen in every language.

The counts cover the whole corpus, and all of them count. Each task loads the
words that are most frequent over all languages, with every language's count of
them, and scores them on the way; all other words (4% of the different words of
texts in half a gigabyte) are joined in Spark with the stored counts of words, and
those without a match get their n-grams' scores, from a table of all n-grams as
long as that is small, else from joins too. Every language that occurs is learned.

Cases: null text, or text without letters: ``und`` with score 0, as with a model
of no language; repeated and long texts are scored whole, one by one; ties go to
the language that comes first in the alphabet; null languages don't train;
further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import by_bytes, record_batch, sliced, text_or_empty
from fieldglass.store import job, stored

UNKNOWN = "und"
SIZES = (3, 2, 1)
#: Words (and words times languages) of the table that tasks load; all others are joined.
HEAD_WORDS = 400_000
HEAD_CELLS = 4_000_000
#: Different n-grams times languages up to which tasks load all of them; beyond it they are joined, with the same scores.
GRAM_CELLS = 4_000_000
CACHE_TOKENS = 140_000
PARTIAL = 200_000
#: Bytes of texts that are scanned together, and tokens whose scores are summed at once.
GROUP_BYTES = 2 << 20
BLOCK = 1 << 16
COUNTS = "lang string, word string, n bigint"
_LETTERS = regex.compile(r"\p{L}+")


def spaced(text: str) -> str:
    """The text in lower case; its usual marks, which part words as well, are spaces, so that most tokens are words."""
    return text.lower().replace("\n", " ").replace(".", " ").replace(",", " ")


def words_of(token: str) -> list[str]:
    """The runs of letters in a lower-cased token."""
    return [token] if token.isalpha() else _LETTERS.findall(token)


def _count_batches(lang: str, counts: Counter) -> Iterator[pa.RecordBatch]:
    rows = iter(counts.items())
    while part := list(itertools.islice(rows, 20_000)):
        yield record_batch({"lang": [lang] * len(part), "word": [w for w, _ in part], "n": [n for _, n in part]}, COUNTS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language of one task, let go whenever they grow large."""
    tokens: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in tokens.items():
            words: Counter = Counter()
            for token, n in counts.items():
                for word in words_of(token):
                    words[word] += n
            counts.clear()
            yield from _count_batches(lang, words)
        tokens.clear()

    for batch in sliced(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens.setdefault(lang, Counter()).update(spaced(text).split())
        if sum(map(len, tokens.values())) > PARTIAL:
            yield from out()
    yield from out()


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the word types of one task."""
    grams: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in grams.items():
            yield from _count_batches(lang, counts)
        grams.clear()

    for batch in batches:
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = f" {word} "
            c = grams.setdefault(lang, Counter())
            c.update(word)
            c.update([w[i : i + 2] for i in range(len(w) - 1)])
            c.update([w[i : i + 3] for i in range(len(w) - 2)])
        if sum(map(len, grams.values())) > PARTIAL:
            yield from out()
    yield from out()


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` whose ``total`` is above a level that leaves at most ``most``.

    Levels are powers of 2 ** (1 / 4), and the right one is found from a histogram
    of a few hundred rows.
    """
    level = F.floor(F.log2("total") * 4).cast("int")
    least = None
    for at, types in sorted(((r["level"], r["types"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("types")).collect()), reverse=True):
        most -= types
        if most < 0:
            break
        least = at
    return counts.filter(F.lit(False) if least is None else level >= least)


@dataclass
class Frequencies:
    """Log frequencies of strings by language: ``table[at[string]]``."""

    at: dict[str, int]
    table: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, languages: list[str], totals: dict[str, int]) -> Frequencies:
        """Smoothed log frequencies of counted strings (lang, word, n), in the order of the alphabet."""
        rows = counts.select("lang", "word", "n").toArrow().to_pandas()
        row, words = pd.factorize(rows["word"], sort=True)
        table = np.zeros((len(words), len(languages)))
        table[row, pd.Index(languages).get_indexer(rows["lang"])] = rows["n"]
        size = np.array([totals[lang] for lang in languages], float)
        return cls({w: i for i, w in enumerate(words)}, np.log((table + 0.5) / (size + 1.0)))


@dataclass
class LanguageModel:
    """What words and n-grams say about ``languages``."""

    languages: list[str]
    words: Frequencies = field(default_factory=lambda: Frequencies({}, np.zeros((0, 0))))
    grams: Frequencies = field(default_factory=lambda: Frequencies({}, np.zeros((0, 0))))

    def longest_grams(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each place of the word, shorter where it is unseen."""
        get, w, found = self.grams.at.get, f" {word} ", []
        for i in range(1, len(w) - 1):
            row = get(w[i - 1 : i + 2])
            if row is None:
                row = get(w[i : i + 2])
                if row is None:
                    row = get(w[i])
                    if row is None:
                        continue
            found.append(row)
        return found

    def scores_of(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: its own, or the mean of its n-grams; zeros if it has neither."""
        out = np.zeros((len(words), len(self.languages)))
        known, rows, new, grams, sizes = [], [], [], [], []
        for i, word in enumerate(words):
            row = self.words.at.get(word)
            if row is not None:
                known.append(i)
                rows.append(row)
            elif found := self.longest_grams(word):
                new.append(i)
                grams += found
                sizes.append(len(found))
        if known:
            out[known] = self.words.table[rows]
        if new:
            sums = np.add.reduceat(self.grams.table[grams], np.cumsum([0, *sizes[:-1]]), axis=0)
            out[new] = sums / np.array(sizes)[:, None]
        return out

    def predictor(self):
        """A function from texts to (languages, scores); keeps scores of tokens it has seen."""
        slots: dict[str, int] = {}
        table = [np.zeros((4096, len(self.languages))), np.zeros(4096, np.int64)]

        def look_up(new: list[str]) -> None:
            first, need = len(slots), len(slots) + len(new)
            if need > len(table[1]):
                size = max(need, 2 * len(table[1]))
                table[0] = np.resize(table[0], (size, len(self.languages)))
                table[1] = np.resize(table[1], size)
            slots.update(zip(new, range(first, need), strict=True))
            parts = list(map(words_of, new))
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            scores = self.scores_of([w for ws in parts for w in ws])
            of = np.repeat(np.arange(len(parts)), counts)
            table[0][first:need] = 0
            np.add.at(table[0], first + of, scores)
            table[1][first:need] = counts

        def predict(texts: list[str]) -> tuple[list[str], list[float]]:
            names, scores = [], []
            for text in texts:
                tokens = text.lower().split()
                new = [t for t in set(tokens) if t not in slots]
                if len(slots) + len(new) > CACHE_TOKENS:
                    slots.clear()
                    new = list(set(tokens))
                if new:
                    look_up(new)
                at = np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens))
                if not self.languages or not table[1][at].sum():
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table[0][at].sum(axis=0)
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                names.append(self.languages[best])
                scores.append(float(odds[best] / odds.sum()))
            return names, scores

        return predict

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[dict[str, int]]]:
        """Numbers of words, summed scores of known words and counts of the other words of a batch of texts.

        A token that comes more than once is looked up once for all texts.
        """
        tokens = pc.split_pattern(pa.array(map(spaced, texts.to_numpy(zero_copy_only=False).tolist()), pa.string()), " ")
        coded, begins = tokens.values.dictionary_encode(), tokens.offsets.to_numpy()
        names, of, get = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), self.words.at.get
        rows = np.array([-1 if r is None else r for r in map(get, names)], np.int64)
        known = rows >= 0
        scores, counts, others = np.zeros((len(names), len(self.languages))), known.astype(np.int64), {}
        scores[known] = self.words.table[rows[known]] if known.any() else 0
        for i in np.flatnonzero(~known).tolist():
            parts = words_of(names[i])
            counts[i] = len(parts)
            for word in parts:
                row = get(word)
                if row is None:
                    others.setdefault(i, []).append(word)
                else:
                    scores[i] += self.words.table[row]
        # a long text is read in blocks, since its tokens' scores by language are many numbers
        heads = np.array([sum(scores[of[i : min(i + BLOCK, b)]].sum(axis=0) for i in range(a, b, BLOCK)) for a, b in itertools.pairwise(begins.tolist())])
        rests: list[dict[str, int]] = [{} for _ in range(len(texts))]
        unknown = np.isin(of, list(others))
        for text, i in zip(np.repeat(np.arange(len(texts)), np.diff(begins))[unknown].tolist(), of[unknown].tolist(), strict=True):
            rest = rests[text]
            for word in others[i]:
                rest[word] = rest.get(word, 0) + 1
        return np.add.reduceat(counts[of], begins[:-1]), heads, rests


def _by_language(words: DataFrame) -> DataFrame:
    """A row (lang, word, n) for each language's count of a word."""
    return words.select("word", F.explode("counts").alias("c")).select("c.lang", "word", "c.n")


@dataclass
class Learned:
    """All counts of words (word, total, counts by language) and n-grams (lang, word, n, size), as stored tables, and their totals."""

    languages: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)
    gram_sizes: dict[int, dict[str, int]] = field(default_factory=dict)

    def head(self) -> LanguageModel:
        """The words that are most frequent over all languages, with every language's count of them."""
        if not self.languages:
            return LanguageModel([])
        most = max(1, min(HEAD_WORDS, HEAD_CELLS // len(self.languages)))
        return LanguageModel(self.languages, Frequencies.of(_by_language(_most_frequent(self.words, most)), self.languages, self.sizes))

    def of_ngrams(self) -> LanguageModel:
        """All n-grams, without words."""
        by_size = [Frequencies.of(self.grams.filter(F.col("size") == size), self.languages, totals) for size, totals in self.gram_sizes.items()]
        starts = np.cumsum([0, *(len(f.at) for f in by_size)])
        at = {gram: int(start) + i for start, f in zip(starts, by_size, strict=False) for gram, i in f.at.items()}
        return LanguageModel(self.languages, grams=Frequencies(at, np.concatenate([f.table for f in by_size])))

    def whole(self) -> LanguageModel:
        """All counts in this process's memory: for small tables."""
        if not self.languages:
            return LanguageModel([])
        model = self.of_ngrams()
        model.words = Frequencies.of(_by_language(self.words), self.languages, self.sizes)
        return model

    def predictor(self):
        return self.whole().predictor()


def train(docs: DataFrame) -> Learned:
    """What all rows of ``docs`` (text, lang) that have both say."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(_count_words, COUNTS).repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("counts")), "lang-words")
    sizes = {r["lang"]: r["n"] for r in _by_language(words).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Learned([])
    grams = stored(_by_language(words).select("lang", "word").mapInArrow(_count_ngrams, COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("size", F.length("word")), "lang-grams")
    gram_sizes: dict[int, dict[str, int]] = {s: dict.fromkeys(languages, 0) for s in SIZES}
    for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        gram_sizes[r["size"]][r["lang"]] = r["n"]
    return Learned(languages, words, grams, sizes, gram_sizes)


def _of_ngrams(unknown: DataFrame, model: Learned) -> DataFrame:
    """word and entries (slot, v) of each of the distinct words ``unknown``, from its longest known n-grams.

    Slots below the number of languages hold what counts add, the four after them
    1 for the word and how much of it is n-grams of 1, 2 and 3 letters.
    """
    base = len(model.languages)
    slots = unknown.sparkSession.createDataFrame(list(zip(model.languages, range(base), strict=True)), "lang string, slot int")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    places = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(padded, i, F.lit(3)))
    windows = stored(unknown.select("word", F.explode(places).alias("window")), "lang-windows")
    part = lambda size, at: F.struct(F.lit(size).alias("size"), F.substring("window", at, size).alias("gram"))
    tried = windows.select("window").distinct().select("window", F.explode(F.array(part(3, 1), part(2, 2), part(1, 2))).alias("p")).select("window", "p.size", "p.gram")
    types = model.grams.select(F.col("word").alias("gram")).distinct()
    longest = tried.join(types, "gram").groupBy("window").agg(F.max(F.struct("size", "gram")).alias("p")).select("window", "p.size", "p.gram")
    found = stored(windows.join(longest, "window").groupBy("word", "size", "gram").agg(F.count("*").alias("c")), "lang-found")
    share = found.join(found.groupBy("word").agg(F.sum("c").alias("all")), "word").select("word", "size", "gram", (F.col("c") / F.col("all")).alias("share"))
    counts = model.grams.select(F.col("word").alias("gram"), "lang", "n")
    of_grams = share.join(counts, "gram").join(slots, "lang").select("word", "slot", (F.col("share") * F.log((F.col("n") + 0.5) / 0.5)).alias("v"))
    of_grams = of_grams.union(share.select("word", F.col("size") + base, "share")).union(unknown.select("word", F.lit(base), F.lit(1.0)))
    per = of_grams.groupBy("word", "slot").agg(F.sum("v").alias("v"))
    return per.groupBy("word").agg(F.collect_list(F.struct("slot", "v")).alias("entries"))


def _scored_ngrams(unknown: DataFrame, model: Learned) -> DataFrame:
    """As :func:`_of_ngrams`, by tasks that load all n-grams: what counts add is the score of the n-grams itself."""
    shipped, kind = unknown.sparkSession.sparkContext.broadcast(model.of_ngrams()), "word string, scores array<double>"
    base = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shipped.value.scores_of(batch.column(0).to_pylist())
            yield record_batch({"word": batch.column(0), "scores": list(np.hstack([scores, np.ones((len(scores), 1))]))}, kind)

    scored = unknown.select("word").mapInArrow(run, kind)
    entries = F.transform("scores", lambda v, i: F.struct(i.alias("slot"), v.alias("v")))
    return scored.select("word", F.filter(entries, lambda e: (e["v"] != 0) | (e["slot"] == base)).alias("entries"))


def _tail_sums(scanned: DataFrame, model: Learned) -> DataFrame:
    """_row, _slots and _values: what the words beyond the head add to each text, by slots as in :func:`_of_ngrams`."""
    rest = scanned.select("_row", F.explode(F.arrays_zip("_rest", "_times")).alias("r")).select("_row", F.col("r._rest").alias("word"), F.col("r._times").alias("times"))
    joined = rest.join(model.words.select("word", "counts"), "word", "left").select("_row", "word", "times", F.explode_outer("counts").alias("c"))
    slot = (F.array_position(F.lit(model.languages), F.col("c.lang")) - 1).cast("int")
    gain = F.log((F.col("c.n") + 0.5) / 0.5)
    joined = stored(joined.select("_row", slot.alias("slot"), (F.col("times") * gain).alias("v"), F.when(F.col("c").isNull(), F.col("word")).alias("word"), "times"), "lang-joined")
    unknown = joined.filter("slot is null").select("_row", "word", "times")
    words = stored(unknown.select("word").distinct(), "lang-unknown")
    loaded = model.grams.select("word").distinct().count() * len(model.languages) <= GRAM_CELLS
    entries = stored(_scored_ngrams(words, model) if loaded else _of_ngrams(words, model), "lang-entries")
    of_unknown = unknown.join(entries, "word").select("_row", "times", F.explode("entries").alias("e")).select("_row", "e.slot", (F.col("times") * F.col("e.v")).alias("v"))
    both = joined.filter("slot is not null").select("_row", "slot", "v").union(of_unknown)
    sums = both.repartition("_row").groupBy("_row", "slot").agg(F.sum("v").alias("v"))
    return sums.groupBy("_row").agg(F.collect_list("slot").alias("_slots"), F.collect_list("v").alias("_values"))


def identify(docs: DataFrame, model: Learned, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score of each row of ``docs``.

    Each task scores the frequent words from a broadcast table; all other words
    are joined with the stored counts.
    """
    with job(docs.sparkSession, "language") as result:
        return result(_identified(docs, model, keep))


def _identified(docs: DataFrame, model: Learned, keep: tuple[str, ...]) -> DataFrame:
    spark, languages = docs.sparkSession, model.languages
    shipped = spark.sparkContext.broadcast(model.head())
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    at = len(keep)
    schema = rows.select(*keep, F.lit(0).cast("bigint").alias("_words"), F.lit(0).cast("bigint").alias("_tail"), F.array(F.lit(0.0)).alias("_head"), F.array(F.lit("")).alias("_rest"), F.array(F.lit(0).cast("bigint")).alias("_times")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, width = shipped.value, len(languages)
        for batch in sliced(batches):
            first = 0
            for texts in by_bytes(batch.column(at), GROUP_BYTES):
                words, heads, rests = model.scan(texts)
                heads = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(heads.ravel(), pa.float64()))
                columns = [pa.array(words), pa.array([sum(r.values()) for r in rests], pa.int64()), heads, pa.array([list(r) for r in rests], pa.list_(pa.string())), pa.array([list(r.values()) for r in rests], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:at]), *columns], schema.names)
                first += len(texts)

    scanned = stored(rows.mapInArrow(scan, schema).withColumn("_row", F.monotonically_increasing_id()), "lang-scanned")
    if languages:
        scanned = scanned.join(_tail_sums(scanned, model), "_row", "left")
    else:
        scanned = scanned.withColumns({"_slots": F.lit(None).cast("array<int>"), "_values": F.lit(None).cast("array<double>")})
    size = lambda totals: np.log(0.5 / (np.array([totals[x] for x in languages], float) + 1.0))
    bases = np.stack([size(model.sizes), *(size(model.gram_sizes[s]) for s in (1, 2, 3))]) if languages else np.zeros((4, 0))

    @F.pandas_udf("lang_pred string, score double")
    def decide(words: pd.Series, tails: pd.Series, heads: pd.Series, slots: pd.Series, values: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for n, tail, head, slot, value in zip(words, tails, heads, slots, values, strict=True):
            if not n or not languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.asarray(head, float)
            if slot is not None:
                full = np.zeros(len(languages) + 4)
                full[np.asarray(slot, int)] = value
                full[-4] = tail - full[-4]  # words that are known
                total = total + full[:-4] + full[-4:] @ bases
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            names.append(languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return scanned.select(*keep, decide("_words", "_tail", "_head", "_slots", "_values").alias("_found")).select(*keep, "_found.lang_pred", "_found.score")
