import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import language, quality
from fieldglass.llm.common import id_fold
from fieldglass.llm.queries import QUERIES
from tests.llm.helpers import docs


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op8_language"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 40").select("doc_id", "lang")
    j = got.filter("held_out").join(truth, "doc_id").toPandas()
    assert len(j) > 10 and (j["lang"] == j["lang_pred"]).mean() > 0.97
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_language_cases(spark):
    df = docs(spark)
    model = language.train(df)
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(df, model).collect()}
    for i in (100, 101, 102, 110):
        assert got[(i, language.UNKNOWN)] == 0
    assert all(0 <= s <= 1 for s in got.values())
    empty = language.train(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {language.UNKNOWN}
    assert language.identify(df.limit(0), model).count() == 0


def test_unseen_words_back_off():
    words = language.Frequencies({"known": 0}, np.array([[0.0, -9.0]]))
    model = language.LanguageModel(["a", "b"], words, language.Frequencies({"xyz": 0, "q": 1}, np.array([[-9.0, 0.0], [-1.0, -5.0]])))
    assert model.scores_of(["known", "xyz", "qq", "?"]).tolist() == [[0, -9], [-9, 0], [-1, -5], [0, 0]]
    assert language.words_of("½x²") == ["x"]
    names, scores = model.predictor()(["known", "12 ² ½", "xyz xyz"])
    assert names == ["a", language.UNKNOWN, "b"] and scores[1] == 0


def test_word_counts_match_brute_force(spark):
    from collections import Counter

    df = docs(spark)
    rows = df.filter("text is not null and lang is not null").select("text", "lang")
    got = {(r.lang, r.word): r.n for r in rows.mapInArrow(language._count_words, language.COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()}
    want = Counter((r.lang, w) for r in rows.collect() for t in r.text.lower().split() for w in language._LETTERS.findall(t))
    assert got == dict(want)


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = QUERIES["op4_quality"](spark, big)
    j = got.filter("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert len(j) > 50 and (j["quality"] == j["predicted"]).mean() > 0.95
    clean = j[j["quality"] == 1]
    assert (clean["predicted"] == 1).mean() > 0.97
    assert got.count() == spark.read.parquet(f"{big}/documents.parquet").count()


def test_quality_cases(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (999, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(df, labels)
    scores = [r.s for r in df.select(quality.quality_of(model, F.col("text"), spark).alias("s")).collect()]
    assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
    none = quality.train(df, labels.limit(0))
    assert {round(r.s, 3) for r in df.select(quality.quality_of(none, F.col("text"), spark).alias("s")).collect()} == {0.5}


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    got = model.scores(x)
    assert ((got > 0.5) == y).mean() > 0.95
    for i in range(0, 600, 97):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + (x[i, model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - model.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-total)) - got[i]) < 1e-12


def test_fold_is_crc32_of_the_written_id(spark):
    import zlib

    for r in spark.range(20).select("id", id_fold("id", 5).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.id).encode()) % 5


def test_all_words_of_a_language_count(spark):
    """60,000 words of each of two languages, each seen once, whose n-grams say nothing."""
    import random

    rng = random.Random(8)
    words = list({"".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(120_000)})
    half = len(words) // 2
    parts = {"aa": words[:half], "bb": words[half:]}
    data = [(0, " ".join(ws[i : i + 1000]), lang) for lang, ws in parts.items() for i in range(0, len(ws), 1000)]
    model = language.train(spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(4))
    asked = [(i, " ".join(rng.sample(parts[lang], 3)), lang) for i, lang in enumerate(["aa", "bb"] * 50)]
    got = language.identify(spark.createDataFrame(asked, "doc_id bigint, text string, lang string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in asked}


@pytest.mark.parametrize("cells", [0, 4_000_000])
def test_joined_words_score_like_the_whole_model(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "GRAM_CELLS", cells)
    monkeypatch.setattr(language, "HEAD_WORDS", 3)
    df = docs(spark)
    model = language.train(df)
    texts = ["stone thing zzq nigh", "unds deri", "é ½ 你", "und", "", "the the the rivers of"] + [r.text or "" for r in df.collect()]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    names, scores = model.predictor()(texts)
    assert len(got) == len(texts)
    for r in got:
        assert r.lang_pred == names[r.doc_id] and abs(r.score - scores[r.doc_id]) < 1e-9


def test_every_language_is_learned(spark):
    langs = [f"l{i:02d}" for i in range(70)]
    data = [(i, " ".join(f"{a}{b}" for a in "pqrst" for b in (chr(0x4E00 + i), "x" * (i % 3 + 1))), lang) for i, lang in enumerate(langs)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.train(df)).collect()}
    assert got == dict(enumerate(langs))


def plain_statistics(text):
    """The statistics of one text, character by character."""
    import math
    from collections import Counter

    raw = text.encode()
    groups = {name: set(members) for name, members in quality._CLASSES}
    counts = {name: sum(b in members for b in raw) for name, members in groups.items()}
    size, tokens, lines = max(len(raw), 1), text.split(), text.split("\n")
    words, letters = max(len(tokens), 1), max(counts["lower"] + counts["upper"], 1)
    entropy = -sum(n / size * math.log2(n / size) for n in Counter(raw).values())
    more = [math.log1p(len(raw)), math.log1p(len(tokens)), (size - counts["blank"] - counts["line"]) / words, len(set(tokens)) / words, size / len(lines)]
    more += [len(set(lines)) / len(lines), max(map(len, lines)) / size, counts["upper"] / letters, counts["stop"] / words, entropy]
    return [*(n / size for n in counts.values()), *more]


def test_quality_query_equals_a_plain_version(spark, sf_dir):
    """Every score of the query: statistics counted plainly, trees walked node by node."""
    import math
    import zlib

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(table, labels.filter(id_fold("doc_id", 5) != 0))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    for r in QUERIES["op4_quality"](spark, sf_dir).collect():
        x, total = plain_statistics(texts[r.doc_id]), model.base
        for feature, threshold, value in zip(model.feature.tolist(), model.threshold.tolist(), model.value.tolist(), strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        score = 1 / (1 + math.exp(-total))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_query_equals_a_plain_version(spark, sf_dir):
    """Every prediction of the query, from counts and sums in plain Python."""
    import math
    import zlib
    from collections import Counter, defaultdict

    import regex

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    held_out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    words, grams = defaultdict(Counter), [defaultdict(Counter) for _ in range(4)]
    for r in rows:
        if r.text is not None and r.lang is not None and not held_out[r.doc_id]:
            words[r.lang].update(regex.findall(r"\p{L}+", r.text.lower()))
    for lang, counts in words.items():
        for word in counts:
            w = f" {word} "
            grams[1][lang].update(word)
            grams[2][lang].update(w[i : i + 2] for i in range(len(w) - 1))
            grams[3][lang].update(w[i : i + 3] for i in range(len(w) - 2))
    langs = sorted(words)

    def logs(table, key):
        return [math.log((table[x][key] + 0.5) / (sum(table[x].values()) + 1)) for x in langs]

    known = set().union(*words.values())
    seen = [set(), *(set().union(*g.values()) for g in grams[1:])]
    cache = {}

    def scores(word):
        if word in known:
            return logs(words, word)
        w, found = f" {word} ", []
        for i in range(1, len(w) - 1):
            for size, gram in ((3, w[i - 1 : i + 2]), (2, w[i : i + 2]), (1, w[i])):
                if gram in seen[size]:
                    found.append(logs(grams[size], gram))
                    break
        return [sum(c) / len(found) for c in zip(*found, strict=True)] if found else [0.0] * len(langs)

    got = {r.doc_id: r for r in QUERIES["op8_language"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        total, n = [0.0] * len(langs), 0
        for word, times in Counter(regex.findall(r"\p{L}+", (r.text or "").lower())).items():
            if word not in cache:
                cache[word] = scores(word)
            total, n = [t + times * s for t, s in zip(total, cache[word], strict=True)], n + times
        found = got[r.doc_id]
        assert found.held_out == held_out[r.doc_id]
        if not n:
            assert (found.lang_pred, found.score) == (language.UNKNOWN, 0)
            continue
        best = max(total)
        odds = [math.exp(t - best) for t in total]
        assert found.lang_pred == langs[total.index(best)] and abs(found.score - max(odds) / sum(odds)) < 1e-6


def test_a_batch_is_scanned_token_by_token_once(monkeypatch):
    words = {"stone": 0, "l": 1, "eau": 2}
    model = language.LanguageModel(["de", "fr"], language.Frequencies(words, np.array([[1.0, 2.0], [3.0, 5.0], [7.0, 11.0]])))
    texts = ["Stone, stone. l'eau new", "", "12 ½", "new.new l'eau STONE\nother-new"] * 3
    asked, split = [], language.words_of
    monkeypatch.setattr(language, "words_of", lambda token: asked.append(token) or split(token))
    monkeypatch.setattr(language, "BLOCK", 2)
    counts, heads, rests = model.scan(pa.array(texts))
    assert len(asked) == len(set(asked)) and "stone" not in asked
    assert counts.tolist() == [5, 0, 0, 7] * 3
    assert heads.tolist() == [[12.0, 20.0], [0.0, 0.0], [0.0, 0.0], [11.0, 18.0]] * 3
    assert rests == [{"new": 1}, {}, {}, {"new": 3, "other": 1}] * 3
