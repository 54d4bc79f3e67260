"""Fused readings against a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import plates
from fieldglass.operators import voting


def place(anchor, text):
    """Glyphs of ``text`` in the places of ``anchor``, by the whole table of edit distances."""
    n, m = len(anchor), len(text)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (anchor[i - 1] != text[j - 1]))
    out, i, j = [None] * n, n, m
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + (anchor[i - 1] != text[j - 1]):
            i, j = i - 1, j - 1
            out[i] = text[j]
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def fits(glyph, slot):
    return glyph.isalpha() if slot == "A" else glyph.isdigit() if slot == "D" else glyph == slot.upper()


def plain(readings, prior, supported_only):
    texts, single = defaultdict(float), defaultdict(float)
    for text, w in readings:
        if text:
            texts[text] += w
            single[text] = max(single[text], w)
    weights = defaultdict(float)
    for text, w in texts.items():
        weights[len(text)] += w
    n = max(weights, key=lambda k: (weights[k], k))
    anchor = min((t for t in texts if len(t) == n), key=lambda t: (-single[t], t))
    votes = [defaultdict(float) for _ in range(n)]
    for text, w in texts.items():
        for i, g in enumerate(place(anchor, text)):
            if g:
                votes[i][g] += w
    share = lambda text: sum(v[g] / sum(v.values()) for v, g in zip(votes, text, strict=True)) / n
    score = lambda text: share(text) * max(prior[text][0], 1e-3) ** 0.3
    own = [t for t in texts if len(t) == n and prior[t][1]]
    if supported_only and own:
        best = max(own, key=lambda t: (score(t), t))
        return best, share(best), prior[best][0]
    made = []
    for name, template, weight in plates.LAYOUTS:
        if len(template) == n:
            glyphs = [min((g for g in v if fits(g, s)), key=lambda g, v=v: (-v[g], g), default=None) for v, s in zip(votes, template, strict=True)]
            if None not in glyphs:
                text = "".join(glyphs)
                made.append((score(text), weight, name, text))
    text = max(made)[3] if made else "".join(min(v, key=lambda g, v=v: (-v[g], g)) for v in votes)
    return text, share(text), prior[text][0]


class Priors(dict):
    """Prior and validity of texts, asked from the library's grammar one by one."""

    def __init__(self, spark):
        self.spark = spark

    def __missing__(self, text):
        r = self.spark.range(1).select(plates.grammar(F.lit(text)).alias("g")).first().g
        self[text] = (r.prior, r.valid)
        return self[text]


def damaged(rng, text):
    for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(("", rng.choice("0O1IB8AXZ2"), rng.choice("GJ7X") + text[k])) + text[k + 1 :]
    return text


def cases():
    rng = random.Random(1)
    out = []
    for key in range(12):
        truth = rng.choice(("GJ05AB1234", "DL3CAB1234", "22BH1234AA", "MH12A1234", "XX", "GJ32AG2883"))
        out += [(key, damaged(rng, truth) or None, rng.uniform(0.1, 1.0)) for _ in range(rng.choice((1, 3, 9)))]
    return [*out, (50, "", 1.0), (50, None, 1.0), (51, "GJ05AB1234", 1.9), (51, "GJ5AB1234", 0.6), (51, "GJ05AXB1234", 0.6), (51, "GJ05AB124", 0.5)]


@pytest.mark.parametrize("supported_only", [False, True])
def test_rover_equals_a_plain_version(spark, supported_only):
    rows = cases()
    df = spark.createDataFrame(rows, "k int, t string, w double").repartition(3)
    got = {r.k: (r.fused, r.share, r.prior) for r in voting.rover(df, "k", "t", "w", supported_only).collect()}
    prior, groups = Priors(spark), defaultdict(list)
    for k, t, w in rows:
        groups[k].append((t, w))
    want = {k: plain(g, prior, supported_only) for k, g in groups.items() if any(t for t, _ in g)}
    assert set(got) == set(want) and 50 not in got
    for k, (text, share, weight) in want.items():
        assert got[k][0] == text, k
        assert got[k][1:] == pytest.approx((share, weight))
    assert got[51][0] == "GJ05AB1234"


def test_readings_of_other_lengths_vote(spark):
    """Two sure readings of nine glyphs fix the length; those with a glyph more or less still decide its places."""
    rows = [("MH12A1284", 0.9), ("MH12A1284", 0.2), ("MH12A234", 0.5), ("MH12AB1234", 0.5), ("H12A1234", 0.4)]
    df = spark.createDataFrame([(1, t, w) for t, w in rows], "k int, t string, w double")
    assert voting.rover(df, "k", "t", "w").first().fused == "MH12A1234"


def test_alignment(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("AB1", k=rng.randint(1, 7))), "".join(rng.choices("AB1", k=rng.randint(1, 7)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, t string").select("a", "t", voting.aligned(F.col("a"), F.col("t")).alias("g")).collect()
    assert all(r.g == place(r.a, r.t) for r in got) and len(got) == 300
