"""Decoders against sums and choices over all texts."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import plates
from fieldglass.operators import decoding
from fieldglass.plans import catalogue, q_tracks

LAYOUTS = {name: (template, weight) for name, template, weight in plates.LAYOUTS}


def spread(row):
    out = row[: len(decoding.GLYPHS)].copy()
    for g, others in decoding.TAKEN_FOR.items():
        for o in others:
            out[decoding.GLYPHS.index(o)] += 0.15 * row[decoding.GLYPHS.index(g)]
    return out


def glyphs(slot):
    return [g for g in decoding.GLYPHS if (g.isalpha() if slot == "A" else g.isdigit() if slot == "D" else g == slot.upper())]


def every(template, chances, end):
    """All texts of a layout whose glyphs are among the twelve likeliest of their slots, with log chances."""
    log_p = [np.log(np.maximum(spread(row), 1e-9)) for row in chances]
    top = [{decoding.GLYPHS[c] for c in np.argsort(-row, kind="stable")[:12]} for row in log_p[: len(template)]]
    for text in itertools.product(*([g for g in glyphs(s) if g in t] for s, t in zip(template, top, strict=False))):
        score = sum(log_p[i][decoding.GLYPHS.index(g)] for i, g in enumerate(text))
        yield "".join(text), score + (math.log(max(chances[len(template)][36], 1e-9)) if end and len(template) < len(chances) else 0.0)


@pytest.mark.parametrize("slots", [4, 5])
def test_a_wide_beam_finds_all_plates_of_two_layouts(slots):
    rng = np.random.default_rng(slots)
    for _ in range(3):
        chances = rng.dirichlet(np.full(37, 0.3), size=slots + 1)
        want = {}
        for name in ("std_s0_n1", "std_s1_n1"):
            if len(LAYOUTS[name][0]) <= slots + 1:
                want |= dict(every(LAYOUTS[name][0], chances, True))
        got = dict(decoding.slot_beam(chances, 10**6))
        some = {t: s for t, s in got.items() if t in want}
        assert some == {t: pytest.approx(s) for t, s in want.items()} and want
        narrow = decoding.slot_beam(chances, 16)
        assert all(got[t] == pytest.approx(s) for t, s in narrow)


def test_without_an_end_column_all_slots_are_filled():
    rng = np.random.default_rng(3)
    chances = rng.dirichlet(np.full(36, 0.2), size=5)
    got = decoding.slot_beam(chances, 10**6)
    want = dict(every("AADDD", chances, False))
    assert {t for t, _ in got if plates.slots_of(5) and t in want} == set(want) and all(len(t) == 5 for t, _ in got)


def test_queries_equal_plain_versions(spark, sf_dir):
    m = {r.vec_id: np.array(r.m) for r in q_tracks._slot_matrices(spark, sf_dir).filter("vec_id < 25").collect()}
    got = defaultdict(list)
    for r in catalogue.QUERIES["slot_plates"](spark, sf_dir).collect():
        got[r.vec_id].append((r.place, r.text, r.score))
    texts = {k: dict(decoding.slot_beam(v)) for k, v in m.items()}
    words = sorted({t for found in texts.values() for t in found})
    prior = {r.t: r.g for r in spark.createDataFrame([(w,) for w in words] or [("",)], "t string").select("t", plates.grammar(F.col("t")).alias("g")).collect()}
    for k, found in texts.items():
        ranked = sorted(((-(s + math.log(max(prior[t].prior, 1e-4))), t) for t, s in found.items() if prior[t].valid))[:3]
        assert sorted(got[k]) == [(n, t, pytest.approx(-s, abs=1e-5)) for n, (s, t) in enumerate(ranked, 1)]


def test_targets_relative_to_the_best_path(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 3, k, float(k % 4), rng.dirichlet(np.ones(4), size=4).tolist()) for k in range(12)]
    wanted = [(k, t) for k in range(3) for t in ("AB", "C", "A", "")] + [(9, "A")]
    df = spark.createDataFrame(rows, "track int, picture int, quality double, m array<array<double>>").repartition(3)
    got = {(r.track, r.target): (r.score, r.pictures) for r in decoding.target_scores(df, spark.createDataFrame(wanted, "track int, target string"), "track", "m", "ABC", crops=3).collect()}
    want = {}
    for track, target in wanted[:-1]:
        mine = sorted((r for r in rows if r[0] == track), key=lambda r: (-r[2], r[1]))[:3]
        found = []
        for _, _, _, m in mine:
            chance = 0.0
            for path in itertools.product(range(4), repeat=4):
                if "".join("ABC"[c - 1] for c, _ in itertools.groupby(path) if c) == target:
                    chance += math.prod(m[i][c] for i, c in enumerate(path))
            found.append(math.log(chance) - sum(math.log(max(row)) for row in m))
        want[track, target] = (pytest.approx(sum(sorted(found)[-2:]) / 2), 2)
    assert got == want
