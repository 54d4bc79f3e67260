"""Reading texts from probability matrices: scores of a text, and the best texts of a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import plates

BLANK = 0
GLYPHS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Glyphs that each glyph is taken for, and the share of its chance that they get.
TAKEN_FOR = {
    "0": "ODQU", "O": "0DQ", "D": "0O", "Q": "0O", "1": "ILT7", "I": "1LT", "L": "1I", "T": "17", "7": "1T", "2": "Z", "Z": "27", "5": "S", "S": "58", "6": "GB", "G": "6C", "8": "B3S", "B": "83R",
    "4": "A", "A": "4", "3": "8B", "E": "8F", "F": "EP", "P": "FR", "R": "PB", "M": "NH", "N": "MH", "H": "MNK", "K": "HX", "V": "YW", "Y": "V", "W": "VM", "C": "G0", "J": "1U", "U": "V0",
}
CONFUSION = 0.15
# The least chance of a glyph, and the least prior of a layout.
LEAST_CHANCE, LEAST_PRIOR = 1e-9, 1e-4
#: Glyphs that a beam follows at a slot.
FOLLOWED = 12

_SPREAD = np.eye(len(GLYPHS))
for _glyph, _others in TAKEN_FOR.items():
    for _other in _others:
        _SPREAD[GLYPHS.index(_glyph), GLYPHS.index(_other)] += CONFUSION


def _accepted() -> np.ndarray:
    """For each slot and glyph the layouts that take it there, a bit for each."""
    longest = max(len(t) for _, t, _ in plates.LAYOUTS)
    out = np.zeros((longest, len(GLYPHS)), np.int64)
    for k, (_, template, _) in enumerate(plates.LAYOUTS):
        for i, slot in enumerate(template):
            for g, glyph in enumerate(GLYPHS):
                if glyph.isalpha() if slot == "A" else glyph.isdigit() if slot == "D" else glyph == slot.upper():
                    out[i, g] |= 1 << k
    return out


_ACCEPTED = _accepted()
_ENDS = {n: sum(1 << k for k, (_, t, _) in enumerate(plates.LAYOUTS) if len(t) == n) for n in {len(t) for _, t, _ in plates.LAYOUTS}}


def slot_beam(chances: np.ndarray, width: int = 16) -> list[tuple[str, float]]:
    """Whole plates and their log chances, from a row of glyph chances for each slot, and an end column if there is one more.

    Each glyph lends part of its chance to those it is taken for. A prefix carries
    the layouts that it can still become as bits, so that one that can become none
    is never kept; ``width`` prefixes are kept for each slot, and ended ones go on
    beside them. Without an end column a plate fills all slots.
    """
    n = len(GLYPHS)
    has_end = chances.shape[1] > n
    chances = chances[: len(_ACCEPTED) + (1 if has_end else 0)] if has_end or len(chances) <= len(_ACCEPTED) else chances[:0]
    log_p = np.log(np.maximum(chances[:, :n] @ _SPREAD, LEAST_CHANCE))
    ended: dict[str, float] = {}
    texts, scores, alive = [""], np.zeros(1), np.array([sum(_ENDS.values())])
    for t in range(len(chances)):
        if has_end:
            end = np.log(max(chances[t, n], LEAST_CHANCE))
            for text, score, bits in zip(texts, scores.tolist(), alive.tolist(), strict=True):
                if bits & _ENDS.get(t, 0):
                    ended[text] = score + end
        if t == len(_ACCEPTED):
            texts = []
            break
        likely = np.argsort(-log_p[t], kind="stable")[:FOLLOWED]
        left = alive[:, None] & _ACCEPTED[t, likely]
        total = np.where(left != 0, scores[:, None] + log_p[t, likely], -np.inf)
        best = np.argsort(-total.ravel(), kind="stable")[:width]
        best = best[np.isfinite(total.ravel()[best])]
        rows, columns = np.divmod(best, len(likely))
        texts = [texts[r] + GLYPHS[likely[c]] for r, c in zip(rows.tolist(), columns.tolist(), strict=True)]
        scores, alive = total.ravel()[best], left.ravel()[best]
    for text, score, bits in zip(texts, scores.tolist(), alive.tolist(), strict=False):
        if bits & _ENDS.get(len(text), 0):
            ended[text] = score
    return sorted(ended.items(), key=lambda x: (-x[1], x[0]))


def slot_texts(matrices: DataFrame, key: str, column: str, width: int = 16, most: int = 5) -> DataFrame:
    """The best ``most`` plates of each row's matrix by log chance and log prior of their layout, ranked from 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [(k, text, score) for k, m in zip(pdf[key], pdf[column], strict=True) for text, score in slot_beam(np.stack([np.asarray(r, float) for r in m]), width)]
            yield pd.DataFrame(found, columns=[key, "text", "log_chance"])

    found = matrices.select(key, column).mapInPandas(run, f"{key} {matrices.schema[key].dataType.simpleString()}, text string, log_chance double")
    graded = found.withColumn("g", plates.grammar(F.col("text"))).filter("g.valid").select(key, "text", (F.col("log_chance") + F.log(F.greatest("g.prior", F.lit(LEAST_PRIOR)))).alias("score"), F.col("g.prior").alias("prior"))
    return graded.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "text"))).filter(F.col("place") <= most)


def best_path(log_p: np.ndarray) -> float:
    """Log chance of the likeliest glyph or blank at every step."""
    return float(log_p.max(axis=1).sum())


def target_scores(matrices: DataFrame, targets: DataFrame, key: str, column: str, alphabet: str, crops: int = 8, counted: int = 2) -> DataFrame:
    """How well the pictures of each group show each ``target`` (targets: key, target), relative to what they show best.

    Of a group's ``crops`` best pictures (matrices: key, picture, quality, ``column``),
    each target's log chance less that of the best path is taken, and the mean of the
    ``counted`` highest is its score. Ties of quality go to the smaller picture.
    """
    order = W.partitionBy(key).orderBy(F.desc("quality"), "picture")
    best = matrices.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= crops).select(key, "picture", column)
    pairs = best.join(targets.select(key, "target").distinct(), key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for k, picture, m, target in zip(pdf[key], pdf["picture"], pdf[column], pdf["target"], strict=True):
                log_p = np.log(np.clip(np.stack([np.asarray(r, float) for r in m]), 1e-12, 1.0))
                found.append((k, picture, target, text_score(log_p, [alphabet.index(g) + 1 for g in target if g in alphabet]) - best_path(log_p)))
            yield pd.DataFrame(found, columns=[key, "picture", "target", "relative"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (key, "picture")}
    scored = pairs.mapInPandas(run, f"{key} {kinds[key]}, picture {kinds['picture']}, target string, relative double")
    rank = W.partitionBy(key, "target").orderBy(F.desc("relative"), "picture")
    return scored.withColumn("_place", F.row_number().over(rank)).filter(F.col("_place") <= counted).groupBy(key, "target").agg(F.avg("relative").alias("score"), F.count("*").alias("pictures"))


def text_score(log_p: np.ndarray, target: list[int]) -> float:
    """Log chance of a text: over all ways to stretch it with repeats and blanks over the steps."""
    padded = [BLANK]
    for t in target:
        padded += [t, BLANK]
    now = np.full(len(padded), -np.inf)
    now[0] = log_p[0, BLANK]
    if len(padded) > 1:
        now[1] = log_p[0, padded[1]]
    for row in log_p[1:]:
        before = now
        now = before.copy()
        now[1:] = np.logaddexp(now[1:], before[:-1])
        for k in range(2, len(padded)):
            if padded[k] != BLANK and padded[k] != padded[k - 2]:
                now[k] = np.logaddexp(now[k], before[k - 2])
        now = now + row[padded]
    return float(now[-1] if len(padded) == 1 else np.logaddexp(now[-1], now[-2]))


def beam(log_p: np.ndarray, width: int, allowed=None) -> list[tuple[tuple[int, ...], float]]:
    """The likeliest texts and their log chances, keeping ``width`` prefixes a step.

    ``allowed(prefix)`` may refuse prefixes that no valid text begins with.
    """
    prefixes: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -np.inf)}
    for row in log_p:
        found: dict[tuple[int, ...], list[float]] = {}

        def add(prefix: tuple[int, ...], kind: int, value: float, found=found) -> None:
            entry = found.setdefault(prefix, [-np.inf, -np.inf])
            entry[kind] = np.logaddexp(entry[kind], value)

        for prefix, (blank, glyph) in prefixes.items():
            whole = np.logaddexp(blank, glyph)
            add(prefix, 0, whole + row[BLANK])
            for c in range(1, len(row)):
                if prefix and prefix[-1] == c:
                    add(prefix, 1, glyph + row[c])
                    add((*prefix, c), 1, blank + row[c])
                else:
                    add((*prefix, c), 1, whole + row[c])
        kept = [(p, tuple(v)) for p, v in found.items() if allowed is None or allowed(p)]
        kept.sort(key=lambda item: (-np.logaddexp(*item[1]), item[0]))
        prefixes = dict(kept[:width])
    return sorted(((p, float(np.logaddexp(*v))) for p, v in prefixes.items()), key=lambda x: (-x[1], x[0]))


def decode(matrices: DataFrame, key: str, column: str, alphabet: str, width: int = 8) -> DataFrame:
    """The best text of each row's matrix (rows of step probabilities, the blank first) and its log chance."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, m in zip(pdf[key], pdf[column], strict=True):
                log_p = np.log(np.maximum(np.stack([np.asarray(r, float) for r in m]), 1e-12))
                best, score = beam(log_p, width)[0]
                rows.append((k, "".join(alphabet[c - 1] for c in best), score, text_score(log_p, list(best))))
            yield pd.DataFrame(rows, columns=[key, "text", "score", "full_score"])

    return matrices.select(key, column).mapInPandas(run, f"{key} {matrices.schema[key].dataType.simpleString()}, text string, score double, full_score double")
