"""Registration plates: normalising, plausibility, origin, grammar and a confusion-weighted distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes of states and union territories, and of special series.
STATE_CODES = (
    "AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UA UK UP WB"
).split()
SPECIAL_SERIES = ("BH", "CD", "UN", "DC")
# Unordered pairs of a letter and a digit that readers confuse.
CONFUSED = "O0 Q0 D0 U0 C0 G0 I1 L1 J1 T1 Z2 R2 J3 B3 A4 Y4 S5 G6 C6 T7 Y7 B8 E8 S8 P9 G9 Q9".split()
# Costs of an edit, and the distance up to which plates match.
CONFUSED_COST, OTHER_COST, GAP_COST, MATCH_DISTANCE = 0.35, 1.0, 0.5, 1.0
# What a letter or digit slot makes of a glyph of the other kind.
TO_LETTER = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B", "4": "A", "7": "T"}
TO_DIGIT = {"O": "0", "D": "0", "Q": "0", "U": "0", "I": "1", "L": "1", "T": "1", "Z": "2", "S": "5", "G": "6", "B": "8", "A": "4", "E": "8"}
# Texts that cameras burn into pictures.
OVERLAY_WORDS = "CSITMS PTZ LIVE REC CAM0 CAM1 CAM2 CAM3 BRIDGE CHIMAN CCTV IPC".split()
# Years that dates in pictures begin or end with, and what clocks end with.
OVERLAY_YEARS, OVERLAY_ENDS = ("2020", "2039"), ("AM", "PM", "HRS")
# Layouts by name (A any letter, D any digit, a small letter that letter) with their weights.
LAYOUTS = (
    ("std_s0_n4", "AADDDDDD", 0.15),
    ("std_s0_n3", "AADDDDD", 0.03),
    ("std_s0_n2", "AADDDD", 0.03),
    ("std_s0_n1", "AADDD", 0.03),
    ("std_s1_n4", "AADDADDDD", 0.5),
    ("std_s1_n3", "AADDADDD", 0.08),
    ("std_s1_n2", "AADDADD", 0.08),
    ("std_s1_n1", "AADDAD", 0.08),
    ("std_s2_n4", "AADDAADDDD", 1.0),
    ("std_s2_n3", "AADDAADDD", 0.08),
    ("std_s2_n2", "AADDAADD", 0.08),
    ("std_s2_n1", "AADDAAD", 0.08),
    ("std_s3_n4", "AADDAAADDDD", 0.5),
    ("std_s3_n3", "AADDAAADDD", 0.08),
    ("std_s3_n2", "AADDAAADD", 0.08),
    ("std_s3_n1", "AADDAAAD", 0.08),
    ("dl_short", "AADAAADDDD", 0.6),
    ("dl_short_s1", "AADAADDDD", 0.35),
    ("bharat", "DDbhDDDDAA", 0.15),
    ("dipl_CD", "DDcdDDD", 0.01),
    ("dipl_CD_4", "DDcdDDDD", 0.01),
    ("dipl_CC", "DDccDDD", 0.01),
    ("dipl_CC_4", "DDccDDDD", 0.01),
    ("dipl_UN", "DDunDDD", 0.01),
    ("dipl_UN_4", "DDunDDDD", 0.01),
    ("vintage", "AAvADDDDDD", 0.005),
    ("temp", "AADDtcDDDD", 0.01),
)
# What makes a plate less likely, and by which factor.
PENALTIES = {"unknown_state": 0.05, "other_state": 0.7, "unknown_office": 0.1, "district_out_of_range": 0.3, "district_00": 0.05, "rare_series_letter": 0.35, "implausible_year": 0.2}
# First and last district by state; series letters that are not given out; years of the national series.
DISTRICTS = {"GJ": (1, 39), "DL": (1, 16), "MH": (1, 51), "RJ": (1, 60), "MP": (1, 71), "KA": (1, 71), "TN": (1, 99), "UP": (1, 96)}
RARE_LETTERS, SERIES_YEARS = "IO", (19, 35)
# The home state, whose offices are checked by number.
HOME_STATE, HOME_OFFICES = "GJ", tuple(f"{n:02d}" for n in range(1, 40))


def shape(plate: Column) -> Column:
    """A for each letter, D for each digit."""
    return F.regexp_replace(F.regexp_replace(plate, "[A-Z]", "A"), "[0-9]", "D")


def clean(plate: Column) -> Column:
    """Upper case, letters and digits only, without one leading IND; null is empty."""
    kept = F.regexp_replace(F.upper(F.coalesce(plate, F.lit(""))), "[^A-Z0-9]", "")
    return F.regexp_replace(kept, "^IND", "")


def registry_form(plate: Column) -> Column:
    """Letters and digits only, upper case; keeps a leading IND."""
    return F.upper(F.regexp_replace(F.coalesce(plate, F.lit("")), "[^A-Za-z0-9]", ""))


def grammar_form(plate: Column) -> Column:
    """Upper case first, then letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(plate, F.lit(""))), "[^A-Z0-9]", "")


def glyph_cost(a: Column, b: Column) -> Column:
    """0 for equal glyphs, less for a confused pair than for any other."""
    pairs = F.lit([*CONFUSED, *(p[::-1] for p in CONFUSED)])
    return F.when(a == b, F.lit(0.0)).when(F.array_contains(pairs, F.concat(a, b)), F.lit(CONFUSED_COST)).otherwise(F.lit(OTHER_COST))


def distance(a: Column, b: Column) -> Column:
    """Weighted edit distance of two cleaned plates, by one row of the table after another.

    Equal plates have 0; if just one is empty, it is the other's length.
    """
    n, m = F.length(a), F.length(b)
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j * F.lit(GAP_COST))

    def next_row(row: Column, i: Column) -> Column:
        start = F.array(i * F.lit(GAP_COST))
        glyph = F.substr(a, i, F.lit(1))

        def cell(out: Column, j: Column) -> Column:
            above, aside, across = F.element_at(row, j + 1), F.element_at(out, j), F.element_at(row, j)
            return F.array_append(out, F.least(above + GAP_COST, aside + GAP_COST, across + glyph_cost(glyph, F.substr(b, j, F.lit(1)))))

        return F.aggregate(F.sequence(F.lit(1), m), start, cell)

    table = F.aggregate(F.sequence(F.lit(1), n), first, next_row)
    return F.when(a == b, F.lit(0.0)).when((n == 0) | (m == 0), F.greatest(n, m).cast("double")).otherwise(F.element_at(table, m + 1))


_CODES = {(ord(x), ord(y)) for p in CONFUSED for x, y in (p, p[::-1])}
#: Costs of two glyphs below 128 in twentieths, other glyphs aside.
_COSTS = np.array([[0 if x == y else round(20 * (CONFUSED_COST if (x, y) in _CODES else OTHER_COST)) for y in range(128)] for x in range(128)], dtype=np.int32)


def _batch_distance(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`distance` of pairs of texts: one table for all of them, cell by cell, in twentieths."""
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
    gap = round(20 * GAP_COST)
    wide = [max(int(x.max()), 1) for x in (n, m)]
    glyphs = [np.array(t, dtype=f"U{w}").view(np.uint32).reshape(len(t), w).T.copy() for t, w in zip((a, b), wide, strict=True)]
    plain = max(int(g.max()) for g in glyphs) < 128
    row = np.repeat(np.arange(wide[1] + 1, dtype=np.int32)[:, None] * gap, len(a), axis=1)
    out, every = np.zeros(len(a), dtype=np.int32), np.arange(len(a))
    for i in range(wide[0] + 1):
        if i:
            before, row = row, np.empty_like(row)
            row[0] = i * gap
            for j in range(1, wide[1] + 1):
                x, y = glyphs[0][i - 1], glyphs[1][j - 1]
                cost = _COSTS[x, y] if plain else np.where(x == y, 0, np.where((x < 128) & (y < 128), _COSTS[x % 128, y % 128], round(20 * OTHER_COST)))
                row[j] = np.minimum(np.minimum(before[j], row[j - 1]) + gap, before[j - 1] + cost)
        ends = n == i
        out[ends] = row[m[ends], every[ends]]
    return np.where((n == 0) | (m == 0), np.maximum(n, m) * 20, out) / 20


@F.pandas_udf(T.DoubleType())
def distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`distance` for very many pairs, a batch of them at once; null if a plate is."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = a.to_numpy()[known], b.to_numpy()[known]
    longest = np.fromiter((max(len(p), len(q)) for p, q in zip(x, y, strict=True)), np.int64, len(known))
    order, at = np.argsort(longest, kind="stable"), 0
    while at < len(order):  # texts of like lengths together, so a long one widens no others' tables
        size = max(1, min(8192, 2_000_000 // (int(longest[order[min(at + 8192, len(order)) - 1]]) + 1)))
        part = order[at : at + size]
        out[known[part]] = _batch_distance(list(x[part]), list(y[part]))
        at += size
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def most_edits(most: float = MATCH_DISTANCE) -> int:
    """How many unit edits a weighted distance allows: no edit costs less than a confused pair."""
    return int(most / CONFUSED_COST)


def may_match(a: Column, b: Column, most: float = MATCH_DISTANCE) -> Column:
    """A cheap condition that every pair within ``most`` fulfils: bounded unit edits and difference in length."""
    return (F.abs(F.length(a) - F.length(b)) <= int(most / GAP_COST)) & (F.levenshtein(a, b, most_edits(most)) >= 0)


def distance_within(a: Column, b: Column, most: float = MATCH_DISTANCE) -> Column:
    """The distance if it is at most ``most``, else null; the table is built for likely pairs only."""
    d = F.when(may_match(a, b, most), distance(a, b))
    return F.when(d <= most, d)


def similarity(a: Column, b: Column, apart: Column | None = None) -> Column:
    """Distance (``apart``, where it is known) as a share of the longer plate, 1 for equal ones."""
    return F.greatest(F.lit(0.0), 1 - (distance(a, b) if apart is None else apart) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def state_of(plate: Column) -> Column:
    """The state or series code of a cleaned plate; null if it has none."""
    head, series = F.substr(plate, F.lit(1), F.lit(2)), F.substr(plate, F.lit(3), F.lit(2))
    return F.when(head.isin(*STATE_CODES, *SPECIAL_SERIES), head).when(plate.rlike("^[0-9]{2}..") & series.isin(*SPECIAL_SERIES), series)


def is_plausible(plate: Column) -> Column:
    """Whether a cleaned plate has a plausible length and a state."""
    return F.length(plate).between(6, 11) & state_of(plate).isNotNull()


def rto_of(plate: Column) -> Column:
    """State and two-digit office of a plate (struct state, rto); null if it doesn't begin with them."""
    text = F.upper(F.trim(plate))
    state, office = F.regexp_extract(text, r"^([A-Z]{2})\s*([0-9]{1,2})", 1), F.regexp_extract(text, r"^([A-Z]{2})\s*([0-9]{1,2})", 2)
    return F.when(state != "", F.struct(state.alias("state"), F.lpad(office, 2, "0").alias("rto")))


def looks_like_overlay(plate: Column) -> Column:
    """Whether a grammar-form text is a caption, or has the digits of a clock or date where plates have letters."""
    kinds, first, last = shape(plate), F.substr(plate, F.lit(1), F.lit(4)), F.right(plate, F.lit(4))
    year = lambda four: (shape(four) == "DDDD") & four.between(*OVERLAY_YEARS)
    clock = [kinds.startswith("D" * n + "AA") & F.substr(plate, F.lit(n + 1), F.lit(2)).isin("AM", "PM") for n in (3, 4)]
    date = kinds.startswith("DDDDDD") | kinds.contains("DDDDDDDD")
    digits = F.length(F.replace(kinds, F.lit("A"), F.lit("")))
    numbered = (digits >= 6) & kinds.startswith("DD") & (F.substr(plate, F.lit(3), F.lit(2)) != "BH")
    found = [plate.contains(w) for w in OVERLAY_WORDS] + [plate.endswith(e) for e in OVERLAY_ENDS] + [year(first), year(last), *clock, date, numbered]
    return F.exists(F.array(*found), lambda x: x)


def layout_of(plate: Column) -> Column:
    """The name of the layout of a grammar-form plate; null if it has none.

    The plate's shape tells layouts apart, and fixed letters those of one shape.
    One of fixed letters that has the shape of a plain layout never outweighs it.
    Delhi's layouts are for Delhi alone.
    """
    kinds = shape(plate)
    plain = {template: name for name, template, _ in LAYOUTS if template.isupper()}
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in plain.items() for x in kv)), kinds)
    found = F.when(~found.startswith("dl_short") | plate.startswith("DL"), found)
    for name, template, _ in LAYOUTS:
        letters = "".join(c for c in template if c.islower())
        whole = "".join("A" if c.islower() else c for c in template)
        if letters and whole not in plain:
            at = template.index(letters) + 1
            found = F.when((kinds == whole) & (F.substr(plate, F.lit(at), F.lit(len(letters))) == letters.upper()), name).otherwise(found)
    return found


def grammar(plate: Column, preferred: str = HOME_STATE) -> Column:
    """The layout of a grammar-form plate: struct prior, layout, valid, reasons.

    The prior is the layout's weight times the factors of all PENALTIES that apply;
    a foreign state costs but is no reason. States count in layouts that begin with
    one, districts in the standard ones, years in the national series.
    """
    state, district = F.substr(plate, F.lit(1), F.lit(2)), F.substr(plate, F.lit(3), F.lit(2))
    known, home = state.isin(*STATE_CODES), state == HOME_STATE
    ranges = F.create_map(*(F.lit(x) for code, (low, high) in DISTRICTS.items() for x in (code, [f"{low:02d}", f"{high:02d}"])))
    bounds = F.try_element_at(ranges, state)
    outside = F.coalesce(~district.between(bounds[0], bounds[1]), F.lit(False))
    office = home & ~district.isin(*HOME_OFFICES)

    def graded(name: Column) -> Column:
        standard = name.startswith("std")
        stated = standard | name.startswith("dl_short")
        against = {
            "unknown_state": stated & ~known,
            "other_state": stated & known & (state != preferred) if preferred else F.lit(False),
            "unknown_office": standard & office,
            "district_out_of_range": standard & known & outside & ~office,
            "district_00": standard & known & (district == "00"),
            "rare_series_letter": stated & F.substr(plate, F.lit(5), F.length(plate)).rlike(f"[{RARE_LETTERS}]"),
            "implausible_year": (name == "bharat") & ~state.between(*(f"{y:02d}" for y in SERIES_YEARS)),
        }
        held = F.filter(F.array(*(F.struct(F.lit(r).alias("name"), F.lit(PENALTIES[r]).alias("factor"), holds.alias("holds")) for r, holds in against.items())), lambda x: x["holds"])
        weight = F.try_element_at(F.create_map(*(F.lit(x) for n, _, w in LAYOUTS for x in (n, float(w)))), name)
        prior = F.aggregate(held, weight, lambda product, x: product * x["factor"])
        reasons = F.filter(F.transform(held, lambda x: x["name"]), lambda r: r != "other_state")
        return F.struct(F.coalesce(prior, F.lit(0.0)).alias("prior"), name.alias("layout"), name.isNotNull().alias("valid"), F.when(name.isNull(), F.array(F.lit("no_format_match"))).otherwise(reasons).alias("reasons"))

    return F.transform(F.array(layout_of(plate)), graded)[0]


def slots_of(length: int) -> str | None:
    """The template of the likeliest layout of a length."""
    return max((row for row in LAYOUTS if len(row[1]) == length), key=lambda row: row[2], default=(None, None))[1]


def coerced(plate: Column) -> Column:
    """The plate with each glyph turned into the class of its slot where a confusion allows it; null if nothing changes."""
    turned = {"A": TO_LETTER, "D": TO_DIGIT}
    fixed = F.lit(None).cast("string")
    for length in sorted({len(t) for _, t, _ in LAYOUTS}):
        glyphs = [F.translate(F.substr(plate, F.lit(i + 1), F.lit(1)), "".join(turned.get(t, {})), "".join(turned.get(t, {}).values())) for i, t in enumerate(slots_of(length))]
        fixed = F.when(F.length(plate) == length, F.concat(*glyphs)).otherwise(fixed)
    return F.nullif(fixed, plate)


def matches_partial(read: Column, partial: Column) -> Column:
    """Whether a reading has the glyphs of a partly legible plate, ``?`` for any one."""
    return F.rlike(read, F.concat(F.lit("^"), F.regexp_replace(partial, r"\?", "."), F.lit("$")))
