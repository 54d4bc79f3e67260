import random
from functools import lru_cache

from pyspark.sql import functions as F

from fieldglass.functions import plates
from fieldglass.operators import joins

GLYPHS = "GJ01AB60OD8B"


def plain_distance(a, b):
    if a == b:
        return 0.0
    if not a or not b:
        return float(max(len(a), len(b)))

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return 0.5 * (i + j)
        x, y = a[i - 1], b[j - 1]
        cost = 0.0 if x == y else 0.35 if x + y in plates.CONFUSED or y + x in plates.CONFUSED else 1.0
        return min(d(i - 1, j) + 0.5, d(i, j - 1) + 0.5, d(i - 1, j - 1) + cost)

    return d(len(a), len(b))


def near(rng, p):
    p = list(p)
    for _ in range(rng.randint(0, 3)):
        k, r = rng.randrange(len(p)), rng.random()
        if r < 0.6:
            p[k] = rng.choice(GLYPHS)
        elif r < 0.8 and len(p) > 3:
            del p[k]
        else:
            p.insert(k, rng.choice(GLYPHS))
    return "".join(p)


def test_distance_and_prefilter(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("", "A"), ("GJ01", ""), ("GJ01AB1234", "GJ01AB1284"), ("GJ01AB1234", "6J01AB1234"), ("GJ01AB1234", "GJ01AB123")]
    for _ in range(400):
        a = "".join(rng.choices(GLYPHS, k=rng.randint(1, 10)))
        pairs.append((a, near(rng, a)))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", plates.distance(a, b).alias("d"), plates.distance(b, a).alias("back"), plates.distance_within(a, b).alias("w")).collect():
        want = plain_distance(r.a, r.b)
        assert abs(r.d - want) < 1e-9 and abs(r.back - want) < 1e-9
        assert (r.w is None) == (r.d > 1.0)
        assert (r.d == 0) == (r.a == r.b)


def test_fuzzy_join_loses_no_pair(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices(GLYPHS, k=rng.randint(4, 10))) for _ in range(60)]
    seen = sorted({near(rng, rng.choice(base)) for _ in range(250)})
    got = joins.fuzzy_join(spark.createDataFrame([(p,) for p in seen if len(p) > 2], "plate string"), spark.createDataFrame([(p,) for p in set(base)], "watched string"))
    assert {(r.plate, r.watched) for r in got.collect()} == {(a, b) for a in seen for b in set(base) if len(a) > 2 and plain_distance(a, b) <= 1.0}


def test_forms(spark):
    df = spark.createDataFrame([("ind gj-01 ab 1234",), (None,), ("21 BH 1234 AA",), ("INDIND01",), ("XX99",)], "p string")
    got = df.select(plates.clean(F.col("p")).alias("c"), plates.registry_form(F.col("p")).alias("r")).collect()
    assert [(r.c, r.r) for r in got] == [("GJ01AB1234", "INDGJ01AB1234"), ("", ""), ("21BH1234AA", "21BH1234AA"), ("IND01", "INDIND01"), ("XX99", "XX99")]
    assert [r.s for r in df.select(plates.state_of(plates.clean(F.col("p"))).alias("s")).collect()] == ["GJ", None, "BH", None, None]


def test_grammar_cases(spark):
    """Layouts, priors and reasons of plates of every kind."""
    rows = {
        "GJ01AB1234": ("std_s2_n4", 1.0, []), "DL3CCN5712": ("dl_short", 0.42, []), "GJ3CCN5712": (None, 0.0, ["no_format_match"]), "XX01AB1234": ("std_s2_n4", 0.05, ["unknown_state"]),
        "GJ00AB1234": ("std_s2_n4", 0.005, ["unknown_office", "district_00"]), "GJ44AB1234": ("std_s2_n4", 0.1, ["unknown_office"]), "MH60AB1234": ("std_s2_n4", 0.21, ["district_out_of_range"]), "GJ01IO1234": ("std_s2_n4", 0.35, ["rare_series_letter"]),
        "21BH1234AA": ("bharat", 0.15, []), "50BH1234AA": ("bharat", 0.03, ["implausible_year"]), "77CD123": ("dipl_CD", 0.01, []), "77UN1234": ("dipl_UN_4", 0.01, []), "GJVA123456": ("vintage", 0.005, []), "GJ01TC1234": ("std_s2_n4", 1.0, []),
        "DL1AC1234": ("dl_short_s1", 0.245, []), "WB991": ("std_s0_n1", 0.021, []), "": (None, 0.0, ["no_format_match"]),
    }
    df = spark.createDataFrame([(p,) for p in rows], "p string").select("p", plates.grammar(F.col("p")).alias("g"))
    for r in df.collect():
        assert (r.g.layout, round(r.g.prior, 6), r.g.reasons, r.g.valid) == (*rows[r.p], rows[r.p][0] is not None), r


def test_overlay_and_slots(spark):
    overlay = {"20260614": True, "GJ012031": True, "155AM": True, "1155PMX": True, "REC01": True, "AB12HRS": True, "123456A": True, "22BH1234AA": False, "GJ01AB1234": False, "X12345678": True, "22AB1234": True, "GJ012040": False}
    got = spark.createDataFrame([(p,) for p in overlay], "p string").select("p", plates.looks_like_overlay(F.col("p")).alias("o")).collect()
    assert {r.p: r.o for r in got} == overlay
    fixed = {"6J01AB1Z34": "GJ01AB1234", "GJ01AB1234": None, "GJO1A8I234": "GJ01AB1234", "XY": None}
    got = spark.createDataFrame([(p,) for p in fixed], "p string").select("p", plates.coerced(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == fixed
    assert plates.slots_of(10) == "AADDAADDDD" and plates.slots_of(3) is None
