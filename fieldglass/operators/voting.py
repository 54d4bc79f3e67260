"""Fusing repeated readings of one track: votes, thresholds, support and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import plates


def string_vote(readings: DataFrame, by: list[str], text: str, weight: str, crop: str, alternates: int = 3) -> DataFrame:
    """The text of most weight of each group, its share, strength and alternates.

    A winner needs two distinct crops. Strength grows with the number of readings
    and their mean weight.
    """
    texts = readings.groupBy(*by, text).agg(F.sum(weight).alias("w"), F.countDistinct(crop).alias("crops"), F.avg(weight).alias("p"), F.count("*").alias("n"))
    rank = W.partitionBy(*by).orderBy(F.desc("w"), text)
    ranked = texts.withColumn("place", F.row_number().over(rank)).withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(*by)))
    strength = 1 - F.pow(1 - F.least(F.col("p"), F.lit(1.0)), F.col("n"))
    top = F.when(F.col("place") == 1, F.struct(F.col(text).alias("text"), "crops", "share", strength.alias("strength")))
    out = ranked.filter(F.col("place") <= alternates + 1).groupBy(*by).agg(F.max(top).alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", F.col(text).alias("x"))))), lambda s: s["x"]), ",").alias("alternates"))
    return out.select(*by, "t.text", "t.crops", "t.share", (F.col("t.share") * F.col("t.strength")).alias("confidence"), (F.col("t.crops") >= 2).alias("won"), "alternates")


def support(readings: DataFrame, winners: DataFrame, by: list[str], text: str, source: str) -> DataFrame:
    """How many sources read the winner exactly, and how many within one edit."""
    j = readings.join(winners.select(*by, F.col("text").alias("_w")), by)
    return j.groupBy(*by).agg(F.countDistinct(F.when(F.col(text) == F.col("_w"), F.col(source))).alias("exact_sources"), F.countDistinct(F.when(F.levenshtein(text, "_w") <= 1, F.col(source))).alias("near_sources"))


# How little a layout's prior counts beside the vote, the least prior, and what a vote that no layout fits writes for a missing glyph.
PRIOR_POWER, LEAST_PRIOR, UNREAD = 0.3, 1e-3, "?"


def aligned(anchor: Column, text: Column) -> Column:
    """For each glyph of ``anchor`` the glyph of ``text`` that a cheapest alignment puts there; null where it puts none.

    Walks back from the ends by the edit distances of what is left of both; an
    equal or exchanged glyph goes before a missing one, and that before one too many.
    Neither text is empty.
    """
    head = lambda s, k: F.substr(s, F.lit(1), k)
    none = F.lit(None).cast("string")

    def back(at: Column, _: Column) -> Column:
        i, j, out = at["i"], at["j"], at["out"]
        mine, other = F.substr(anchor, i, F.lit(1)), F.substr(text, j, F.lit(1))
        here = F.levenshtein(head(anchor, i), head(text, j))
        across = F.levenshtein(head(anchor, i - 1), head(text, j - 1)) + (mine != other).cast("int")
        missing = F.levenshtein(head(anchor, i - 1), head(text, j)) + 1
        to = lambda i, j, *glyph: F.struct(i.alias("i"), j.alias("j"), F.concat(F.array(*glyph), out).alias("out") if glyph else out.alias("out"))
        return F.when(i == 0, at).when((j > 0) & (here == across), to(i - 1, j - 1, other)).when((j == 0) | (here == missing), to(i - 1, j, none)).otherwise(to(i, j - 1))

    start = F.struct(F.length(anchor).alias("i"), F.length(text).alias("j"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.length(anchor) + F.length(text)), start, back)["out"]


def _slots(spark) -> DataFrame:
    """The slots of all layouts: n (length), layout, weight, i (from 0) and slot."""
    rows = [(len(template), name, float(weight), i, slot) for name, template, weight in plates.LAYOUTS for i, slot in enumerate(template)]
    return spark.createDataFrame(rows, "n int, layout string, weight double, i int, slot string")


def rover(readings: DataFrame, key: str, text: str, weight: str, supported_only: bool = False) -> DataFrame:
    """The text that the weighted glyphs of a group's readings make under the likeliest layout, and the mean share of its glyphs.

    Readings of any length vote: each is aligned to the anchor, the weightiest
    reading of the length of most weight, and votes for the glyphs that come to lie
    in its places. Every layout of that length takes for each slot the glyph of
    most weight that fits; of the layouts that fill all slots, that of the largest
    mean share times a power of its text's prior wins. ``supported_only`` chooses
    among the group's own valid readings of that length instead, where there are
    any. If no layout can be filled, each place's weightiest glyph stands.

    Equal texts are summed first and aligned once for each pair of distinct texts.
    Ties go to the longer length, the first text or glyph of the alphabet, and the
    weightier layout. Empty and null readings don't count.
    """
    spark = readings.sparkSession
    c = F.col
    texts = readings.filter(c(text) != "").groupBy(key, c(text).alias("text")).agg(F.sum(weight).alias("w"), F.max(weight).alias("top"))
    length = texts.groupBy(key, F.length("text").alias("n")).agg(F.sum("w").alias("w")).groupBy(key).agg(F.max_by("n", F.struct("w", "n")).alias("n"))
    same = texts.join(length, key).filter(F.length("text") == c("n"))
    anchors = same.groupBy(key, "n").agg(F.min_by("text", F.struct(-c("top"), c("text"))).alias("anchor"))
    voters = texts.join(anchors, key)
    pairs = voters.select("anchor", "text").distinct().withColumn("glyphs", F.when(c("anchor") == c("text"), F.split("text", "", F.length("text"))).otherwise(aligned(c("anchor"), c("text"))))
    votes = voters.join(pairs, ["anchor", "text"]).select(key, "n", "w", F.posexplode("glyphs").alias("i", "g")).filter("g is not null").groupBy(key, "n", "i", "g").agg(F.sum("w").alias("w"))
    votes = votes.withColumn("share", c("w") / F.sum("w").over(W.partitionBy(key, "n", "i")))

    fits = F.when(c("slot") == "A", c("g").between("A", "Z")).when(c("slot") == "D", c("g").between("0", "9")).otherwise(c("g") == F.upper("slot"))
    first = F.min(F.struct((-c("w")).alias("w"), "g", "share"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t.g"))), lambda x: x["g"]), "").alias("text")
    per_slot = votes.join(_slots(spark), ["n", "i"]).filter(fits).groupBy(key, "n", "layout", "weight", "i").agg(first.alias("t"))
    made = per_slot.groupBy(key, "n", "layout", "weight").agg(F.count("*").alias("filled"), F.avg("t.share").alias("share"), word).filter(c("filled") == c("n"))
    made = made.select(key, "text", "share", F.lit(1).alias("rank"), c("weight").alias("tie"), c("layout").alias("last"))
    raw = votes.groupBy(key, "n", "i").agg(first.alias("t")).groupBy(key).agg(F.avg("t.share").alias("share"), word)
    found = made.unionByName(raw.select(key, "text", "share", F.lit(0).alias("rank"), F.lit(0.0).alias("tie"), F.lit("").alias("last")))
    if supported_only:
        own = same.select(key, "text", F.posexplode(F.split("text", "", F.length("text"))).alias("i", "g")).join(votes.select(key, "i", "g", "share"), [key, "i", "g"], "left")
        own = own.groupBy(key, "text").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("share"))
        found = found.unionByName(own.select(key, "text", "share", F.lit(2).alias("rank"), F.lit(0.0).alias("tie"), c("text").alias("last")))
    graded = found.select("text").distinct().withColumn("g", plates.grammar(c("text"))).select("text", "g.prior", "g.valid")
    found = found.join(graded, "text").filter((c("rank") < 2) | c("valid"))
    score = c("share") * F.pow(F.greatest("prior", F.lit(LEAST_PRIOR)), F.lit(PRIOR_POWER))
    best = F.struct("rank", F.when(c("rank") > 0, score).alias("score"), "tie", "last")
    return found.groupBy(key).agg(F.max_by(F.struct("text", "share", "prior"), best).alias("b")).select(key, c("b.text").alias("fused"), "b.share", "b.prior")


def fused_reads(readings: DataFrame, key: str, text: str, weight: str, enhanced: Column, penalty: float = 0.6, temperature: float = 1.0, alternates: int = 3, supported_only: bool = False) -> DataFrame:
    """:func:`rover` with the agreement of the readings, a calibrated confidence and the best alternates.

    Agreement is the share of weight of readings within one edit. If the readings of
    ``enhanced`` pictures and the others each favour another text, ``penalty``
    applies. Alternates are readings within two edits by weight; ``supported`` tells
    whether any reading is the fused text itself.
    """
    won = rover(readings, key, text, weight, supported_only)
    texts = readings.filter(F.col(text) != "").groupBy(key, F.col(text).alias("text"), enhanced.alias("sr")).agg(F.sum(weight).alias("w"))
    top = texts.groupBy(key, "sr").agg(F.max_by("text", F.struct("w", "text")).alias("t")).groupBy(key).agg((F.countDistinct("t") > 1).alias("sr_disagree"))
    near = texts.groupBy(key, "text").agg(F.sum("w").alias("w")).join(won.select(key, "fused"), key).withColumn("edits", F.levenshtein("text", "fused"))
    rank = W.partitionBy(key).orderBy((F.col("edits") > 2) | (F.col("edits") == 0), F.desc("w"), "text")
    near = near.withColumn("place", F.row_number().over(rank))
    others = F.array_sort(F.collect_list(F.when((F.col("place") <= alternates) & F.col("edits").between(1, 2), F.struct("place", "text"))))
    agreement = (F.sum(F.when(F.col("edits") <= 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("agreement")
    near = near.groupBy(key).agg(agreement, F.max(F.col("edits") == 0).alias("supported"), F.array_join(F.transform(others, lambda x: x["text"]), ",").alias("alternates"))
    raw = F.col("share") * (0.5 + 0.5 * F.col("prior")) * F.col("agreement") * F.when(F.col("sr_disagree"), penalty).otherwise(1.0)
    logit = F.log(F.col("raw") / (1 - F.col("raw"))) / temperature
    confidence = F.when((F.col("raw") <= 0) | (F.col("raw") >= 1) | F.lit(temperature == 1.0), F.col("raw")).otherwise(1 / (1 + F.exp(-logit)))
    out = won.join(near, key).join(top, key).withColumn("raw", raw).withColumn("confidence", confidence)
    return out.select(key, "fused", "share", "agreement", "prior", "supported", "sr_disagree", "confidence", "alternates")


# Crops and share that decide a reader's own vote; crops that each kind of reader and all together need to agree; edits of a rival.
LEAST_CROPS, LEAST_SHARE, EACH_KIND, BOTH_KINDS, RIVAL_EDITS = 4, 0.3, 2, 6, 2


def vote_pick(readings: DataFrame, key: str, text: str, weight: str, crop: str, reader: str, kind: str, primary: str, near_backing: int = 2, least_crops: int = LEAST_CROPS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The text that a track's readers settle on, and by which rule.

    Readings name their ``reader`` and its ``kind``; each reader votes alone. In turn:

    - ``cross_reader``: readers of two kinds have the same text, each on EACH_KIND crops and
      all on BOTH_KINDS, and no rival has as many;
    - ``primary``, or ``contested`` if opposed: the primary reader's own vote decides;
    - ``other_reader``: another's own vote decides, isn't opposed, and is backed: some other
      reader has the text, or readers of another kind have it but for one glyph on
      ``near_backing`` crops;
    - ``secondary``: the vote of all readers together, where it differs from the primary's;
    - ``undecided``: the primary's own vote.

    A rival is another text within RIVAL_EDITS that isn't the text with one glyph
    missing. A vote is opposed if another reader's own vote has a rival on
    ``least_crops`` crops while that reader has the text on fewer, unless readers of two
    kinds have the text. Texts meet only within their track.
    """
    c = F.col
    rows = readings.filter(c(text) != "").select(key, c(text).alias("text"), c(weight).alias("w"), c(crop).alias("crop"), c(reader).alias("reader"), c(kind).alias("kind"))
    per = rows.groupBy(key, "text", "reader", "kind").agg(F.countDistinct("crop").alias("on"))
    whole = rows.groupBy(key, "text").agg(F.countDistinct("crop").alias("all_on"))
    kinds = per.groupBy(key, "text").agg(F.countDistinct(F.when(c("on") >= EACH_KIND, c("kind"))).alias("kinds"))
    votes = string_vote(rows, [key, "reader"], "text", "w", "crop").select(key, "reader", "text", "crops", "share", ((c("crops") >= least_crops) & (c("share") >= least_share)).alias("decided"))
    votes = votes.join(per.groupBy(key, "reader").agg(F.first("kind").alias("kind")), [key, "reader"])

    agreed = whole.join(kinds, [key, "text"]).filter((c("kinds") >= 2) & (c("all_on") >= BOTH_KINDS))
    others = whole.select(key, c("text").alias("other"), c("all_on").alias("other_on"))
    beaten = agreed.join(others, key).filter((c("other") != c("text")) & (c("other_on") >= c("all_on")) & (F.levenshtein("other", "text", RIVAL_EDITS) >= 0)).select(key, "text").distinct()
    cross = agreed.join(beaten, [key, "text"], "left_anti").groupBy(key).agg(F.min_by("text", F.struct(-c("all_on"), c("text"))).alias("cross"))

    sure = votes.filter("decided").select(key, "reader", c("kind").alias("own_kind"), "text")
    theirs = votes.select(key, c("reader").alias("o"), c("text").alias("s")).filter(c("crops") >= least_crops)
    edits = F.levenshtein("s", "text")
    dropped = (F.length("s") == F.length("text") - 1) & (edits == 1)
    against = sure.join(theirs, key).filter((c("o") != c("reader")) & (c("s") != c("text")) & (edits <= RIVAL_EDITS) & ~dropped)
    against = against.join(per.select(key, "text", c("reader").alias("o"), "on"), [key, "text", "o"], "left").filter(F.coalesce("on", F.lit(0)) < least_crops)
    against = against.join(kinds.filter("kinds >= 2"), [key, "text"], "left_anti").select(key, "reader").distinct().withColumn("opposed", F.lit(True))
    exact = sure.join(per.select(key, "text", c("reader").alias("o")), [key, "text"]).filter(c("o") != c("reader")).select(key, "reader").distinct()
    crops = rows.select(key, c("text").alias("s"), "crop", "kind").distinct()
    close = sure.join(crops, key).filter((c("kind") != c("own_kind")) & (F.length("s") == F.length("text")) & (F.levenshtein("s", "text") == 1))
    close = close.groupBy(key, "reader").agg(F.countDistinct("crop").alias("n")).filter(c("n") >= near_backing).select(key, "reader")
    sure = sure.join(exact.union(close).distinct().withColumn("backed", F.lit(True)), [key, "reader"], "left").join(against, [key, "reader"], "left")
    free = c("opposed").isNull()

    mine = sure.filter(c("reader") == primary).select(key, c("text").alias("mine"), c("opposed").isNotNull().alias("mine_opposed"))
    second = sure.filter((c("reader") != primary) & c("backed") & free).groupBy(key).agg(F.min_by("text", "reader").alias("second"))
    pooled = string_vote(rows, [key], "text", "w", "crop").select(key, c("text").alias("pooled"))
    own = votes.filter(c("reader") == primary).select(key, c("text").alias("own"))
    out = pooled.join(cross, key, "left").join(mine, key, "left").join(second, key, "left").join(own, key, "left")
    differs = c("own").isNull() | (c("own") != c("pooled"))
    rule = F.when(c("cross").isNotNull(), "cross_reader").when(c("mine").isNotNull(), F.when(c("mine_opposed"), "contested").otherwise("primary")).when(c("second").isNotNull(), "other_reader").when(differs, "secondary").otherwise("undecided")
    return out.select(key, F.coalesce("cross", "mine", "second", F.when(differs, c("pooled")).otherwise(c("own"))).alias("text"), rule.alias("rule"))
