"""How filters that are applied in some order hide each other's work.

A filter fails a document or not; five of them give each document a mask of five
cells. The audit walks every order of the filters: which documents a step removes,
which it would have removed if an earlier step hadn't (redundant), what stays, and
what each filter removes over all orders together.

Masks come from one pass over the texts, and only a digest of 16 bytes of each text
is shuffled, to find texts that a smaller doc_id has as well. Documents are counted
by part, mask and labels before anything is unfolded: at most 128 rows for each part.
These are unpivoted against all steps of all orders, running bit-or windows along an
order tell what failed earlier, conditional sums give a step's counts, and a window
over a filter's steps gives its total. All of it is keyed by part, so many parts
spread over the cluster.

Cases: null and empty texts have no words (they fail A) and are copies of each other;
the text of a null doc_id is a copy of none, and none is a copy of it, and it has no
labels; equal doc_ids aren't smaller than each other, so a repeated smallest id
passes E each time; every row counts; several labels of one id count if one of them
says so; an id without labels is neither good nor toxic; a null part is the empty
string; an empty table gives no rows; further columns are ignored, whatever their names.
Texts are compared by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty
from fieldglass.store import job, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
MARKS = b"#$%&*|"

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
SCHEMA = "doc_id bigint, part string, digest binary, mask int"


def text_mask(text: bytes) -> int:
    """The cells A to D of a text in UTF-8: bit k is set if filter k fails it."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 200):
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield record_batch({"doc_id": batch.column(0), "part": batch.column(1), "digest": [blake2b(t, digest_size=16).digest() for t in texts], "mask": [text_mask(t) for t in texts]}, SCHEMA)


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit k: filter k fails it), good and toxic of each document."""
    part_of = F.coalesce(F.col(part).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part_of.alias("part"), text_or_empty().alias("text")).mapInArrow(_masks, SCHEMA)
    rows = stored(rows, "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    found = rows.join(first, "digest", "left").join(marked.filter("good OR toxic"), "doc_id", "left")
    mask = F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask")
    return found.select("doc_id", "part", mask, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of ``filters`` (one letter each) and step, with its counts.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley: what
    the step's filter removes over all orders of the part together.
    """
    counted = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # long form: a row for each mask, order and step; the masks of a part and order stay together from here on
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    orders = counted.withColumn("filter_order", F.explode(orders)).repartition("part", "filter_order")
    cells = orders.select("*", F.posexplode(F.split("filter_order", "", len(filters))).alias("at", "letter"))
    place = F.create_map(*[F.lit(x) for k, letter in enumerate(filters) for x in (letter, 1 << k)])
    cells = cells.withColumn("bit", place[F.col("letter")]).withColumn("step", F.col("at") + 1)
    along = W.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or(F.col("bit").bitwiseAND(F.col("mask"))).over(along), F.lit(0)) != 0
    cells = cells.withColumn("earlier", earlier).withColumn("fails", F.col("bit").bitwiseAND(F.col("mask")) != 0)
    of = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("bigint")
    fails, earlier = F.col("fails"), F.col("earlier")
    steps = cells.groupBy("part", "filter_order", "step", "letter").agg(
        of("n", ~fails & ~earlier).alias("kept"),
        of("n", fails & ~earlier).alias("removed"),
        of("n", fails & earlier).alias("redundant"),
        of("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        of("good", fails & ~earlier).alias("good_lost"),
        of("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    total = F.sum("removed").over(W.partitionBy("part", "letter"))
    return steps.withColumn("shapley", total).drop("letter")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five text filters over ``docs`` (doc_id, text, ``part``), with ``labels`` (doc_id, quality, toxic)."""
    with job(docs.sparkSession, "filter-audit") as result:
        return result(audit(masks(docs, labels, part)))
