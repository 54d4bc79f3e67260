"""Answers of departments' services as they were landed: items where they can be read, a typed failure where not.

A puller lands each answer as a line of JSON: source, request, attempt, status (null
if none came), timed_out and body. Nothing here raises: what an answer or an item
lacks becomes a row with the failure's name, and the rest loads. The functions take
batches and streams alike, but for :func:`settled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ANSWER = "source string, request string, attempt int, status int, timed_out boolean, body string"
# The failure that a status means.
FAILURES = {"auth": (401, 403), "rate_limited": (429,), "not_found": (404,), "validation": (400, 422), "conflict": (409,)}
#: Failures that another attempt may mend.
PASSING = ("timeout", "unavailable", "rate_limited", "protocol")


def failure(status: Column, timed_out: Column) -> Column:
    """The name of what went wrong by status; null if nothing did."""
    out = F.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(status.isNull() | (status >= 500), "unavailable")
    for name, codes in FAILURES.items():
        out = out.when(status.isin(*codes), name)
    return out.when(~status.between(200, 299), "protocol")


def read(lines: DataFrame, item: str, key: str, items: str = "items") -> DataFrame:
    """source, request, attempt, item (a struct of the DDL ``item``) and error of landed ``lines`` (value).

    One row for each item of an answer; a row without an item for an answer that
    failed, isn't JSON or has no list of items (``protocol``), or isn't an answer
    itself (``unreadable``); ``item`` for an item without its ``key``.
    """
    a = lines.select(F.from_json("value", ANSWER).alias("a"), "value")
    body = F.from_json("a.body", f"{items} array<struct<{item}>>")[items]
    a = a.withColumn("items", body).withColumn("bad", failure(F.col("a.status"), F.col("a.timed_out")))
    whole = F.when(F.col("a.source").isNull() | F.col("a.request").isNull(), "unreadable").otherwise(F.coalesce("bad", F.when(F.col("items").isNull(), "protocol")))
    a = a.withColumn("error", whole)
    rows = a.select("a.source", "a.request", "a.attempt", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("items"))).alias("item"))
    lacks = F.col("item").isNotNull() & F.col(f"item.{key}").isNull()
    return rows.select("source", "request", "attempt", "item", F.when(lacks, "item").otherwise(F.col("error")).alias("error"))


def settled(rows: DataFrame) -> DataFrame:
    """Of each request the rows of the attempt that counts: the last that loaded, or else the last."""
    tried = rows.groupBy("source", "request", "attempt").agg(F.max(F.when(F.col("error").isNotNull() & (F.col("error") != "item"), 0).otherwise(1)).alias("ok"))
    rank = W.partitionBy("source", "request").orderBy(F.desc("ok"), F.desc("attempt"))
    chosen = tried.withColumn("_place", F.row_number().over(rank)).filter("_place = 1").select("source", "request", "attempt")
    same = F.lit(True)
    for c in ("source", "request", "attempt"):
        same = same & rows[c].eqNullSafe(chosen[c])
    return rows.join(chosen, same, "left_semi")
