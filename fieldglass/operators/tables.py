"""Mutable tables kept as rows over time: latest by key, upserts, versions, splits and reports of a sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*key, *(F.col(f"_m.{c}").alias(c) for c in rest))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table after new rows replaced those of their keys."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def verdicts(old: DataFrame, new: DataFrame, key: str, owner: str, fields: list[str], sound: bool = True) -> DataFrame:
    """What a sync makes of each key: created, updated, unchanged, conflict (another's) or stale.

    Only a ``sound`` sync (one that saw rows and had no errors) makes rows stale.
    """
    o = old.select(F.col(key), F.col(owner).alias("_oo"), F.struct(*fields).alias("_of"), F.lit(True).alias("_old"))
    n = new.select(F.col(key), F.col(owner).alias("_no"), F.struct(*fields).alias("_nf"), F.lit(True).alias("_new"))
    verdict = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), F.lit("stale" if sound else "unchanged"))
        .when(F.col("_oo") != F.col("_no"), "conflict")
        .when(F.col("_of").eqNullSafe(F.col("_nf")), "unchanged")
        .otherwise("updated")
    )
    return o.join(n, key, "full").select(key, verdict.alias("verdict"))


def classified(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with the code of the first rule that they break, null for accepted ones."""
    return rows.withColumn("reject_code", F.coalesce(*(F.when(broken, F.lit(code)) for code, broken in rules)))


def versions(log: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Each entry with a version that rises when the value changes."""
    w = W.partitionBy(*key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return log.withColumn("_c", changed).withColumn("version", F.sum("_c").over(w)).drop("_c")


def reopened(events: DataFrame, key: list[str], quiet_us: int, bucket_us: int, ts: str = "ts") -> DataFrame:
    """Incidents of a key: events extend one until it is quiet longer than ``quiet_us``; a later one gets a bucket's suffix."""
    w = W.partitionBy(*key).orderBy(ts)
    us = F.unix_micros(F.col(ts))
    new = F.when(us - F.lag(us).over(w) > quiet_us, 1).otherwise(0)
    runs = events.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w))
    out = runs.groupBy(*key, "_r").agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.count("*").alias("events"))
    suffix = F.when(F.col("_r") > 0, F.floor(F.col("_first") / bucket_us))
    return out.select(*key, F.concat_ws("_", *key, suffix.cast("string")).alias("incident_id"), F.timestamp_micros("_first").alias("first_seen"), F.timestamp_micros("_last").alias("last_seen"), "events")


def life(log: DataFrame, key: list[str], order: list[str], action: str, starts: list[str], ends: list[str]) -> DataFrame:
    """Each act of a log with its outcome and ``spell``, the number of times that its key had begun.

    A start creates an entry, reactivates one that ended, or is a duplicate of an
    active one; an end closes an active one. Any other act needs an active entry.
    Acts that find the entry in another state are refused; none is ever removed.
    """
    w = W.partitionBy(*key).orderBy(*order)
    up_to = w.rowsBetween(W.unboundedPreceding, -1)
    begins, closes = F.col(action).isin(*starts), F.col(action).isin(*ends)
    active = F.coalesce(F.last(F.when(begins, True).when(closes, False), ignorenulls=True).over(up_to), F.lit(False))
    seen = F.coalesce(F.max(begins).over(up_to), F.lit(False))
    outcome = F.when(begins, F.when(F.col("_active"), "duplicate").when(F.col("_seen"), "reactivated").otherwise("created"))
    outcome = outcome.when(F.col("_active"), F.when(closes, "ended").otherwise("accepted")).otherwise("refused")
    out = log.withColumns({"_active": active, "_seen": seen}).withColumn("outcome", outcome)
    return out.withColumn("spell", F.count_if(F.col("outcome").isin("created", "reactivated")).over(w)).drop("_active", "_seen")


def standing(acts: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The entry of each key after all acts of :func:`life`: since when it exists, whether it is active, fields of its last start."""
    at = F.struct(*order)
    begun = F.col("outcome").isin("created", "reactivated")
    when = F.when(begun | (F.col("outcome") == "ended"), at)
    return acts.groupBy(*key).agg(F.min(F.when(F.col("outcome") == "created", F.col(order[0]))).alias("created"), F.max_by(begun, when).alias("active"), *(F.max_by(f, F.when(begun, at)).alias(f) for f in fields)).filter("created is not null")


def settled(items: DataFrame, acts: DataFrame, key: list[str], order: list[str], action: str, actor: str) -> DataFrame:
    """Items with the state that the first of their acts gave them (null: still open), by whom, when, and how many acts came too late."""
    first = acts.groupBy(*key).agg(F.min_by(F.struct(action, actor, order[0]), F.struct(*order)).alias("_m"), (F.count("*") - 1).alias("late"))
    return items.join(first, key, "left").select(*items.columns, F.col(f"_m.{action}").alias("state"), F.col(f"_m.{actor}").alias("actor"), F.col(f"_m.{order[0]}").alias(order[0]), F.coalesce("late", F.lit(0)).alias("late"))


def archived(df: DataFrame, old: Column, path: str) -> DataFrame:
    """Write the rows in one pass to the folders ``part=archived`` and ``part=kept`` of a path and read both."""
    df.withColumn("part", F.when(old, "archived").otherwise("kept")).write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(df.schema.add("part", "string")).parquet(path)


def appended(log: DataFrame, path: str) -> DataFrame:
    """Append rows to a log that only ever grows and read all of it."""
    log.write.mode("append").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def export_by(df: DataFrame, column: str, path: str) -> None:
    """Write ``df`` as CSV with a header line, a folder for each value of a column; large values get several files."""
    df.write.partitionBy(column).option("header", True).mode("overwrite").csv(path)


def outage(devices: DataFrame, source: str, of: str, checked: Column) -> tuple[DataFrame, DataFrame]:
    """What the failure of a source means: the devices with those of it offline unless withdrawn, and a health sample of each of them."""
    hit = (F.col(of) == source) & (F.col("installation_status") != "WITHDRAWN")
    after = devices.withColumn("health_status", F.when(hit, "offline").otherwise(F.col("health_status")))
    return after, devices.filter(hit).select("camera_id", F.lit("offline").alias("health_status"), F.lit("SOURCE_UNREACHABLE").alias("detail"), checked.alias("checked_at"))
