"""Filters that may be left out, pages with their total, and ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def where(df: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every value given; None leaves a column out."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df


def containing(text: str, *columns: str) -> Column:
    """Whether any column holds the text, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower())
    return found


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows with the number of all; ``order`` must end in a unique column.

    The page is a top-k of offset + limit rows; the total is a scalar subquery.
    """
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", df.agg(F.count("*")).scalar())


def best(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group in an order."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")
