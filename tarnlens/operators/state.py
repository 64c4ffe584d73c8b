"""Ordered state: what holds of a variable just before, at, or ever before an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_before(df: DataFrame, by: list[str], order: list[str], op: Column, out: str = "state") -> DataFrame:
    """The last non-null op of earlier rows of the group: kill and gen replace each other."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(op, ignorenulls=True).over(w))


def last_write(df: DataFrame, by: list[str], order: list[str], op: Column, out: str = "state") -> DataFrame:
    """The last op of each whole group."""
    return df.withColumn("_op", op).filter("_op IS NOT NULL").groupBy(*by).agg(F.max_by("_op", F.struct(*order)).alias(out))


def seen_before(df: DataFrame, by: list[str], order: list[str], flag: Column, out: str = "seen") -> DataFrame:
    """Whether the flag held at this row or an earlier one of the group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.coalesce(F.max(flag).over(w), F.lit(False)))


def fold(df: DataFrame, by: list[str], order: list[str], kept: list[str], overwritten: list[str]) -> DataFrame:
    """Latest state of each group from its updates: in `kept` a null leaves the older value, in `overwritten` it replaces it."""
    at = F.struct(*order)
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in kept] + [F.max_by(c, at).alias(c) for c in overwritten]
    return df.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("updates"))
