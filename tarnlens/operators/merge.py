"""Merging of duplicate findings, counts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlens.functions.text import collapse


def dedup(df: DataFrame, key: Column, seq: str, lists: dict[str, str], extra: list[Column] = ()) -> DataFrame:
    """One row per key: count, first in sequence, and for each of `lists` its distinct values in sequence."""

    def ordered(c: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(c).alias("value"))))
        return F.array_distinct(F.transform(rows, lambda x: x["value"]))

    firsts = [ordered(c).alias(name) for name, c in lists.items()]
    return df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("duplicate_count"), F.min(seq).alias("first_id"), *firsts, *extra).drop("_key")


def normalised(text: str) -> Column:
    return collapse(text)


def counts_zero_filled(df: DataFrame, dim: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Counts for exactly the dimension's members; counted first, so the join is over one row per member."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return dim.join(counted, key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def counts_with_extra(df: DataFrame, dim: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Counts for the dimension's members and for any other that occurs; empty names are left out."""
    counted = df.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return dim.select(key).join(counted, key, "full").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def deducted(n: Column, each: int = 10) -> Column:
    """100 less `each` for every finding, 0 at least."""
    return F.greatest(F.lit(0).cast("bigint"), 100 - each * n)


def overall(score: str) -> Column:
    """The mean of file scores, half to even; 100 without files."""
    return F.coalesce(F.bround(F.avg(score)), F.lit(100.0)).cast("bigint")
