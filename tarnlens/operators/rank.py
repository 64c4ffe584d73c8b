"""Total orders, ranks over whole tables, first and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlens.sources.tables import settled


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Row numbers from 1 over a whole table, without gathering it in one task.

    Rows are dealt by range of the order; each range is numbered by itself and shifted by the number of rows in the ranges
    before. The ranges are written first: range bounds are sampled, and would differ from one evaluation to the next.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as there are partitions
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def numbered(rank: str, prefix: str = "VULN") -> Column:
    return F.format_string(f"{prefix}-%03d", F.col(rank))


def latest(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The row of each group that is the greatest by an order: an aggregate, combined on the map side, without a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*(c if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns))


def nth(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n-th row of each group in an order, from 1."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") == n).drop("_n")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order; every task keeps n at most."""
    return df.orderBy(*order).limit(max(0, n))


def visible(df: DataFrame, owner: Column, public: Column, user) -> DataFrame:
    """Rows that a user owns or that are public."""
    return df.filter((owner == user) | public)
