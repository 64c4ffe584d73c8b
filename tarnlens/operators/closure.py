"""Fixed points of joins, driven from the plan's side: only whether anything is new reaches the driver."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlens.sources.tables import remove, scratch


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None, first: Column | None = None) -> DataFrame:
    """Add what step(delta, all) derives until nothing is new by `keys`.

    Of several rows of a key that arise in one round, the one that comes first by `first` is kept, or by all their other
    columns. A round's new rows are written once, beside those of earlier rounds: nothing is rewritten, and a plan never
    grows with the number of rounds. max_rounds is for callers that want fewer rounds and say so; if rows are still new
    then, that is an error.
    """
    spark = seed.sparkSession
    schema = seed.schema
    table = Rounds(spark, schema)

    def one(df: DataFrame) -> DataFrame:
        rest = [c for c in schema.names if c not in keys]
        if not rest:
            return df.select(*schema.names).distinct()
        order = first if first is not None else F.struct(*rest)
        return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_kept")).select(*(c if c in keys else F.col(f"_kept.{c}").alias(c) for c in schema.names))

    delta = table.add(one(seed))
    for n in itertools.count():
        if delta.isEmpty():
            return table.all()
        if n == max_rounds:
            raise RuntimeError(f"rows are still new after {n} rounds")
        everything = table.all()
        delta = table.add(one(step(delta, everything)).join(everything.select(*keys), keys, "left_anti"))


class Rounds:
    """The rounds of a fixed point: a folder for each, read together."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema = spark, schema
        self.path = scratch(spark, "rounds")
        self.n = 0

    def add(self, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.path}/round={self.n}")
        self.n += 1
        return self.at(self.n - 1)

    def at(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={k}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/round={k}" for k in range(self.n)))

    def drop(self) -> None:
        """Nothing reads them any more."""
        remove(self.spark, self.path)


def transitive(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All reachable pairs, from the paths of 1, 2, 4, ... edges.

    Each of these powers is the one before met with itself. A shortest path is made of different powers, the longest first:
    what the powers down to 2^(k+1) reach is met with the paths of 2^k edges, for k down to 0. Along chains each pair is
    so derived once, and most pairs come from the last join; paths that grow from their short end would meet nearly all
    pairs anew in each round. Powers end with an empty one, or beyond the number of edges, as no shortest path has more.
    Those that don't shrink may go round, so they leave out what an earlier power has, which no shortest path needs.
    Null keys are compared as values and join nothing.
    """
    spark = edges.sparkSession
    seed = edges.select(src, dst)
    powers, reached = Rounds(spark, seed.schema), Rounds(spark, seed.schema)

    def met(ahead: DataFrame, back: DataFrame) -> DataFrame:
        ahead = ahead.select(src, F.col(dst).alias("_by"))
        return ahead.join(back.select(F.col(src).alias("_by"), dst), "_by").select(src, dst)

    def new(rows: DataFrame, known: DataFrame) -> DataFrame:
        both = rows.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
        return both.groupBy(src, dst).agg(F.min("_new").alias("_new")).filter("_new").select(src, dst)

    last = powers.add(seed.distinct())
    size = longest = last.count()
    shrinks = True
    while size and 2**powers.n <= longest:
        rows = met(last, last)
        last = powers.add(rows.distinct() if shrinks else new(rows, powers.all()))
        before, size = size, last.count()
        shrinks &= size < before
    for k in reversed(range(powers.n)):
        power = powers.at(k)
        reached.add(new(power.unionByName(met(reached.all(), power)), reached.all()) if reached.n else power)
    powers.drop()
    return reached.all()
