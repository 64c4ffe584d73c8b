"""Resolution joins: a name means something only where exactly one candidate bears it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_candidates(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the value of the keys that have one row, null for those that have several."""
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(out))


def cascade(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """The first level that resolves a row: left joins in order of precedence, then a coalesce."""
    names = []
    for i, (candidates, keys, value) in enumerate(levels):
        name = f"_level{i}"
        df = df.join(candidates.select(*keys, F.col(value).alias(name)), keys, "left")
        names.append(name)
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def positional(df: DataFrame, args: str, params: DataFrame, pos: str, how: str = "inner") -> DataFrame:
    """Arguments of an array column joined to parameters by their place, from 0."""
    exploded = df.select(*(c for c in df.columns if c != args), F.posexplode(args).alias(pos, "arg"))
    return exploded.join(params, pos, how)


def best_scored(df: DataFrame, dim: DataFrame, score, least: int, tie: list[str], key: str) -> DataFrame:
    """The dimension row of the highest score for each row: dim is a rule table of a few rows, so this is a map over rules.

    A row keeps its place: the dimension is one array literal on every row, and no pairs leave the task.
    """
    rows = dim.agg(F.collect_list(F.struct(*dim.columns)).alias("_dim"))
    joined = df.crossJoin(F.broadcast(rows))
    scored = F.filter(F.transform("_dim", lambda d: F.struct((-score(d)).alias("s"), *(d[t].alias(t) for t in tie), d.alias("d"))), lambda x: -x["s"] >= least)
    best = F.array_min(scored)
    return joined.select(*df.columns, (-best["s"]).alias("score"), best["d"].alias("best"))
