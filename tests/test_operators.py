"""Operators and scalar functions on small tables."""

import random

from pyspark.sql import functions as F

from tarnlens.functions import text as T
from tarnlens.operators import closure, lines, merge, rank, resolve, state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, T.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, T.truncated(F.lit("abc def"), 4)) == "abc…"
    assert one(spark, T.truncated(F.lit("abc"), 0)) == "abc"
    assert one(spark, T.url_quoted(F.lit("a b/~*"), safe_slash=True)) == "a%20b/~%2A"
    assert one(spark, T.display_time(F.lit("2024-01-02T03:04:05"))) == "2024-01-02 03:04:05"
    assert one(spark, T.display_time(F.lit("soon"))) == "soon"
    assert one(spark, T.titled(F.lit("SQL_INJECTION"))) == "Sql Injection"
    assert one(spark, T.progress_percent(F.lit(1), F.lit(2))) == 82
    assert one(spark, T.progress_percent(F.lit(1), F.lit(0))) == 92
    assert one(spark, T.merged_text(F.array(F.lit("a"), F.lit(""), F.lit("a"), F.lit("b")), "also")) == "a\n\nalso: b"
    assert one(spark, T.without_fences(F.lit("a\n```\nb\n```\nc"))) == "a\nc"
    assert one(spark, T.snippet_lines(F.lit("  9 | a\n> 10 | b"))[1]) == 10


def test_context(spark):
    text = F.split(F.lit("a\nb\nc\nd\ne"), "\n")
    assert one(spark, lines.rendered_context(text, F.lit(2).cast("bigint"), 1)) == "  1 | a\n> 2 | b\n  3 | c"


def test_global_rank_is_a_total_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 50).alias("a"), "id")
    rows = rank.global_rank(df, [F.col("a"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501))
    assert [(r.a, r.id) for r in rows] == sorted((r.a, r.id) for r in rows)


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    got = {tuple(r) for r in closure.transitive(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 6)}


def test_empty_closure(spark):
    assert closure.transitive(spark.createDataFrame([], "src int, dst int")).count() == 0


def reachable(edges):
    ahead, pairs = {}, set()
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for a in ahead:
        found, left = set(), list(ahead[a])
        while left:
            if (x := left.pop()) not in found:
                found.add(x)
                left += ahead.get(x, ()) if x is not None else ()
        pairs |= {(a, b) for b in found}
    return pairs


def shuffled_records(spark, run):
    """What run() returns, and the records that its stages shuffled."""
    sc, none = spark.sparkContext, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    last = max(stages(), default=-1)
    out = run()
    return out, sum(n for k, n in stages().items() if k > last)


def test_closure_of_chains_shuffles_few_records(spark):
    """Many short chains beside a circle: pairs that are known aren't met and compared again in each round."""
    edges = [(100 * g + i, 100 * g + i + 1) for g in range(200) for i in range(1 + g % 19)] + [(-1, -2), (-2, -3), (-3, -1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, records = shuffled_records(spark, lambda: [tuple(r) for r in closure.transitive(spark.createDataFrame(edges, "src int, dst int")).collect()])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted(reachable(edges))
    assert records < 7 * len(got)


def test_closure_of_any_graph(spark):
    """Small graphs with circles, loops, side paths and repeated edges, and keys that are null."""
    r = random.Random(3)
    edges = [(100 * g + r.randrange(n), 100 * g + r.randrange(n)) for g in range(60) for n in [r.randint(1, 14)] for _ in range(r.randint(1, 26))]
    edges += [(None, -1), (None, -1), (-1, -2), (-2, -3), (-3, -4), (-4, None)]
    got = [tuple(x) for x in closure.transitive(spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert len(got) == len(set(got)) and set(got) == reachable(edges)


def test_dedup_is_idempotent_and_keeps_counts(spark):
    df = spark.createDataFrame([(3, "x  y", "b"), (1, "x y", "a"), (2, "z", "a")], "id int, t string, l string")
    rows = merge.dedup(df, merge.normalised("t"), "id", {"ids": "id", "ls": "l"}).orderBy("first_id").collect()
    assert [(r.duplicate_count, r.first_id, r.ids, r.ls) for r in rows] == [(2, 1, [1, 3], ["a", "b"]), (1, 2, [2], ["a"])]


def test_fold(spark):
    df = spark.createDataFrame([(1, 1, "run", "a"), (1, 2, None, None), (2, 1, None, "c")], "job int, at int, phase string, error string")
    rows = {r.job: (r.phase, r.error, r.updates) for r in state.fold(df, ["job"], ["at"], ["phase"], ["error"]).collect()}
    assert rows == {1: ("run", None, 2), 2: (None, "c", 1)}


def test_resolution(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {r.k: r.u for r in resolve.unique_candidates(df, ["k"], "v", "u").collect()} == {"a": None, "b": 3}


def test_overall_is_half_even(spark):
    df = spark.createDataFrame([(72,), (73,)], "s int")
    assert df.agg(merge.overall("s").alias("x")).first().x == 72
    assert df.limit(0).agg(merge.overall("s").alias("x")).first().x == 100
