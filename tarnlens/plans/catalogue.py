"""The query catalogue: each operator of the engine on a driver table, with the SQL that states its meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlens.functions import text as T
from tarnlens.operators import closure, lines, merge, rank, resolve, state
from tarnlens.plans import analysis, fixtures
from tarnlens.plans.registry import ORACLE, QUERIES, query
from tarnlens.sources.tables import dimension, table

TOKEN = r'\btoken\s*=\s*"[0-9a-f]{40}"'
#: Rule ids and patterns of the scans below, and a literal that a match needs.
DOCUMENT_RULES = [("hex-token", TOKEN, "token"), ("mail", r"[a-z0-9.]+@[a-z0-9]+\.example\.com", ".example.com"), ("address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("license", r"Licensed under", "Licensed under")]
PAGE_RULES = [("script", r"(?i)<script\b"), ("entity", r"&amp;", "&amp;"), ("comment", r"<!--", "<!--")]
#: Event types by priority; two of the dimension's eight never occur.
EVENT_PRIORITY = [("error", 0), ("purchase", 1), ("signup", 2), ("click", 3), ("view", 4), ("refund", 5), ("login", 6), ("logout", 7)]
_PRIORITY_SQL = ", ".join(f"('{t}', {p})" for t, p in EVENT_PRIORITY)


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(length(line)) AS BIGINT) AS longest, CAST(count(*) FILTER (WHERE line = '') AS BIGINT) AS n_blank
FROM l GROUP BY doc_id""")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    split = F.split("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.size(split).cast("bigint").alias("n_lines"), F.array_max(F.transform(split, lambda x: F.char_length(x))).cast("bigint").alias("longest"), F.size(F.filter(split, lambda x: x == "")).cast("bigint").alias("n_blank"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS no FROM documents WHERE contains(text, 'token =')),
hit AS (SELECT doc_id, min(no) AS spot FROM l WHERE contains(line, 'token =') GROUP BY doc_id),
near AS (SELECT h.doc_id, h.spot, l.no, l.line, max(l.no) OVER (PARTITION BY h.doc_id) AS last FROM hit h JOIN l ON l.doc_id = h.doc_id AND l.no BETWEEN h.spot - 3 AND h.spot + 3)
SELECT doc_id, spot AS line, string_agg((CASE WHEN no = spot THEN '> ' ELSE '  ' END) || lpad(CAST(no AS VARCHAR), CAST(length(CAST(last AS VARCHAR)) AS INTEGER), ' ') || ' | ' || line, chr(10) ORDER BY no) AS snippet
FROM near GROUP BY doc_id, spot""")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    found = lines.with_lines(table(spark, d, "documents").filter(F.col("text").contains("token =")), "text")
    at = lines.first_line(F.col("lines"), lambda x: x.contains("token ="))
    return found.select("doc_id", at.alias("line"), lines.rendered_context(F.col("lines"), at).alias("snippet"))


@query(rf"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) AS n_secrets, regexp_extract_all(text, '{TOKEN}')[1] AS first_secret
FROM documents WHERE regexp_matches(text, '{TOKEN}')""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    return table(spark, d, "documents").filter(F.col("text").contains("token") & F.col("text").rlike(TOKEN)).select("doc_id", F.size(found).cast("bigint").alias("n_secrets"), F.element_at(found, 1).alias("first_secret"))


_RULES_SQL = " UNION ALL ".join(f"SELECT 'documents' AS source, doc_id AS id, '{n}' AS rule FROM documents WHERE regexp_matches(text, '{p}')" for n, p, *_ in DOCUMENT_RULES) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'pages' AS source, page_id AS id, '{n}' AS rule FROM pages WHERE regexp_matches(html, '{p}')" for n, p, *_ in PAGE_RULES)


@query(_RULES_SQL)
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    one = lines.scan(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", "text", DOCUMENT_RULES)
    two = lines.scan(table(spark, d, "pages").withColumnRenamed("page_id", "id"), "id", "html", PAGE_RULES)
    return one.withColumn("source", F.lit("documents")).unionByName(two.withColumn("source", F.lit("pages")))


SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
COMMENT = r"(?s)<!--.*?-->"


@query(rf"""SELECT page_id, CAST(len(regexp_extract_all(html, '{SCRIPT}')) AS BIGINT) AS n_blocks, CAST(list_sum(list_transform(regexp_extract_all(html, '{SCRIPT}'), lambda x: length(x))) AS BIGINT) AS n_chars FROM pages""")
def statement_scan(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(0))
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("bigint").alias("n_blocks"), F.when(F.size(found) > 0, total).alias("n_chars"))


@query(rf"""SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '{COMMENT}', '', 'g'), '{SCRIPT}')) AS BIGINT) AS n_blocks, CAST(length(html) - length(regexp_replace(html, '{COMMENT}', '', 'g')) AS BIGINT) AS n_commented FROM pages""")
def comment_exclusion(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("html", COMMENT, "")
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(bare, F.lit(SCRIPT), F.lit(0))).cast("bigint").alias("n_blocks"), (F.char_length("html") - F.char_length(bare)).cast("bigint").alias("n_commented"))


@query("SELECT page_id, contains(html, '<script') AS has_script, contains(html, '&amp;') AS has_escape, contains(html, '<script') AND NOT contains(html, '&amp;') AS unsafe FROM pages")
def sanitizer_check(spark: SparkSession, d: str) -> DataFrame:
    script, escape = F.col("html").contains("<script"), F.col("html").contains("&amp;")
    return table(spark, d, "pages").select("page_id", script.alias("has_script"), escape.alias("has_escape"), (script & ~escape).alias("unsafe"))


@query(r"""
SELECT CAST(count(*) AS BIGINT) AS duplicate_count, min(doc_id) AS first_id, list(doc_id ORDER BY doc_id) AS related_ids, list_sort(list(DISTINCT lang)) AS langs
FROM documents GROUP BY trim(regexp_replace(text, '\s+', ' ', 'g'))""")
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.dedup(table(spark, d, "documents"), F.sha2(merge.normalised("text"), 256), "doc_id", {"related_ids": "doc_id", "langs": "lang"})
    return merged.withColumn("langs", F.array_sort("langs"))


@query(r"""
SELECT min(d.doc_id) AS first_id, CAST(max(l.quality) AS INTEGER) AS best_quality, arg_min(d.doc_id, (-l.quality, d.doc_id)) AS best_doc, CAST(count(*) AS BIGINT) AS n
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY trim(regexp_replace(d.text, '\s+', ' ', 'g'))""")
def merge_best_confidence(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy(F.sha2(merge.normalised("text"), 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.max("quality").cast("int").alias("best_quality"), F.min_by("doc_id", F.struct(-F.col("quality"), "doc_id")).alias("best_doc"), F.count("*").alias("n")).drop("k")


@query(f"""
WITH dim(event_type, p) AS (VALUES {_PRIORITY_SQL}),
r AS (SELECT e.event_id, e.event_type, row_number() OVER (ORDER BY coalesce(p, 99), user_id, ts, event_id) AS rank FROM events e LEFT JOIN dim USING (event_type))
SELECT event_id, event_type, CAST(rank AS BIGINT) AS rank, 'VULN-' || (CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END) AS id FROM r""")
def risk_order(spark: SparkSession, d: str) -> DataFrame:
    dim = dimension(spark, EVENT_PRIORITY, "event_type string, p int")
    ranked = table(spark, d, "events").join(F.broadcast(dim), "event_type", "left").select("event_id", "event_type", F.coalesce("p", F.lit(99)).alias("p"), "user_id", "ts")
    return rank.global_rank(ranked, [F.col("p"), F.col("user_id"), F.col("ts"), F.col("event_id")]).select("event_id", "event_type", F.col("rank").cast("bigint").alias("rank"), rank.numbered("rank").alias("id"))


@query(f"WITH dim(event_type, p) AS (VALUES {_PRIORITY_SQL}) SELECT dim.event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM dim LEFT JOIN events e USING (event_type) GROUP BY dim.event_type")
def count_by_type_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return merge.counts_zero_filled(table(spark, d, "events"), dimension(spark, EVENT_PRIORITY, "event_type string, p int").select("event_type"), "event_type")


@query("""
WITH dim(event_type) AS (VALUES ('error'), ('purchase'), ('refund')), c AS (SELECT event_type, count(*) AS n FROM events WHERE coalesce(event_type, '') <> '' GROUP BY 1)
SELECT coalesce(dim.event_type, c.event_type) AS event_type, CAST(coalesce(n, 0) AS BIGINT) AS n FROM dim FULL JOIN c ON dim.event_type = c.event_type""")
def count_by_category_extra(spark: SparkSession, d: str) -> DataFrame:
    return merge.counts_with_extra(table(spark, d, "events"), dimension(spark, [("error",), ("purchase",), ("refund",)], "event_type string"), "event_type")


@query("SELECT o_custkey, CAST(greatest(0, 100 - 10 * count(*)) AS BIGINT) AS score FROM orders GROUP BY o_custkey")
def file_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(merge.deducted(F.count("*")).alias("score"))


@query("SELECT CAST(round_even(avg(score), 0) AS BIGINT) AS overall, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT greatest(0, 100 - 10 * count(*)) AS score FROM orders GROUP BY o_custkey)")
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    return file_score(spark, d).agg(merge.overall("score").alias("overall"), F.count("*").alias("n_files"))


@query("SELECT c_custkey, CAST(greatest(0, 100 - 10 * count(o_orderkey)) AS BIGINT) AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def clean_files_score_100(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counted, "c_custkey", "left").select("c_custkey", merge.deducted(F.coalesce("n", F.lit(0).cast("bigint"))).alias("score"))


#: Description and confidence by event type.
METADATA = [("error", "raised", "HIGH"), ("purchase", "", "LOW"), ("click", "pressed", None), ("view", None, "MEDIUM")]


@query("""
WITH dim(event_type, about, confidence) AS (VALUES ('error', 'raised', 'HIGH'), ('purchase', '', 'LOW'), ('click', 'pressed', NULL), ('view', NULL, 'MEDIUM'))
SELECT event_id, coalesce(nullif(CASE WHEN value > 50 THEN '' ELSE props END, ''), about) AS description, coalesce(CASE WHEN value > 50 THEN NULL ELSE 'SET' END, confidence) AS confidence
FROM events LEFT JOIN dim USING (event_type)""")
def metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    dim = dimension(spark, METADATA, "event_type string, about string, confidence string")
    big = F.col("value") > 50
    joined = table(spark, d, "events").join(F.broadcast(dim), "event_type", "left")
    return joined.select("event_id", F.coalesce(F.nullif(F.when(big, F.lit("")).otherwise(F.col("props")), F.lit("")), "about").alias("description"), F.coalesce(F.when(big, F.lit(None).cast("string")).otherwise(F.lit("SET")), "confidence").alias("confidence"))


@query("SELECT p_brand, p_size, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved FROM part GROUP BY p_brand, p_size")
def unique_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unique_candidates(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "resolved")


@query("""
SELECT n_nationkey, n_name, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS only_supplier
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def interface_single_impl(spark: SparkSession, d: str) -> DataFrame:
    one = resolve.unique_candidates(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "only_supplier")
    return table(spark, d, "nation").join(one, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", "only_supplier")


@query("""
WITH a AS (SELECT p_brand, p_size, p_type, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS v FROM part GROUP BY ALL), b AS (SELECT p_brand, p_size, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS v FROM part GROUP BY ALL)
SELECT p.p_partkey, coalesce(a.v, b.v) AS resolved FROM part p LEFT JOIN a ON p.p_brand = a.p_brand AND p.p_size = a.p_size AND p.p_type = a.p_type LEFT JOIN b ON p.p_brand = b.p_brand AND p.p_size = b.p_size""")
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    three, two = ["p_brand", "p_size", "p_type"], ["p_brand", "p_size"]
    levels = [(resolve.unique_candidates(part, three, "p_partkey", "a"), three, "a"), (resolve.unique_candidates(part, two, "p_partkey", "b"), two, "b")]
    return resolve.cascade(part, levels, "resolved").select("p_partkey", "resolved")


@query("""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS arg, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS pos FROM part), dim(pos, param) AS (VALUES (0, 'first'), (1, 'second'), (2, 'third'))
SELECT p_partkey, pos, arg, param FROM t JOIN dim USING (pos)""")
def positional_args(spark: SparkSession, d: str) -> DataFrame:
    params = dimension(spark, [(0, "first"), (1, "second"), (2, "third")], "pos int, param string")
    return resolve.positional(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("args")), "args", F.broadcast(params), "pos").select("p_partkey", "pos", "arg", "param")


@query("""
WITH dim(id, brand, size, type, page) AS (VALUES ('g1', 'Brand#11', 5, 'x', 30), ('g2', 'Brand#22', 10, 'x', 10), ('g3', 'Brand#11', 10, 'x', 20), ('g4', 'Brand#33', 15, 'x', 5)),
s AS (SELECT p_partkey, id, page, (CASE WHEN p_brand = brand THEN 100 ELSE 0 END) + (CASE WHEN p_size = size THEN 30 ELSE 0 END) AS base, (CASE WHEN p_size > size THEN 5 ELSE 0 END) AS bonus FROM part CROSS JOIN dim),
r AS (SELECT *, base + bonus AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY base + bonus DESC, page, id) AS k FROM s WHERE base > 0)
SELECT p_partkey, CAST(score AS INTEGER) AS score, id AS guide FROM r WHERE k = 1""")
def guideline_scored_join(spark: SparkSession, d: str) -> DataFrame:
    dim = dimension(spark, [("g1", "Brand#11", 5, 30), ("g2", "Brand#22", 10, 10), ("g3", "Brand#11", 10, 20), ("g4", "Brand#33", 15, 5)], "id string, brand string, size int, page int")

    def score(g):
        base = F.when(F.col("p_brand") == g["brand"], 100).otherwise(0) + F.when(F.col("p_size") == g["size"], 30).otherwise(0)
        return F.when(base > 0, base + F.when(F.col("p_size") > g["size"], 5).otherwise(0)).otherwise(0)

    best = resolve.best_scored(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), dim, score, 1, ["page", "id"], "p_partkey")
    return best.filter("best IS NOT NULL").select("p_partkey", F.col("score").cast("int").alias("score"), F.col("best.id").alias("guide"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_custkey = o.o_custkey AND g.o_orderstatus = 'P')")
def guard_antijoin(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    guarded = orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    return orders.select("o_orderkey", "o_custkey").join(guarded, "o_custkey", "left_anti")


_OP_SQL = "CASE event_type WHEN 'error' THEN 'gen' WHEN 'signup' THEN 'kill' END"


def _op():
    return F.when(F.col("event_type") == "error", "gen").when(F.col("event_type") == "signup", "kill")


@query(f"""
WITH s AS (SELECT event_id, user_id, event_type, last_value({_OP_SQL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM events)
SELECT event_id, user_id, state FROM s WHERE event_type = 'purchase'""")
def taint_state_at_sink(spark: SparkSession, d: str) -> DataFrame:
    return state.state_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], _op()).filter("event_type = 'purchase'").select("event_id", "user_id", "state")


@query(f"SELECT user_id, arg_max({_OP_SQL}, (ts, event_id)) AS state FROM events WHERE {_OP_SQL} IS NOT NULL GROUP BY user_id")
def last_write_state(spark: SparkSession, d: str) -> DataFrame:
    return state.last_write(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], _op())


@query("""
WITH s AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS seen FROM conversations)
SELECT conv_id, turn, seen FROM s WHERE role = 'assistant'""")
def context_seen_before(spark: SparkSession, d: str) -> DataFrame:
    return state.seen_before(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "system").filter("role = 'assistant'").select("conv_id", "turn", "seen")


@query("SELECT conv_id, role, CAST(count(*) AS BIGINT) AS arity, role || '/' || CAST(count(*) AS VARCHAR) AS signature, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role")
def method_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("arity"), F.concat_ws("/", "role", F.count("*").cast("string")).alias("signature"), F.min("turn").alias("first_turn"))


@query("SELECT l_orderkey AS caller, list(l_partkey ORDER BY first_seen, l_partkey) AS callees FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_seen FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    seen = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("caller")).agg(F.array_distinct(seen).alias("callees"))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
c(src, dst) AS (SELECT src, dst FROM e WHERE dst IS NOT NULL UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src WHERE e.dst IS NOT NULL)
SELECT src, dst FROM c""")
def summary_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return closure.transitive(table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL"))


@query("""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, list(o_orderkey ORDER BY o_orderkey)[1:5] AS first_ids, list_sort(list(DISTINCT o_custkey))[1:3] AS first_customers, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers FROM orders GROUP BY o_orderstatus""")
def group_payload(spark: SparkSession, d: str) -> DataFrame:
    # the lists are cut to their first k before they are gathered, so a group of any size sends k rows
    orders = table(spark, d, "orders")
    first = lambda rows, c, k, name: rows.withColumn("_k", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(c))).filter(F.col("_k") <= k).groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(c)).alias(name))
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))
    ids = first(orders.select("o_orderstatus", "o_orderkey"), "o_orderkey", 5, "first_ids")
    customers = first(orders.select("o_orderstatus", "o_custkey").distinct(), "o_custkey", 3, "first_customers")
    return counts.join(ids, "o_orderstatus").join(customers, "o_orderstatus")


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25")
def topn_detailed(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_n(table(spark, d, "events"), [F.col("ts"), F.col("event_id")], 25).select("event_id", "event_type")


@query("SELECT source, list_sort(list(DISTINCT lang)) AS langs, CAST(count(DISTINCT lang) AS BIGINT) AS n_langs FROM documents GROUP BY source")
def citation_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs")).withColumn("n_langs", F.size("langs").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_orderkey) - 1 AS BIGINT) AS siblings FROM lineitem")
def sibling_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.count("*").over(Window.partitionBy("l_orderkey")) - 1).alias("siblings"))


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, list_sort(list(DISTINCT CAST(o_orderdate AS DATE))) AS ds FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(n AS BIGINT) AS n, array_to_string(list_transform(ds[1:4], lambda x: CAST(x AS VARCHAR)), ', ') || (CASE WHEN len(ds) > 4 THEN ' +' || CAST(len(ds) - 4 AS VARCHAR) ELSE '' END) AS shown FROM g""")
def file_table(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("o_orderdate").cast("date"))).alias("ds"))
    more = F.when(F.size("ds") > 4, F.concat(F.lit(" +"), (F.size("ds") - 4).cast("string"))).otherwise("")
    return grouped.select("o_custkey", "n", F.concat(F.array_join(F.transform(F.slice("ds", 1, 4), lambda x: x.cast("string")), ", "), more).alias("shown"))


@query("SELECT event_type, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    # the window is over one row per type
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query(rf"""
WITH v AS (SELECT l.toxic = 1 AS truth, regexp_matches(d.text, '(?i)\b(idiot|moron|scum|trash|loser)\b') AS verdict FROM documents d JOIN labels l USING (doc_id))
SELECT truth, verdict, CASE WHEN truth AND verdict THEN 'TP' WHEN truth THEN 'FN' WHEN verdict THEN 'FP' ELSE 'TN' END AS cell, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.col("text").rlike(r"(?i)\b(idiot|moron|scum|trash|loser)\b")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("toxic") == 1).alias("truth"), verdict.alias("verdict"))
    cell = F.when(F.col("truth") & F.col("verdict"), "TP").when(F.col("truth"), "FN").when(F.col("verdict"), "FP").otherwise("TN")
    return rows.groupBy("truth", "verdict").agg(F.count("*").alias("n")).withColumn("cell", cell)


USER = 7


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = {USER} OR o_orderstatus = 'P'")
def visible_results(spark: SparkSession, d: str) -> DataFrame:
    return rank.visible(table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderstatus") == "P", USER).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = {USER} OR o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def top_n_results(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.visible(table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderstatus") == "P", USER)
    return rank.top_n(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20).select("o_orderkey", "o_orderdate")


@query("""
WITH w AS (SELECT min(url) AS exact, regexp_extract(min(url), '[^/]*$') AS base FROM pages),
m AS (SELECT page_id, url, url = exact AS same FROM pages, w WHERE url = exact OR regexp_extract(url, '[^/]*$') = base)
SELECT page_id, url FROM m WHERE same OR NOT EXISTS (SELECT 1 FROM m WHERE same)""")
def file_lookup_two_tier(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", T.basename("url").alias("base"))
    wanted = F.broadcast(pages.agg(F.min("url").alias("exact")).withColumn("want", T.basename("exact")))
    found = pages.join(wanted, (F.col("url") == F.col("exact")) | (F.col("base") == F.col("want"))).withColumn("same", F.col("url") == F.col("exact"))
    some = found.agg(F.coalesce(F.max("same"), F.lit(False)).alias("some"))
    return found.crossJoin(F.broadcast(some)).filter("same OR NOT some").select("page_id", "url")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(CASE WHEN event_type = 'purchase' THEN value END, (ts, event_id)) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) AS last_purchase, CAST(count(*) AS BIGINT) AS updates
FROM events GROUP BY user_id""")
def job_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return state.fold(rows, ["user_id"], ["ts", "event_id"], ["last_purchase"], ["status"])


@query("""
SELECT doc_id, CASE WHEN length(text) > 137 THEN rtrim(substr(text, 1, 137)) || '…' ELSE text END AS title, CASE WHEN length(text) > 220 THEN rtrim(substr(text, 1, 220)) || '…' ELSE text END AS preview FROM documents""")
def truncate_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated("text", 137).alias("title"), T.truncated("text", 220).alias("preview"))


@query("""
SELECT page_id, 'https://host/blob/' || url_encode('ref ' || CAST(page_id AS VARCHAR)) || '/' || replace(url_encode(url), '%2F', '/') || '#L' || CAST(page_id + 1 AS VARCHAR) || '-L' || CAST(page_id + 4 AS VARCHAR) AS link FROM pages""")
def source_link(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("ref "), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", T.source_link(F.lit("https://host/"), ref, F.col("url"), F.col("page_id") + 1, F.col("page_id") + 4).alias("link"))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("SELECT source, list_sort(list(DISTINCT w)) AS words FROM (SELECT source, unnest([lang, source]) AS w FROM documents) WHERE trim(w) <> '' GROUP BY source")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set("source").alias("b"))
    return grouped.select("source", F.array_sort(T.distinct_filled(F.array_union("a", "b"))).alias("words"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_missing FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_inclusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").distinct().join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_missing"))


@query("""
WITH o AS (SELECT item_id, CAST(1 + coalesce(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM benchmark)
SELECT item_id, page_start, CAST(lead(page_start, 1, 1000000) OVER (ORDER BY item_id) - 1 AS BIGINT) AS page_end FROM o""")
def page_ends(spark: SparkSession, d: str) -> DataFrame:
    # a benchmark is a stated set of items; its order is one window
    w = Window.orderBy("item_id")
    starts = table(spark, d, "benchmark").select("item_id", (1 + F.coalesce(F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("bigint").alias("page_start"))
    return starts.withColumn("page_end", F.lead("page_start", 1, 1_000_000).over(w) - 1)


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS k FROM l)
SELECT doc_id, CAST(count(*) FILTER (WHERE NOT fence AND k % 2 = 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(length(line)) FILTER (WHERE NOT fence AND k % 2 = 0), 0) AS BIGINT) AS n_chars FROM f GROUP BY doc_id""")
def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    kept = F.aggregate(F.split("text", "\n", -1), F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("c")), lambda a, x: F.when(F.ltrim(x).startswith("```"), F.struct((~a["inside"]).alias("inside"), a["n"].alias("n"), a["c"].alias("c"))).when(a["inside"], a).otherwise(F.struct(a["inside"].alias("inside"), (a["n"] + 1).alias("n"), (a["c"] + F.char_length(x)).alias("c"))))
    return table(spark, d, "documents").select("doc_id", kept.alias("k")).select("doc_id", F.col("k.n").alias("n_lines"), F.col("k.c").alias("n_chars"))


def _fixture_files(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(fixtures.SOURCES.items()), "file string, content string")


def values(rows: list[tuple], kinds: list[str], names: list[str]) -> str:
    """SQL of some constant rows."""
    shown = lambda x: "NULL" if x is None else "[" + ", ".join(map(shown, x)) + "]" if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({shown(x)} AS {k})" for x, k in zip(r, kinds, strict=True)) + ")" for r in rows) + f") AS x({', '.join(names)})"


@query(values(fixtures.EXPECTED, ["VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "VARCHAR", "VARCHAR"], ["id", "type", "file", "line", "function", "confidence"]))
def java_findings(spark: SparkSession, d: str) -> DataFrame:
    return analysis.prioritize(analysis.findings(_fixture_files(spark))).select("id", "type", "file", "line", "function", "confidence")


@query(values([(c, list(names)) for c, names in fixtures.EXPECTED_CALLS], ["VARCHAR", "VARCHAR[]"], ["caller", "callees"]))
def java_call_graph(spark: SparkSession, d: str) -> DataFrame:
    return analysis.call_graph(analysis.syntax_nodes(_fixture_files(spark)))


@query(values([("shop/Catalog.java", 80), ("shop/Page.java", 80), ("shop/Tools.java", 50), ("shop/items.xml", 90)], ["VARCHAR", "BIGINT"], ["file", "score"]))
def java_scores(spark: SparkSession, d: str) -> DataFrame:
    files = _fixture_files(spark)
    return analysis.scores(analysis.prioritize(analysis.findings(files)), files)


from tarnlens.plans import catalogue_functions, catalogue_project  # noqa: E402, F401  they add their queries
