"""Scalar, array and set functions of the engine on the driver's tables, each with the SQL that states its meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlens.functions import text as T
from tarnlens.operators import rank, resolve, state
from tarnlens.plans import report
from tarnlens.plans.registry import query
from tarnlens.sources.tables import table


@query("SELECT page_id, array_to_string(p[greatest(1, len(p) - 2):], '/') AS shown, array_to_string(p[len(p):], '/') AS name FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.last_parts("url", 3).alias("shown"), T.last_parts("url", 1).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'at noon' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS shown FROM orders")
def display_times(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("o_orderkey") % 7 == 0, F.lit("at noon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", T.display_time(given).alias("shown"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_type, '_', ' ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title, upper(replace(lower(p_brand) || '_x', '_', '-')) AS algorithm FROM part")
def titles_and_algorithms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.titled(F.upper(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("title"), T.algorithm(F.concat(F.lower("p_brand"), F.lit("_x"))).alias("algorithm"))


@query("""
SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'O' THEN '  ' ELSE o_orderstatus END), ''), nullif(trim(o_orderpriority), '')) AS filled, lower(trim(' ' || o_orderpriority)) = lower(trim(upper(o_orderpriority) || ' ')) AS same,
  coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER), 0) AS whole FROM orders""")
def filled_same_and_whole(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", F.lit("  ")).otherwise(F.col("o_orderstatus"))
    number = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    same = T.same_key(F.concat(F.lit(" "), "o_orderpriority"), F.concat(F.upper("o_orderpriority"), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", T.first_filled(status, F.col("o_orderpriority")).alias("filled"), same.alias("same"), T.safe_int(number).alias("whole"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fenced_objects(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.fenced_json(given), "$.k").cast("int").alias("k"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ' ' || lang END AS patch FROM documents")
def proposed_patches(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, "## Other").when(F.col("doc_id") % 3 == 1, "## 수정 예시").otherwise("### Proposed patch")
    given = F.concat(F.lit("# Title\n\ntext\n"), head, F.lit("\n\n"), "source", F.lit(" "), "lang", F.lit("\n\n## Next\nmore\n"))
    return table(spark, d, "documents").select("doc_id", T.proposed_patch(given).alias("patch"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 92 ELSE 72 + round_even(greatest(0, least(event_id % 60 - 5, event_id % 5 * 10)) / (event_id % 5 * 10) * 20, 0) END AS INTEGER) AS percent FROM events")
def progress_percents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.progress_percent(F.col("event_id") % 60 - 5, F.col("event_id") % 5 * 10).cast("int").alias("percent"))


@query(r"""
SELECT p_partkey, 'report-' || coalesce(nullif(regexp_replace(regexp_replace('-' || p_name || '/' || p_brand, '[^a-zA-Z0-9\-_.]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'analysis') || '-' || substr(md5(p_name), 1, 8) || '.pdf' AS name,
  coalesce(nullif(lower(regexp_replace(regexp_replace(CASE WHEN p_partkey % 4 = 0 THEN '!?' ELSE p_brand || ' ' || p_type || '!' END, '[^0-9A-Za-z]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'item-' || CAST(p_partkey AS VARCHAR)) AS slug FROM part""")
def report_names_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    item = F.when(F.col("p_partkey") % 4 == 0, F.lit("!?")).otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit("!")))
    return table(spark, d, "part").select("p_partkey", T.report_name(F.concat(F.lit("-"), "p_name", F.lit("/"), "p_brand"), F.md5("p_name")).alias("name"), T.slug(item, "p_partkey").alias("slug"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS no FROM documents),
hit AS (SELECT doc_id, min(no) AS spot FROM l WHERE contains(line, 'token =') GROUP BY doc_id)
SELECT h.doc_id, CAST(min(l.no) AS INTEGER) AS first_line, CAST(max(l.no) AS INTEGER) AS last_line FROM hit h JOIN l ON l.doc_id = h.doc_id AND l.no BETWEEN h.spot - 3 AND h.spot + 3 GROUP BY h.doc_id""")
def snippet_ranges(spark: SparkSession, d: str) -> DataFrame:
    from tarnlens.plans import catalogue

    first, last = T.snippet_lines("snippet")
    return catalogue.line_context(spark, d).select("doc_id", first.alias("first_line"), last.alias("last_line"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 180 THEN rtrim(substr(text, 1, 180)) || '…' ELSE text END AS body, lang AS short, CAST(2 AS INTEGER) AS n_keys FROM documents""")
def nested_truncation(spark: SparkSession, d: str) -> DataFrame:
    given = F.create_map(F.lit("body"), F.col("text"), F.lit("short"), F.col("lang"), F.lit("By_Severity"), F.col("source"))
    kept = table(spark, d, "documents").select("doc_id", T.without_key(T.truncated_values(given, 180), "byseverity").alias("m"))
    return kept.select("doc_id", F.col("m")["body"].alias("body"), F.col("m")["short"].alias("short"), F.size("m").alias("n_keys"))


@query("""
SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN 'org-' || CAST(page_id % 7 AS VARCHAR) END AS owner, CASE WHEN page_id % 4 <> 3 THEN 'repo.' || CAST(page_id AS VARCHAR) END AS name FROM pages""")
def repository_addresses(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(F.col("page_id") % 4 == 3, "https://example.com/").otherwise("https://github.com/")
    end = F.when(F.col("page_id") % 4 == 1, ".git").when(F.col("page_id") % 4 == 2, "/ ").otherwise("")
    given = F.concat(host, F.lit("org-"), (F.col("page_id") % 7).cast("string"), F.lit("/repo."), F.col("page_id").cast("string"), end)
    got = table(spark, d, "pages").select("page_id", T.repository_address(given).alias("r"))
    return got.select("page_id", F.col("r.owner").alias("owner"), F.col("r.name").alias("name"))


@query("""
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN (CASE WHEN n = 0 THEN 'sink' ELSE 'function' END) WHEN i = n THEN 'sink' WHEN roles[i] = 'system' THEN 'control' ELSE 'data' END) AS kinds,
  'run' || roles[n] AS sink FROM c""")
def chain_kinds_and_sinks(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    steps = F.concat(F.array(F.lit("Talk.open")), F.transform("roles", lambda r, i: F.when(i == F.size("roles") - 1, F.concat(F.lit("out.run"), r, F.lit("(x)"))).when(r == "system", F.lit("limit of turns")).otherwise(r)))
    chains = table(spark, d, "conversations").groupBy("conv_id").agg(ordered.alias("roles")).select("conv_id", steps.alias("chain"), F.lit("open").alias("function"))
    return chains.select("conv_id", T.step_kinds("chain", "function").alias("kinds"), T.chain_sink("chain", "function").alias("sink"))


@query("""
WITH c AS (SELECT conv_id, list(CASE WHEN turn % 3 = 0 THEN '' ELSE role END ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, list_reduce(list_prepend('', texts), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || chr(10) || 'More: ' || x END) AS merged FROM c""")
def merged_texts(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("role"))
    texts = given.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("texts"))
    return texts.select("conv_id", T.merged_text("texts", "More").alias("merged"))


@query("""
WITH f AS (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL)
SELECT conv_id, list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) AS turns FROM f GROUP BY conv_id""")
def struct_union_by_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("steps"))
    kept = rows.select("conv_id", T.merged_structs("steps", ["role"]).alias("steps"))
    return kept.select("conv_id", F.transform("steps", lambda x: x["role"]).alias("roles"), F.transform("steps", lambda x: x["turn"]).alias("turns"))


@query("""
SELECT o_orderpriority, list_sort(list_intersect(list(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F'), list(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O'))) AS both_sides FROM orders GROUP BY o_orderpriority""")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    some = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_custkey")))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.array_sort(F.array_intersect(some("F"), some("O"))).alias("both_sides"))


@query("""
SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS l_quantity FROM lineitem GROUP BY l_partkey""")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", at).alias("l_orderkey"), F.min_by("l_quantity", at).alias("l_quantity"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 2")
def second_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rank.nth(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id")


@query("SELECT CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT coalesce(nullif(source, 'src3'), '')) AS BIGINT) AS impacted_files, CAST(round_even(avg(n_chars % 101), 0) AS BIGINT) AS overall FROM documents")
def report_overview(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return report.overview(docs.select(F.nullif("source", F.lit("src3")).alias("file")), docs.select((F.col("n_chars") % 101).alias("score")))


@query("SELECT l_orderkey AS caller, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 10")
def call_graph_excerpt(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("caller")).agg(F.count("*").alias("n"))
    return rank.top_n(counted, [F.col("caller")], 10)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS segment, n FROM (SELECT *, CAST(count(*) OVER (PARTITION BY c_nationkey) AS BIGINT) AS n FROM customer)""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows by key with their latest particulars, and how many keys share a nation: what an upsert checks for clashes."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    new = customers.filter("c_custkey % 5 = 0").withColumn("segment", F.lit("new"))
    merged = rank.latest(customers.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1))), ["c_custkey"], F.col("at"))
    shared = merged.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return merged.join(shared, "c_nationkey").select("c_custkey", "segment", "n")


@query("""
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE value >= 40) AS percent, arg_max(CASE WHEN event_type IN ('click', 'view') THEN event_type END, (ts, event_id)) FILTER (WHERE event_type IN ('click', 'view')) AS phase, arg_max(event_type, (ts, event_id)) AS status
FROM events WHERE user_id % 2 = 1 GROUP BY user_id""")
def owned_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of jobs from their events, read by one owner: a null leaves percent and phase, the status is the last one's."""
    rows = table(spark, d, "events").filter("user_id % 2 = 1").select("user_id", "ts", "event_id", F.when(F.col("value") >= 40, F.col("value")).alias("percent"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("phase"), F.col("event_type").alias("status"))
    return state.fold(rows, ["user_id"], ["ts", "event_id"], ["percent", "phase"], ["status"]).drop("updates")


@query("""
SELECT doc_id, CASE WHEN length(text) <= 900 THEN 'full' WHEN length(substr(text, 1, 240)) + 200 * (doc_id % 5) <= 900 THEN 'compacted' ELSE 'skipped_context_budget_exceeded' END AS payload_status,
  CAST(CASE WHEN length(text) <= 900 THEN length(text) WHEN length(substr(text, 1, 240)) + 200 * (doc_id % 5) <= 900 THEN 240 + 200 * (doc_id % 5) END AS INTEGER) AS n FROM documents""")
def payload_budget(spark: SparkSession, d: str) -> DataFrame:
    short = F.concat(F.substring("text", 1, 240), F.repeat(F.lit("x"), (F.col("doc_id") % 5 * 200).cast("int")))
    held = report.within_budget(table(spark, d, "documents"), "text", 900, short)
    return held.select("doc_id", "payload_status", F.char_length("payload").alias("n"))


@query("SELECT n_nationkey, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'related': [n_regionkey, 1]}) AS VARCHAR) AS body FROM nation")
def json_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.array("n_regionkey", F.lit(1)).alias("related"))).alias("body"))


@query(r"""
SELECT page_id, trim(regexp_extract('  Map' || (CASE WHEN page_id % 2 = 0 THEN '<K, V>' ELSE '[][]' END), '^[^<\[]*')) AS bare, regexp_replace((CASE WHEN page_id % 3 = 0 THEN 'this.' ELSE 'that.' END) || 'x', '^this\.', '') AS name FROM pages""")
def bare_types(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("  Map"), F.when(F.col("page_id") % 2 == 0, "<K, V>").otherwise("[][]"))
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "this.").otherwise("that."), F.lit("x"))
    return table(spark, d, "pages").select("page_id", T.bare_type(made).alias("bare"), T.without_this(name).alias("name"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
k AS (SELECT doc_id, line, no FROM l WHERE NOT regexp_matches(line, '(?i)token|CWE'))
SELECT d.doc_id, CAST(coalesce(length(regexp_replace(regexp_replace(coalesce(string_agg(k.line, chr(10) ORDER BY no), ''), '
{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')), 0) AS INTEGER) AS n FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def sanitized_texts(spark: SparkSession, d: str) -> DataFrame:
    given = F.concat(F.lit("<script src='x'></script>"), "text", F.lit("\n</form>"))
    return table(spark, d, "documents").select("doc_id", F.char_length(T.sanitized_markdown(given, r"(?i)token|CWE")).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(^|[^a-z])' || split_part(p_name, ' ', 2) || '([^a-z]|$)') THEN 1 ELSE 0 END AS own, CAST(count(*) FILTER (WHERE regexp_matches(p_name, '(^|[^a-z])' || w || '([^a-z]|$)')) AS BIGINT) AS n
FROM part, (VALUES ('red'), ('steel'), ('small'), ('widget'), ('blue')) AS v(w) GROUP BY p_partkey, p_name""")
def mentioned_variables(spark: SparkSession, d: str) -> DataFrame:
    """Which names an argument's text mentions as whole words: a join by pattern with a table of a few names."""
    names = ["red", "steel", "small", "widget", "blue"]
    whole = lambda w: F.concat(F.lit("(^|[^a-z])"), w, F.lit("([^a-z]|$)"))
    hits = F.filter(F.array(*map(F.lit, names)), lambda w: F.regexp_like("p_name", whole(w)))
    own = F.regexp_like("p_name", whole(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return table(spark, d, "part").select("p_partkey", own.cast("int").alias("own"), F.size(hits).cast("bigint").alias("n"))


@query("""
WITH f AS (SELECT c_custkey, c_nationkey AS k, c_mktsegment AS t FROM customer), l AS (SELECT c_custkey, c_nationkey AS k, 'local' AS t FROM customer WHERE c_custkey % 4 = 0)
SELECT f.c_custkey, f.k, coalesce(l.t, f.t) AS type FROM f LEFT JOIN l USING (c_custkey)""")
def variable_types(spark: SparkSession, d: str) -> DataFrame:
    """Fields and locals by name; a local hides the field."""
    fields = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("type"))
    locals_ = fields.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("local").alias("type"))
    levels = [(locals_, ["c_custkey"], "type"), (fields.select("c_custkey", "type"), ["c_custkey"], "type")]
    return resolve.cascade(fields.drop("type"), levels, "type").select("c_custkey", "k", "type")


@query("""
WITH p AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, list_distinct(list_filter(w, lambda x: x IN ('the', 'of', 'la', 'der')))[1:0] || list_filter(['the', 'of', 'la', 'der'], lambda x: list_contains(w, x)) AS held FROM p""")
def identifiers_held(spark: SparkSession, d: str) -> DataFrame:
    """Which names of a set an expression reads."""
    return table(spark, d, "documents").select("doc_id", F.array_intersect(F.array(*map(F.lit, ("the", "of", "la", "der"))), F.split("text", " ")).alias("held"))


@query("SELECT event_type, CAST(to_json(map_from_entries(list((k, n) ORDER BY k))) AS VARCHAR) AS counts FROM (SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def counts_as_maps(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return counted.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, arg_max(o_orderstatus, v) AS status, max(v) AS version FROM (SELECT *, 1 AS v FROM orders UNION ALL SELECT * REPLACE ('X' AS o_orderstatus), 2 AS v FROM orders WHERE o_orderkey % 6 = 0 AND o_custkey % 2 = 0) GROUP BY ALL)
SELECT o_orderkey, status, CAST(version AS INTEGER) AS version FROM r""")
def owner_updates(spark: SparkSession, d: str) -> DataFrame:
    """Versions of stored rows: only the owner's change counts, and the last version is read."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    asked = rows.filter("o_orderkey % 6 = 0").withColumns({"status": F.lit("X"), "version": F.lit(2)})
    mine = asked.filter("o_custkey % 2 = 0")
    return rank.latest(rows.unionByName(mine), ["o_orderkey"], F.col("version")).select("o_orderkey", "status", "version")


@query("SELECT o_custkey, CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS INTEGER) AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) QUALIFY place <= 20")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of a report's first findings: all is ranked, twenty are shown."""
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rank.top_n(counted, [F.desc("n"), F.col("o_custkey")], 20).select("o_custkey", F.row_number().over(Window.orderBy(F.desc("n"), "o_custkey")).alias("place"))


