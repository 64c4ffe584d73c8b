"""Analysis of source trees: scan, parse, detect, merge, rank, enrich, score, as one dataflow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlens.functions import rules as R
from tarnlens.functions import text as T
from tarnlens.operators import flows, merge, rank
from tarnlens.sources.tables import dimension

FINDING = "file string, seq bigint, type string, line int, function string, sink string, evidence string, confidence string, call_chain array<string>, snippet string, steps array<struct<label:string,kind:string,line:int>>"
NODES = "file_path string, node_id int, end_id int, parent_id int, depth int, field string, node_type string, text string, start_line int, start_byte int"


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the Java files below a folder, and of its mapper files; Java files must be UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    java, xml = F.lower("path").endswith(".java"), F.lower("path").endswith(".xml")
    content = F.col("content").cast("string")
    text = F.when(java, F.validate_utf8(content)).otherwise(F.try_validate_utf8(content))
    files = raw.filter(java | xml).select(F.col("path").alias("file"), text.alias("content"))
    return files.filter(F.lower("file").endswith(".java") | F.col("content").rlike(r"(?i)<\s*(?:mapper|sqlMap)\b"))


def syntax_nodes(files: DataFrame) -> DataFrame:
    """One row per syntax node of each Java file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tarnlens.sources.java import parse, rows

        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                got = list(rows(file, parse(content or "")))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])

    return files.filter(F.lower("file").endswith(".java")).select("file", "content").mapInArrow(run, NODES)


def methods(nodes: DataFrame) -> DataFrame:
    """(file_path, method_id, end_id, class_name, method_name, arity, signature, has_body): joins on ids within a file only."""
    here = nodes.filter("node_type = 'method_declaration'").select("file_path", F.col("node_id").alias("method_id"), "end_id", "start_line")
    child = nodes.select("file_path", F.col("parent_id").alias("method_id"), "node_id", "field", "node_type", "text")
    named = child.filter("field = 'name'").select("file_path", "method_id", F.col("text").alias("method_name"))
    bodies = child.filter("field = 'body'").select("file_path", "method_id", F.lit(True).alias("has_body"))
    lists = child.filter("node_type = 'formal_parameters'").select("file_path", "method_id", F.col("node_id").alias("list_id"))
    arity = nodes.filter("node_type = 'formal_parameter'").groupBy("file_path", F.col("parent_id").alias("list_id")).agg(F.count(F.lit(1)).alias("arity"))
    classes = nodes.filter("node_type = 'class_declaration'").select("file_path", F.col("node_id").alias("class_id"), F.col("end_id").alias("class_end"))
    class_names = child.filter("field = 'name'").select("file_path", F.col("method_id").alias("class_id"), F.col("text").alias("class_name"))
    inside = here.join(classes, "file_path").filter("method_id BETWEEN class_id AND class_end").groupBy("file_path", "method_id").agg(F.max("class_id").alias("class_id")).join(class_names, ["file_path", "class_id"])
    out = here.join(named, ["file_path", "method_id"]).join(bodies, ["file_path", "method_id"], "left").join(lists, ["file_path", "method_id"], "left").join(arity, ["file_path", "list_id"], "left").join(inside, ["file_path", "method_id"], "left")
    out = out.select("file_path", "method_id", "end_id", "start_line", "class_name", "method_name", F.coalesce("arity", F.lit(0)).cast("int").alias("arity"), F.coalesce("has_body", F.lit(False)).alias("has_body"))
    return out.withColumn("signature", F.concat(F.coalesce("class_name", F.lit("?")), F.lit("."), "method_name", F.lit("/"), F.col("arity").cast("string")))


def identifiers(nodes: DataFrame) -> DataFrame:
    """(file_path, method_id, method, parameters, identifiers): the names that a method's body reads, in order of first sight;
    names of members and of what is declared aren't read."""
    own = methods(nodes).select("file_path", "method_id", "end_id", F.col("method_name").alias("method"))
    within = lambda rows: rows.join(own, "file_path").filter("node_id > method_id AND node_id <= end_id")
    listed = nodes.filter("node_type = 'formal_parameter'").select("file_path", F.col("node_id").alias("p_id"))
    names = nodes.filter("field = 'name'").select("file_path", F.col("parent_id").alias("p_id"), "node_id", "text")
    given = within(listed.join(names, ["file_path", "p_id"]))
    ordered = lambda: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]))
    params = given.groupBy("file_path", "method_id").agg(ordered().alias("parameters"))
    read = within(nodes.filter("node_type = 'identifier' AND coalesce(field, '') NOT IN ('name', 'field')").select("file_path", "node_id", "text"))
    # those in the innermost method only
    innermost = read.groupBy("file_path", "node_id", "text").agg(F.max("method_id").alias("method_id"))
    held = innermost.groupBy("file_path", "method_id").agg(ordered().alias("identifiers"))
    none = F.array().cast("array<string>")
    out = own.join(params, ["file_path", "method_id"], "left").join(held, ["file_path", "method_id"], "left")
    return out.select("file_path", "method_id", "method", F.coalesce("parameters", none).alias("parameters"), F.coalesce("identifiers", none).alias("identifiers"))


def arguments(nodes: DataFrame) -> DataFrame:
    """(file_path, call_id, call, pos, argument): the arguments of calls by place, from 0."""
    child = nodes.select("file_path", F.col("parent_id").alias("call_id"), "node_id", "field", "text")
    calls = nodes.filter("node_type = 'method_invocation'").select("file_path", F.col("node_id").alias("call_id"))
    names = child.filter("field = 'name'").select("file_path", "call_id", F.col("text").alias("call"))
    lists = child.filter("field = 'arguments'").select("file_path", "call_id", F.col("node_id").alias("list_id"))
    items = nodes.select("file_path", F.col("parent_id").alias("list_id"), "node_id", F.col("text").alias("argument"))
    rows = calls.join(names, ["file_path", "call_id"]).join(lists, ["file_path", "call_id"]).join(items, ["file_path", "list_id"])
    at = Window.partitionBy("file_path", "call_id").orderBy("node_id")
    return rows.select("file_path", "call_id", "call", (F.row_number().over(at) - 1).alias("pos"), "argument")


def variable_types(files: DataFrame) -> DataFrame:
    """(file, class, method, variable, type) of the fields and locals that each method sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tarnlens.operators.detectors import Unit, name_of, owner

        for b in batches:
            out = []
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                for m in Unit(content or "").methods:
                    out += [(file, owner(m), name_of(m), v, t) for v, t in flows.variable_types(m).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(5)], names=["file", "class", "method", "variable", "type"])

    return files.filter(F.lower("file").endswith(".java")).select("file", "content").mapInArrow(run, "file string, class string, method string, variable string, type string")


def resolved(files: DataFrame) -> DataFrame:
    """(caller, call, callee, to_file): the declaration that each call of a project method means."""
    table = flows.fact_table(files)
    own = flows.method_table(table).select("file", "method", F.col("label").alias("caller"))
    return flows.resolved_calls(table).filter("to_file IS NOT NULL").join(own, ["file", "method"]).select("caller", "call", F.col("to_name").alias("callee"), "to_file")


def call_graph(nodes: DataFrame) -> DataFrame:
    """(caller, callees): the distinct names that each method calls, in order of first sight; methods without calls are left out."""
    calls = nodes.filter("node_type = 'method_invocation'").select("file_path", F.col("node_id").alias("call_id"))
    names = nodes.filter("field = 'name'").select("file_path", F.col("parent_id").alias("call_id"), F.col("text").alias("callee"))
    own = methods(nodes).select("file_path", "method_id", "end_id", "class_name", "method_name")
    # the innermost method that holds the call
    held = calls.join(own, "file_path").filter("call_id BETWEEN method_id AND end_id").groupBy("file_path", "call_id").agg(F.max_by(F.struct("class_name", "method_name"), "method_id").alias("m"))
    placed = held.join(names, ["file_path", "call_id"]).select(F.concat_ws(".", "m.class_name", "m.method_name").alias("caller"), "file_path", "call_id", "callee")
    first = F.transform(F.array_sort(F.collect_list(F.struct("file_path", "call_id", "callee"))), lambda x: x["callee"])
    return placed.groupBy("caller").agg(F.array_distinct(first).alias("callees"))


STEP = pa.struct([("label", pa.string()), ("kind", pa.string()), ("line", pa.int32())])


def detect(files: DataFrame, mode: str = "directory") -> DataFrame:
    """Raw findings of each file by itself, with their rendered context and the places of their chains' steps, in one pass.

    In mode 'file' framework parameters aren't sources, and SQL is followed across the methods of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tarnlens.operators.detectors import analyse, chain_details, context

        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(STEP))
        for b in batches:
            out: list[tuple] = []
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                split = (content or "").splitlines()
                for i, f in enumerate(analyse(file, content or "", mode == "directory")):
                    out.append((file, i, *f, context(split, f), [dict(zip(("label", "kind", "line"), d, strict=True)) for d in chain_details(split, f)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in FINDING.split(", ")])

    return files.select("file", "content").mapInArrow(run, FINDING)


#: Findings across methods are numbered after those of a file by itself.
ACROSS = 1_000_000


def findings(files: DataFrame, mode: str = "directory") -> DataFrame:
    """Raw findings of a project: those of its files, and those that flows across methods and files bring."""
    own = detect(files, mode)
    if mode != "directory":
        return own
    across = flows.with_context(flows.cross_method_findings(files), files).withColumn("seq", F.lit(ACROSS).cast("bigint"))
    # where a file by itself already shows markup written unescaped, the flow isn't told again
    known = own.filter("type = 'XSS'").select("file", "type", "line", "function").distinct()
    return own.unionByName(across.join(known, ["file", "type", "line", "function"], "left_anti").select(*own.columns))


def prioritize(found: DataFrame) -> DataFrame:
    """Merge equal findings, order them by risk, number them.

    Equal are findings of one type, file, line, function, context and last step. Their texts are united, their chains and
    steps too, and the best confidence counts; related ids name the merged ones.
    """
    spark = found.sparkSession
    kinds = dimension(spark, [(t, c, r) for t, c, _, r in R.DETECTORS], "type string, cwe string, risk int")
    sure = dimension(spark, R.CONFIDENCE_RANK, "confidence string, sureness int")
    ranked = found.join(F.broadcast(kinds), "type", "left").join(F.broadcast(sure), "confidence", "left").withColumn("sureness", F.coalesce("sureness", F.lit(9)))
    # the context stands in the key as a digest, and what is gathered are a finding's own few texts
    last = F.when(F.size("call_chain") > 0, T.collapse(F.element_at("call_chain", -1))).otherwise("")
    key = ["type", "file", "line", "function", "cwe", "risk"]
    rows = F.array_sort(F.collect_list(F.struct("seq", "sureness", "confidence", "evidence", "call_chain", "steps", "sink", "snippet")))
    merged = ranked.groupBy(*key, F.md5(T.collapse(F.coalesce("snippet", F.lit("")))).alias("_context"), last.alias("_last")).agg(rows.alias("_rows"))
    of = lambda c: F.transform("_rows", lambda x: x[c])
    best = F.array_min(F.transform("_rows", lambda x: F.struct(x["sureness"].alias("sureness"), x["seq"].alias("seq"), x["confidence"].alias("confidence"))))
    united = merged.select(
        *key,
        F.size("_rows").alias("duplicate_count"),
        best["confidence"].alias("confidence"),
        best["sureness"].alias("sureness"),
        T.merged_text(of("evidence"), "Further evidence").alias("evidence"),
        T.distinct_filled(F.flatten(of("call_chain"))).alias("call_chain"),
        F.array_distinct(F.flatten(of("steps"))).alias("steps"),
        F.col("_rows")[0]["sink"].alias("sink"),
        F.col("_rows")[0]["snippet"].alias("snippet"),
        F.col("_rows")[0]["seq"].alias("seq"),
    )
    order = [F.coalesce("risk", F.lit(99)), F.col("sureness"), F.col("file"), F.coalesce("line", F.lit(1_000_000_000)), F.coalesce("function", F.lit("")), F.col("seq"), F.col("sink")]
    numbered = rank.global_rank(united, order)
    return numbered.withColumn("id", rank.numbered("rank")).drop("risk", "sureness", "seq", "rank")


def scores(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file, score): 100 less ten for each finding."""
    counted = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.select("file").join(counted, "file", "left").select("file", merge.deducted(F.coalesce("n", F.lit(0).cast("bigint"))).alias("score"))


def scores_by_name(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(name, score) by file name alone, as summaries show them: of several files of one name that of the greatest path."""
    return scores(findings, files).groupBy(T.basename("file").alias("name")).agg(F.max_by("score", "file").alias("score"))


def analyze(spark: SparkSession, path: str, mode: str = "directory") -> DataFrame:
    """Findings of a folder of sources, merged, ranked and numbered."""
    return prioritize(findings(scan_sources(spark, path), mode))
