"""Queries over whole projects: flows across files, stored findings, guidelines, archives, reports."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlens.functions import rules as R
from tarnlens.operators import guidelines
from tarnlens.plans import analysis, enrich, fixtures, report
from tarnlens.plans.catalogue import values
from tarnlens.plans.registry import query
from tarnlens.sources import archive
from tarnlens.sources.tables import dimension, put, scratch

SOURCE = "file string, content string"


@query(values(fixtures.PROJECT_EXPECTED, ["VARCHAR", "VARCHAR", "INTEGER", "VARCHAR", "VARCHAR"], ["type", "file", "line", "function", "through"]))
def java_project_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a project; `through` are the methods that the chain passes beyond the finding's own, or that one."""
    found = analysis.prioritize(analysis.findings(dimension(spark, list(fixtures.PROJECT.items()), SOURCE)))
    passed = F.filter("call_chain", lambda x: x.rlike(r"^[A-Z]\w*\.[a-z]\w*$"))
    own = F.concat(F.regexp_extract("file", r"(\w+)\.java$", 1), F.lit("."), F.col("function"))
    beyond = F.filter(passed, lambda x: (x != own) | (F.col("type") == "XSS"))
    return found.select("type", "file", "line", "function", F.array_join(F.when(F.size(beyond) > 0, beyond).otherwise(passed), " > ").alias("through"))


@query(values(fixtures.SINGLE_EXPECTED, ["INTEGER", "VARCHAR", "VARCHAR"], ["line", "function", "sink"]))
def java_single_file(spark: SparkSession, d: str) -> DataFrame:
    files = dimension(spark, [("Single.java", fixtures.SINGLE)], SOURCE)
    return analysis.findings(files, "file").select("line", "function", "sink")


@query(values(fixtures.PROJECT_TYPES, ["VARCHAR"] * 4, ["class", "method", "variable", "type"]))
def java_variable_types(spark: SparkSession, d: str) -> DataFrame:
    """Types by which calls are resolved, constructor injection included."""
    files = dimension(spark, [("web/Front.java", fixtures.PROJECT["web/Front.java"]), ("Injected.java", fixtures.INJECTED)], SOURCE)
    return analysis.variable_types(files).filter("method IN ('search', 'call')").select("class", "method", "variable", "type")


@query(values([("Front.search", "web/FinderImpl.java", "find"), ("Front.sorted", "web/Names.java", "plain"), ("Front.sorted", "web/FinderImpl.java", "find"), ("FinderImpl.find", "web/Rows.java", "byName"), ("Views.row", "web/Views.java", "cell")], ["VARCHAR"] * 3, ["caller", "file", "callee"]))
def java_resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Which declaration a call means: by the receiver's type, through an interface, or as the only one of its name."""
    got = analysis.resolved(dimension(spark, list(fixtures.PROJECT.items()), SOURCE))
    return got.filter("caller IN ('Front.search', 'Front.sorted', 'FinderImpl.find', 'Views.row')").select("caller", F.col("to_file").alias("file"), "callee")


@query(values([("byName", ["name", "n"], ["name", "statement", "sql"]), ("byName", ["n"], ["statement"])], ["VARCHAR", "VARCHAR[]", "VARCHAR[]"], ["method", "parameters", "identifiers"]))
def java_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Each method's parameters, and the names that its body reads, in order of first sight."""
    nodes = analysis.syntax_nodes(dimension(spark, [("web/Rows.java", fixtures.PROJECT["web/Rows.java"])], SOURCE))
    return analysis.identifiers(nodes).select("method", "parameters", "identifiers")


@query(values([("load", 0, "id"), ("load", 0, '"7"'), ("executeQuery", 0, "sql"), ("getParameter", 0, '"id"')], ["VARCHAR", "INTEGER", "VARCHAR"], ["call", "pos", "argument"]))
def java_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls by place."""
    nodes = analysis.syntax_nodes(dimension(spark, [("Single.java", fixtures.SINGLE)], SOURCE))
    return analysis.arguments(nodes).select("call", "pos", "argument")


#: References as their catalogue file has them; the third has next to nothing.
GUIDES = """{"references": [
 {"id": "g-sql", "source": {"title": "Guide", "version": "2019.6", "source_file": "guide.pdf"}, "scope": {"category": "입력데이터 검증 및 표현", "item": "SQL 삽입", "page_start": 178, "page_end": 191},
  "mapping": {"detector_types": ["SQL_INJECTION"], "aliases": ["SQL Injection"]}, "content": {"overview": "about", "security_measures": "bind"}, "citations": [{"source": "Guide", "version": "2019.6", "page_start": 178, "page_end": 191, "section": "SQL"}, {"source": "Guide", "version": "2019.6", "page_start": 180, "page_end": 181, "section": "SQL"}]},
 {"id": "g-hash", "source": {"title": "Guide"}, "scope": {"category": "보안기능", "item": "취약한 암호화 알고리즘 사용", "page_start": 307, "page_end": 313}, "mapping": {"detector_types": ["WEAK_HASH"]}, "content": {"overview": "weak"}, "citations": [{"source": "Guide", "version": "2019.6", "page_start": 307, "page_end": 313, "section": "Hash"}]},
 {"id": "g-none", "scope": {"category": "입력데이터 검증 및 표현", "item": "기타", "page_start": 400}}
]}"""


def _guides(spark: SparkSession) -> DataFrame:
    return guidelines.from_json(dimension(spark, [(GUIDES,)], "value string"))


def _fixture_findings(spark: SparkSession, link: bool = False) -> DataFrame:
    found = analysis.prioritize(analysis.findings(dimension(spark, list(fixtures.SOURCES.items()), SOURCE)))
    return enrich.enriched(found, _guides(spark), *(("https://github.com/org/shop", "main") if link else ()))


@query(values([("g-sql", "Guide", "SQL 삽입", 178, 191, ["SQL_INJECTION"], 2, "bind"), ("g-hash", "Guide", "취약한 암호화 알고리즘 사용", 307, 313, ["WEAK_HASH"], 1, ""), ("g-none", "", "기타", 400, 0, [], 0, "")], ["VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "VARCHAR[]", "INTEGER", "VARCHAR"], ["id", "source_title", "item", "page_start", "page_end", "detector_types", "n_citations", "security_measures"]))
def guideline_source(spark: SparkSession, d: str) -> DataFrame:
    return _guides(spark).select("id", "source_title", "item", "page_start", "page_end", "detector_types", F.size("citations").alias("n_citations"), "security_measures")


@query(values([("g-sql", "입력데이터 검증 및 표현 - SQL 삽입", 178, 191, ["178-191", "180-181"]), ("g-hash", "보안기능 - 취약한 암호화 알고리즘 사용", 307, 313, ["307-313"])], ["VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "VARCHAR[]"], ["id", "section", "page_start", "page_end", "pages"]))
def guideline_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The references that findings have, each with its citations once."""
    got = guidelines.catalogue(_fixture_findings(spark))
    return got.select("id", "section", "page_start", "page_end", F.transform("allowed_citations", lambda c: F.concat_ws("-", c["page_start"], c["page_end"])).alias("pages"))


@query(values([("SQL_INJECTION", "g-sql"), ("sql_injection ", "g-sql"), ("Weak_Hash", "g-hash")], ["VARCHAR", "VARCHAR"], ["asked", "id"]))
def guidelines_by_type(spark: SparkSession, d: str) -> DataFrame:
    book = _guides(spark)
    parts = [guidelines.by_detector(book, k).select(F.lit(k).alias("asked"), "id") for k in ("SQL_INJECTION", "sql_injection ", "Weak_Hash", "XSS")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(values([("a", ["g-sql"]), ("b", []), ("c", ["g-none"]), ("d", ["g-hash", "g-sql"])], ["VARCHAR", "VARCHAR[]"], ["id", "kept"]))
def references_refiltered(spark: SparkSession, d: str) -> DataFrame:
    """References of older results: those of the type or item in order of score, a single one that says neither, no bundles."""
    asked = dimension(spark, [("a", "SQL_INJECTION", "", "", ["g-none", "g-sql"]), ("b", "XSS", "", "입력데이터 검증 및 표현", ["g-none", "g-sql"]), ("c", "XSS", "", "", ["g-none"]), ("d", "WEAK_HASH", "SQL 삽입", "보안기능", ["g-sql", "g-none", "g-hash"])], "id string, type string, guide_item string, guide_category string, refs array<string>")
    book = _guides(spark).agg(F.collect_list(F.struct("id", "category", "item", "detector_types")).alias("book"))
    held = asked.crossJoin(F.broadcast(book)).withColumn("guideline_refs", F.transform("refs", lambda r: F.element_at(F.filter("book", lambda g: g["id"] == r), 1)))
    return guidelines.refiltered(held).select("id", F.transform("guideline_refs", lambda g: g["id"]).alias("kept"))


#: Pages of a guide: running heads, page numbers, two items.
PAGES = [
    (1, "제4장 구현단계 보안약점 진단\n1. 첫 항목\n\n가. 개요\n  input  is   joined\n\n\n\nhere\n1\n"),
    (2, "부록\n나. 보안대책\nbind it\f12\n다. 코드예제\nps.setString(1, x);\n"),
    (3, "가. 개요\nsecond item\n"),
    (4, "4\n"),
]
ITEMS = [("c", "one", 1), ("c", "two", 3), ("c", "three", 4)]


@query(values([("one", 1, 2, "input is joined\n\nhere", "bind it", "ps.setString(1, x);"), ("two", 3, 3, "second item", "", ""), ("three", 4, 9, "", "", "")], ["VARCHAR", "INTEGER", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR"], ["item", "page_start", "page_end", "overview", "security_measures", "code_examples"]).replace("\n", "' || chr(10) || '"))
def guideline_sections(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark).select("item", "page_start", "page_end", "overview", "security_measures", "code_examples")


def _converted(spark: SparkSession) -> DataFrame:
    items = dimension(spark, [(n, *x) for n, x in enumerate(ITEMS, 1)], "item_no int, category string, item string, page_start int")
    return guidelines.converted(dimension(spark, PAGES, "page int, text string"), items, 9)


@query(values([(3, 1, 1, 2)], ["BIGINT"] * 4, ["reference_count", "empty_text", "missing_overview", "missing_security_measures"]))
def guideline_quality(spark: SparkSession, d: str) -> DataFrame:
    return guidelines.quality(_converted(spark))


_ITEM = {t: i for t, _, i in R.GUIDE_ITEMS}
_CWE = {t: c for t, c, _, _ in R.DETECTORS}
_TITLE = {
    "VULN-001": "command injection in run through exec", "VULN-002": "SQL injection in byName through executeQuery", "VULN-003": "SQL injection in sorted through text substitution `${by}`", "VULN-004": "path traversal in picture", "VULN-005": "unchecked upload in store",
    "VULN-006": "cross-site scripting in greet through getWriter", "VULN-007": "hard-coded secret storePassword", "VULN-008": "weak hash in sum", "VULN-009": "weak hash in keep", "VULN-010": "predictable random numbers in newToken",
}
_REFS = {"SQL_INJECTION": ["g-sql"], "WEAK_HASH": ["g-hash"]}
ENRICHED = [(i, t, _ITEM[t], _CWE[t], f, n, m, _TITLE[i], _REFS.get(t, []), "matched" if t in _REFS else "missing", "confirmed" if t in _REFS else "needs_review", 1, 34) for i, t, f, n, m, _ in fixtures.EXPECTED]


@query(values(ENRICHED, ["VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR[]", "VARCHAR", "VARCHAR", "INTEGER", "INTEGER"], ["id", "type", "guide_item", "cwe", "file", "line", "function", "title", "refs", "grounding", "status", "duplicate_count", "n_fields"]))
def enriched_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the whole schema: metadata, guidelines, titles."""
    full = _fixture_findings(spark)
    return full.select("id", "type", "guide_item", "cwe", "file", "line", "function", F.col("finding_report_title").alias("title"), F.transform("guideline_refs", lambda g: g["id"]).alias("refs"), F.col("guideline_grounding_status").alias("grounding"), F.col("analysis_status").alias("status"), "duplicate_count", F.lit(len(full.columns)).alias("n_fields"))


@query(values([("VULN-001", "https://github.com/org/shop/blob/main/shop/Tools.java#L5-L11", ["function", "data", "sink"], [6, None, 4]), ("VULN-002", "https://github.com/org/shop/blob/main/shop/Catalog.java#L5-L11", ["function", "data", "data", "sink"], [7, None, 8, 9]), ("VULN-007", "https://github.com/org/shop/blob/main/shop/Catalog.java#L3-L4", ["data", "data", "data", "sink"], [24, 25, None, 4])], ["VARCHAR", "VARCHAR", "VARCHAR[]", "INTEGER[]"], ["id", "link", "kinds", "lines"]))
def chain_details(spark: SparkSession, d: str) -> DataFrame:
    """Places and kinds of a chain's steps, and where the source shows them."""
    full = _fixture_findings(spark, link=True).filter("id IN ('VULN-001', 'VULN-002', 'VULN-007')")
    return full.select("id", F.col("source_link").alias("link"), F.transform("call_chain_details", lambda x: x["kind"]).alias("kinds"), F.transform("call_chain_details", lambda x: x["line"]).alias("lines"))


@query(values([("VULN-004", "picture lets input name a file."), ("VULN-008", "sum relies on a weak hash."), ("VULN-001", "run lets input into a command that exec runs or writes.")], ["VARCHAR", "VARCHAR"], ["id", "description"]))
def contextual_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return _fixture_findings(spark).filter("id IN ('VULN-001', 'VULN-004', 'VULN-008')").select("id", "description")


@query(values([("a", ["file", "confidence"])], ["VARCHAR", "VARCHAR[]"], ["id", "missing"]))
def invalid_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that lack required fields."""
    full = _fixture_findings(spark)
    one = full.filter("id = 'VULN-001'").withColumns({"id": F.lit("a"), "file": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string")})
    return enrich.invalid(full.unionByName(one))


@query(values([("VULN-002", "generated", None), ("VULN-003", "failed", "unknown guideline g-x; other line 9"), ("VULN-004", "skipped", "no guideline attached"), ("VULN-008", "skipped_context_budget_exceeded", "input over the budget by 12"), ("VULN-009", "failed", "no answer")], ["VARCHAR"] * 3, ["id", "state", "error"]))
def explanation_states(spark: SparkSession, d: str) -> DataFrame:
    cites = "array<struct<source:string,version:string,page_start:int,page_end:int,section:string>>"
    said = [("VULN-002", "`sql` in line 8 of Catalog.java", ["g-sql"], [("Guide", "2019.6", 178, 191, "SQL")], None, None), ("VULN-003", "see line 9", ["g-x"], [], None, None), ("VULN-008", None, [], [], 12, None), ("VULN-009", None, [], [], None, "no answer")]
    answers = dimension(spark, said, f"id string, text string, cited_ids array<string>, citations {cites}, size int, error string")
    return enrich.explained(_fixture_findings(spark), answers).filter("id IN ('VULN-002', 'VULN-003', 'VULN-004', 'VULN-008', 'VULN-009')").select("id", F.col("llm_explanation_status").alias("state"), F.col("llm_explanation_error").alias("error"))


@query(values([("VULN-001", True, 3, 1, 1), ("VULN-002", True, 4, 1, 1)], ["VARCHAR", "BOOLEAN", "INTEGER", "INTEGER", "INTEGER"], ["id", "has_chain", "n_steps", "n_removed", "n_added_fences"]))
def finding_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The report of a finding that no service wrote: its chain, and a change as a diff."""
    told = report.markdown(_fixture_findings(spark).filter("id IN ('VULN-001', 'VULN-002')"))
    count = lambda p: F.size(F.regexp_extract_all("markdown", F.lit(p), F.lit(0)))
    return told.select("id", F.col("markdown").contains("## Flow").alias("has_chain"), count(r"(?m)^- `[^`]+.*` — `").alias("n_steps"), count(r"(?m)^- {6,}").alias("n_removed"), count(r"(?m)^```diff$").alias("n_added_fences"))


@query(values([(t, c, s) for t, c, s, _ in R.DETECTORS], ["VARCHAR"] * 3, ["type", "cwe", "confidence"]))
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """What the analysis can find."""
    return enrich.metadata(spark).select("type", "cwe", "confidence")


@query(values([("VULN-001", "0"), ("VULN-010", "9")], ["VARCHAR", "VARCHAR"], ["id", "place"]))
def audit_run(spark: SparkSession, d: str) -> DataFrame:
    """Analysis and report as one run of two steps; first and last finding."""
    run = report.audit(spark, lambda s: _fixture_findings(s))
    return run.filter("id IN ('VULN-001', 'VULN-010')").select("id", "place")


def _zipped(names: list[tuple[str, bytes]], link: bool = False) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in names:
            info = zipfile.ZipInfo(name)
            info.external_attr = (0o120777 if link and name.endswith("L.java") else 0o100644) << 16
            z.writestr(info, data)
    return bytearray(out.getvalue())


#: (archive, what is wrong with it or where its sources begin)
ARCHIVES = [
    ("whole", [("top/src/A.java", b"class A {}"), ("top/m.xml", b"<mapper/>")], False, "top/"),
    ("flat", [("A.java", b"class A {}"), ("b/B.java", b"class B {}")], False, ""),
    ("up", [("../A.java", b"x")], False, "leaves the archive"),
    ("absolute", [("/A.java", b"x")], False, "leaves the archive"),
    ("link", [("L.java", b"/etc/passwd")], True, "is a link"),
    ("none", [("readme.txt", b"x")], False, "no Java files"),
    ("large", [("A.java", b"x" * (archive.MAX_JAVA_BYTES + 1))], False, "a Java file has more than"),
]


@query(values([(n, w) for n, _, _, w in ARCHIVES] + [("broken", "not a zip archive")], ["VARCHAR", "VARCHAR"], ["name", "verdict"]))
def archive_guards(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, _zipped(files, link)) for n, files, link, _ in ARCHIVES] + [("broken", bytearray(b"PK no"))]
    told = archive.inspected(dimension(spark, rows, "path string, content binary")).withColumnRenamed("path", "name")
    known = F.array(*(F.lit(w) for w in ("leaves the archive", "is a link", "no Java files", "a Java file has more than", "not a zip archive")))
    short = F.coalesce(F.get(F.filter(known, lambda w: F.col("error").contains(w)), F.lit(0)), F.col("error"), F.col("root"))
    return told.select("name", short.alias("verdict"))


@query(values([("A.java", None), ("dir/B.JAVA", None), ("C.txt", "not a Java file"), ("D.java", "more than 1048576 bytes"), ("", "no name")], ["VARCHAR", "VARCHAR"], ["name", "rejected"]))
def upload_guards(spark: SparkSession, d: str) -> DataFrame:
    """A single file that is handed in, and why it is turned down."""
    rows = dimension(spark, [("A.java", 10), ("dir/B.JAVA", 10), ("C.txt", 10), ("D.java", 1 << 20 | 1), ("", 1)], "name string, size bigint")
    return rows.select("name", archive.rejected(F.col("name"), F.col("size")).alias("rejected"))


@query(values([("src/A.java", "/work/src/A.java"), ("/work/b", "/work/b"), ("../etc", None), ("/etc/passwd", None), ("a/../../work2", None), (".", "/work")], ["VARCHAR", "VARCHAR"], ["asked", "target"]))
def contained_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets inside a workspace; what leads out of it has none."""
    asked = ["src/A.java", "/work/b", "../etc", "/etc/passwd", "a/../../work2", "."]
    return dimension(spark, [(a, archive.contained(a, "/work")) for a in asked], "asked string, target string")


@query(values([("src/A.java",), ("B.java",)], ["VARCHAR"], ["file"]))
def displayed_paths(spark: SparkSession, d: str) -> DataFrame:
    return archive.displayed(dimension(spark, [("file:/work/p/src/A.java",), ("/work/p/B.java",)], "file string"), "/work/p").select("file")


@query(values([("Catalog.java", 80), ("Page.java", 80), ("Tools.java", 100), ("items.xml", 90)], ["VARCHAR", "BIGINT"], ["name", "score"]))
def scores_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Scores by file name; of two files of one name the later path counts."""
    files = dimension(spark, [*fixtures.SOURCES.items(), ("shop/z/Tools.java", "class Tools { }")], SOURCE)
    return analysis.scores_by_name(analysis.prioritize(analysis.findings(files)), files)


@query(values([("g-sql", 178)], ["VARCHAR", "INTEGER"], ["id", "page_start"]))
def guideline_search(spark: SparkSession, d: str) -> DataFrame:
    return guidelines.search(_guides(spark), "sql", 1).select("id", "page_start")


@query(values([("src/A.java", 9, "java"), ("src/m.xml", 9, "mapper")], ["VARCHAR", "INTEGER", "VARCHAR"], ["file", "n_chars", "kind"]))
def java_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """Java files of a folder, and of its XML files the mappers; other files, and XML that isn't UTF-8, are left out."""
    root = scratch(spark, "sources")
    for name, data in (("src/A.java", b"class A{}"), ("src/m.xml", b"<mapper/>"), ("src/pom.xml", b"<project/>"), ("src/bad.xml", b"<mapper>\xff</mapper>"), ("src/readme.txt", b"<mapper/>")):
        put(spark, f"{root}/{name}", data)
    found = analysis.scan_sources(spark, root)
    name = F.regexp_extract("file", r"src/[^/]*$", 0)
    return found.select(name.alias("file"), F.char_length("content").alias("n_chars"), F.when(F.lower("file").endswith(".java"), "java").otherwise("mapper").alias("kind"))


@query(values([("one.zip", "src/A.java", "class A {}"), ("one.zip", "m.xml", "<mapper/>"), ("two.zip", "B.java", "class B {}")], ["VARCHAR"] * 3, ["archive", "file", "content"]))
def archive_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources in archives, named from the one top folder where there is one."""
    root = scratch(spark, "archives")
    put(spark, f"{root}/one.zip", bytes(_zipped([("top/src/A.java", b"class A {}"), ("top/m.xml", b"<mapper/>"), ("top/x.xml", b"<x/>")])))
    put(spark, f"{root}/two.zip", bytes(_zipped([("B.java", b"class B {}")])))
    found = archive.read_archives(spark, root)
    return found.select(F.regexp_extract("repo", r"[^/]*$", 0).alias("archive"), "file", "content")
