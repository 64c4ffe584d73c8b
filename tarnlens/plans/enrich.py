"""Findings as they are stored and shown: the schema of 34 fields, filled from the rule tables, guidelines and source places."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlens.functions import rules as R
from tarnlens.functions import text as T
from tarnlens.operators import guidelines
from tarnlens.sources.tables import dimension

CITATION = "struct<source:string,version:string,page_start:int,page_end:int,section:string>"
REFERENCE = f"struct<id:string,source_title:string,source_version:string,source_file:string,category:string,item:string,page_start:int,page_end:int,detector_types:array<string>,overview:string,security_measures:string,diagnosis:string,citations:array<{CITATION}>>"
DETAIL = "struct<label:string,kind:string,file:string,line:int,function:string,source_url:string,source_ref:string,source_link:string>"
EXPLANATION = "struct<why_vulnerable:string,how_to_fix:string,fix_steps:array<string>,grounding_notes:string>"
REPORT = "struct<status:string,title:string,summary:string,markdown:string,proposed_patch:string,error:string>"
#: Name and type of each field, in order.
FIELDS = [
    ("id", "string"), ("type", "string"), ("guide_source", "string"), ("guide_category", "string"), ("guide_item", "string"), ("cwe", "string"),
    ("file", "string"), ("line", "int"), ("function", "string"), ("source_url", "string"), ("source_ref", "string"), ("source_link", "string"),
    ("code_snippet", "string"), ("call_chain", "array<string>"), ("call_chain_details", f"array<{DETAIL}>"), ("evidence", "string"), ("description", "string"),
    ("recommendation", "string"), ("safe_example", "string"), ("confidence", "string"), ("confidence_reason", "string"), ("guideline_refs", f"array<{REFERENCE}>"),
    ("guideline_grounding_status", "string"), ("analysis_status", "string"), ("llm_explanation_status", "string"), ("llm_explanation", EXPLANATION),
    ("llm_explanation_error", "string"), ("finding_report_status", "string"), ("finding_report_title", "string"), ("finding_report_summary", "string"),
    ("finding_report_markdown_preview", "string"), ("finding_report", REPORT), ("duplicate_count", "int"), ("related_finding_ids", "array<string>"),
]
REQUIRED = ("id", "type", "guide_source", "guide_category", "guide_item", "file", "description", "recommendation", "safe_example", "confidence")


def metadata(spark) -> DataFrame:
    """One row for each type: its place in the guide, its weakness, advice, the confidence that its findings have."""
    places = {t: (c, i) for t, c, i in R.GUIDE_ITEMS}
    advice = {t: rest for t, *rest in R.ADVICE}
    rows = [(t, R.GUIDE_SOURCE, *places[t], cwe, *advice[t][:3], sure, advice[t][3]) for t, cwe, sure, _ in R.DETECTORS]
    return dimension(spark, rows, "type string, guide_source string, guide_category string, guide_item string, cwe string, description string, recommendation string, safe_example string, confidence string, confidence_reason string")


def with_metadata(found: DataFrame) -> DataFrame:
    """Fill what a finding doesn't say of its type. An empty description or evidence counts as unsaid; of the others only null."""
    dim = metadata(found.sparkSession)
    names = [c for c in dim.columns if c != "type"]
    joined = found.join(F.broadcast(dim.withColumnsRenamed({c: f"_{c}" for c in names})), "type", "left")
    said = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    filled = {c: F.coalesce(F.nullif(said(c), F.lit("")) if c == "description" else said(c), F.col(f"_{c}")) for c in names}
    filled["evidence"] = F.coalesce(F.nullif(said("evidence"), F.lit("")), F.concat(F.col("_guide_item"), F.lit(": a rule of this item matched.")))
    return joined.withColumns(filled).drop(*(f"_{c}" for c in names))


def location(file: Column, line: Column) -> Column:
    return F.when(line.isNotNull(), F.concat(T.basename(file), F.lit(":"), line.cast("string"))).otherwise(T.basename(file))


def secret_name(evidence: Column, snippet: Column) -> Column:
    """The variable that the evidence names in backticks, or that the source shows as a secret."""
    named = F.regexp_extract(evidence, r"`([A-Za-z_$][\w$]{2,})`", 1)
    shown = F.regexp_extract(snippet, r"(?i)\b(?:String|char\[\]|byte\[\]|var)\s+([A-Za-z_$][\w$]*(?:password|passwd|secret|token|key)[\w$]*)\s*=", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(shown, F.lit("")))


_TITLES = {
    "SQL_INJECTION": "SQL injection", "XSS": "cross-site scripting", "COMMAND_INJECTION": "command injection", "PATH_TRAVERSAL": "path traversal",
    "HARDCODED_SECRET": "hard-coded secret", "DANGEROUS_FILE_UPLOAD": "unchecked upload", "INSECURE_RANDOM": "predictable random numbers", "WEAK_HASH": "weak hash",
}
#: Types whose title names the sink too.
_WITH_SINK = ("SQL_INJECTION", "XSS", "COMMAND_INJECTION")


def short_title() -> Column:
    """A title from type, function, sink and place: columns type, function, call_chain, file, line, evidence, code_snippet."""
    kind = F.create_map(*(F.lit(x) for pair in _TITLES.items() for x in pair))[F.col("type")]
    what = F.coalesce(kind, T.first_filled(F.element_at(F.split("guide_item", "/"), 1)), T.titled("type"))
    own = F.element_at(F.split(F.trim("function"), r"\."), -1)
    sink = T.chain_sink("call_chain", "function")
    secret = F.when(F.col("type") == "HARDCODED_SECRET", secret_name(F.col("evidence"), F.col("code_snippet")))
    through = F.when((F.col("type").isin(*_WITH_SINK) | kind.isNull()) & (sink != ""), F.concat(F.lit(" through "), sink)).otherwise("")
    place = F.coalesce(F.nullif(own, F.lit("")), location(F.col("file"), F.col("line")))
    return F.when(secret.isNotNull(), F.concat(what, F.lit(" "), secret)).when(F.coalesce(own, F.lit("")) != "", F.concat(what, F.lit(" in "), own, through)).otherwise(F.concat(what, F.lit(" in "), place))


def contextual_description() -> Column:
    """What the finding means here, in place of a description that is empty or only the type's own; else as it is."""
    own = F.create_map(*(F.lit(x) for t, about, *_ in R.ADVICE for x in (t, about)))[F.col("type")]
    said = T.collapse(F.coalesce("description", F.lit("")))
    place = F.coalesce(F.nullif(F.element_at(F.split(F.trim("function"), r"\."), -1), F.lit("")), location(F.col("file"), F.col("line")))
    sink = T.chain_sink("call_chain", "function")
    texts = {
        "SQL_INJECTION": " lets input into SQL", "XSS": " lets input into a page", "COMMAND_INJECTION": " lets input into a command", "PATH_TRAVERSAL": " lets input name a file",
        "DANGEROUS_FILE_UPLOAD": " stores an upload without enough checks", "INSECURE_RANDOM": " makes values that can be guessed", "WEAK_HASH": " relies on a weak hash", "HARDCODED_SECRET": " holds a secret in the source",
    }
    about = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))[F.col("type")]
    through = F.when(F.col("type").isin(*_WITH_SINK) & F.col("function").isNotNull() & (sink != ""), F.concat(F.lit(" that "), sink, F.lit(" runs or writes"))).otherwise("")
    made = F.coalesce(F.concat(place, about, through, F.lit(".")), F.nullif(T.truncated(T.collapse("evidence"), 137), F.lit("")), F.concat(place, F.lit(" needs a review.")))
    return F.when((said == "") | (said == T.collapse(own)), made).otherwise(F.col("description"))


def short_summary() -> Column:
    first = T.first_filled(*(T.collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("`"), F.lit(""))) for c in ("evidence", "description", "recommendation", "confidence_reason")))
    return F.coalesce(T.truncated(first, 137), F.lit("A rule matched."))


def with_details(found: DataFrame, source_url: str | None = None, source_ref: str | None = None) -> DataFrame:
    """Source links of findings and of their chains' steps; steps are (label, kind, line) and become call_chain_details."""
    url, ref = (F.lit(x).cast("string") for x in (source_url, source_ref))
    linked = bool(source_url and source_ref and source_url.startswith("https://github.com/"))
    first, last = T.snippet_lines("snippet")
    holds = first.isNotNull() & F.col("line").between(first, last) & (first != last)
    none = F.lit(None).cast("string")
    link = F.when(F.col("line") > 0, T.source_link(url, ref, F.col("file"), F.when(holds, first).otherwise(F.col("line")), F.when(holds, last))) if linked else none
    step = lambda s: F.struct(s["label"].alias("label"), s["kind"].alias("kind"), F.col("file").alias("file"), s["line"].alias("line"), F.col("function").alias("function"), url.alias("source_url"), ref.alias("source_ref"), (F.when(s["line"] > 0, T.source_link(url, ref, F.col("file"), s["line"])) if linked else none).alias("source_link"))
    return found.withColumns({"source_url": url, "source_ref": ref, "source_link": link, "call_chain_details": F.transform("steps", step)})


def enriched(found: DataFrame, guides: DataFrame, source_url: str | None = None, source_ref: str | None = None) -> DataFrame:
    """Prioritised findings in the schema of FIELDS, with guidelines attached and titles made; reports come later."""
    full = guidelines.attach(with_metadata(with_details(found, source_url, source_ref)).withColumnRenamed("snippet", "code_snippet"), guides)
    full = full.withColumn("description", contextual_description()).withColumns({"finding_report_title": short_title(), "finding_report_summary": short_summary()})
    related = F.when(F.col("duplicate_count") > 1, F.transform(F.sequence(F.lit(2), F.col("duplicate_count")), lambda i: F.concat(F.col("id"), F.lit("/"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    names = re.findall(r"(?:^|,)(\w+):", re.sub(r"array<struct<[^>]*>>|array<\w+>", "x", REFERENCE[len("struct<") : -1]))
    full = full.withColumn("guideline_refs", F.transform("guideline_refs", lambda g: F.struct(*(g[n].alias(n) for n in names))))
    constants = {"llm_explanation_status": F.lit("unavailable"), "finding_report_status": F.lit("unavailable"), "finding_report_markdown_preview": F.lit(""), "related_finding_ids": related}
    full = full.withColumns(constants)
    return full.select(*((F.col(c) if c in full.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS))


def invalid(found: DataFrame) -> DataFrame:
    """(id, missing) of findings that lack a required field."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    return found.select("id", missing.alias("missing")).filter(F.size("missing") > 0)


def explained(found: DataFrame, explanations: DataFrame, most: int = 20) -> DataFrame:
    """Findings with the state of their explanation.

    explanations has (id, text, cited_ids, citations, size, error): what a service returned, or that its input was too
    large, or that it failed. Of the first `most` findings, those that have no state yet get one: skipped without
    guidelines, skipped over the budget, failed on an error or where the text cites what wasn't attached, else generated.
    """
    own = found.drop("llm_explanation_status", "llm_explanation_error", "llm_explanation")
    before = found.select("id", F.coalesce(F.nullif("llm_explanation_status", F.lit("")), F.lit("unavailable")).alias("_before"))
    place = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    checked = guidelines.verify(explanations.join(found.select("id", "file", F.array("line").alias("lines"), F.transform("guideline_refs", lambda r: r["id"]).alias("ref_ids"), F.flatten(F.transform("guideline_refs", lambda r: r["citations"])).alias("allowed")), "id"))
    told = checked.select("id", "text", "size", "error", "grounded", "notes")
    joined = own.join(before, "id").join(told, "id", "left")
    none = F.size("guideline_refs") == 0
    state = (
        F.when((F.col("_before") != "unavailable") | (place > most), F.col("_before"))
        .when(none, "skipped").when(F.col("text").isNull() & F.col("error").isNull() & F.col("size").isNull(), "unavailable")
        .when(F.col("size") > 0, "skipped_context_budget_exceeded").when(F.col("error").isNotNull() | ~F.col("grounded"), "failed").otherwise("generated")
    )
    why = F.when(F.col("llm_explanation_status") == "skipped", "no guideline attached").when(F.col("llm_explanation_status") == "skipped_context_budget_exceeded", F.concat(F.lit("input over the budget by "), F.col("size").cast("string"))).when(F.col("llm_explanation_status") == "failed", F.coalesce("error", F.array_join("notes", "; ")))
    text = F.when(F.col("llm_explanation_status") == "generated", F.col("text"))
    return joined.withColumn("llm_explanation_status", state).withColumn("llm_explanation_error", why).withColumn("llm_explanation_text", text).drop("_before", "text", "size", "error", "grounded", "notes")
