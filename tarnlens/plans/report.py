"""Report tables and Markdown of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlens.functions import rules as R
from tarnlens.functions import text as T
from tarnlens.operators import merge
from tarnlens.sources.tables import dimension


def overview(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: findings, impacted files, overall score."""
    counted = findings.agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(F.coalesce("file", F.lit(""))).alias("impacted_files"))
    return counted.crossJoin(scores.agg(merge.overall("score").alias("overall")))


def by_type(findings: DataFrame) -> DataFrame:
    """Counts of the eight types; others aren't counted here."""
    return merge.counts_zero_filled(findings, dimension(findings.sparkSession, [(t,) for t, *_ in R.DETECTORS], "type string"), "type")


def distribution(findings: DataFrame, key: str) -> DataFrame:
    return findings.groupBy(key).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def file_table(findings: DataFrame, shown: int = 4) -> DataFrame:
    """(file, n, lines): the first lines and how many more there are."""
    grouped = findings.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("ls"))
    more = F.when(F.size("ls") > shown, F.concat(F.lit(" +"), (F.size("ls") - shown).cast("string"))).otherwise("")
    return grouped.select("file", "n", F.concat(F.array_join(F.transform(F.slice("ls", 1, shown), lambda x: x.cast("string")), ", "), more).alias("lines"))


def compact(findings: DataFrame, preview: int = 220) -> DataFrame:
    """Findings as lists show them: of a report only its status, title, summary and the begin of its text."""
    text = F.trim(F.coalesce(F.col("finding_report.markdown"), F.lit("")))
    out = findings.withColumn("finding_report_markdown_preview", F.when(text != "", T.truncated(text, preview)).otherwise(F.col("finding_report_markdown_preview")))
    return out.withColumn("finding_report_status", F.coalesce("finding_report.status", "finding_report_status")).drop("finding_report")


def diff(snippet: Column | str, example: Column | str) -> Column:
    """A change as a diff: the marked line of a rendered snippet with one line around it goes, an example's lines come."""
    shown = F.split(snippet, "\n", -1)
    number = lambda x: F.regexp_extract(x, r"^\s*>?\s*(\d+)\s*\|", 1).cast("int")
    body = lambda x: F.rtrim(F.regexp_extract(x, r"^\s*>?\s*\d+\s*\|\s?(.*)$", 1))
    marked = F.array_position(F.transform(shown, lambda x: F.ltrim(x).startswith(">")), True).cast("int")
    first = F.greatest(F.lit(1), marked - 1)
    some = F.slice(shown, first, F.least(F.lit(3), marked + 2 - first))
    added = F.transform(F.slice(F.filter(F.split(F.trim(example), "\n", -1), lambda x: F.trim(x) != ""), 1, 12), lambda x: F.concat(F.lit("+ "), F.rtrim(x)))
    lines = F.flatten(F.transform(some, lambda x: F.when(F.ltrim(x).startswith(">"), F.concat(F.array(F.concat(F.lit("- "), body(x))), added)).otherwise(F.array(F.concat(F.lit("  "), body(x))))))
    start = number(F.element_at(some, 1)).cast("string")
    head = F.concat(F.lit("@@ -"), start, F.lit(","), F.size(some).cast("string"), F.lit(" +"), start, F.lit(","), (F.size(some) - 1 + F.size(added)).cast("string"), F.lit(" @@"))
    whole = F.concat(F.array(F.lit("```diff"), F.lit("--- as it is"), F.lit("+++ as it could be"), head), lines, F.array(F.lit("```")))
    return F.when((marked > 0) & (F.size(added) > 0), F.array_join(whole, "\n")).otherwise(F.lit("The change needs the whole file; see above what to do."))


def markdown(findings: DataFrame) -> DataFrame:
    """(id, markdown) of enriched findings, without any service: code, reason, flow, guide, what to do and a change."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    fn = F.coalesce("function", F.lit("no function"))
    link = F.coalesce(F.concat(F.lit("\n\n[Source]("), "source_link", F.lit(")")), F.lit(""))
    step = lambda x: F.concat(F.lit("- `"), x["label"], F.lit("` — `"), F.concat_ws(":", x["file"], x["line"].cast("string")), F.lit("`"), F.coalesce(F.concat(F.lit(" ("), x["function"], F.lit(")")), F.lit("")))
    steps = F.array_join(F.transform(F.slice("call_chain_details", 1, 8), step), "\n")
    cited = F.flatten(F.transform("guideline_refs", lambda g: g["citations"]))
    cites = F.array_join(F.transform(cited, lambda c: F.concat(F.lit("- "), F.concat_ws(" ", c["source"], c["version"]), F.lit(" p."), F.concat_ws("-", c["page_start"].cast("string"), c["page_end"].cast("string")), F.lit(" ("), c["section"], F.lit(")"))), "\n")
    section = lambda name, body: F.concat(F.lit(f"\n\n## {name}\n"), body)
    text = F.concat(
        F.lit("## Code\n`"), place, F.lit("`, `"), fn, F.lit("`: "), F.col("finding_report_title"), F.lit(". "), F.col("finding_report_summary"), link, F.lit("\n\n```java\n"), F.col("code_snippet"), F.lit("\n```"),
        section("Why", F.col("evidence")), section("Flow", steps), section("Guide", F.when(F.size(cited) > 0, cites).otherwise("- none attached")),
        section("What it means", F.concat("description", F.lit("\n\n"), "confidence_reason")), section("What to do", F.col("recommendation")), section("Proposed patch", diff("code_snippet", "safe_example")),
    )
    return findings.select("id", T.sanitized_markdown(text, r"(?i)code_snippet|call_chain|guideline_refs").alias("markdown"))


def with_reports(findings: DataFrame) -> DataFrame:
    """Enriched findings with the report that is written without any service, where they have none yet."""
    made = markdown(findings)
    joined = findings.join(made.withColumnRenamed("markdown", "_text"), "id")
    own = F.struct(F.lit("static_fallback").alias("status"), F.col("finding_report_title").alias("title"), F.col("finding_report_summary").alias("summary"), F.col("_text").alias("markdown"), T.proposed_patch("_text").alias("proposed_patch"), F.lit("no service wrote a report").alias("error"))
    kept = F.coalesce("finding_report", own)
    return joined.withColumn("finding_report", kept).withColumn("finding_report_status", F.col("finding_report.status")).drop("_text").select(*findings.columns)


def audit(spark, analyse) -> DataFrame:
    """Analysis and report as one run: findings in order of risk with their reports, and their place from 0."""
    found = with_reports(analyse(spark))
    return found.withColumn("place", (F.regexp_extract("id", r"(\d+)$", 1).cast("int") - 1).cast("string"))


def within_budget(df: DataFrame, column: str, budget: int, compacted: Column) -> DataFrame:
    """A payload, or its compacted form where it is over the budget, or null where that is, too; and which it was."""
    full = F.char_length(column) <= budget
    short = F.char_length(compacted) <= budget
    return df.withColumn("payload", F.when(full, F.col(column)).when(short, compacted)).withColumn("payload_status", F.when(full, "full").when(short, "compacted").otherwise("skipped_context_budget_exceeded"))


def file_detail(findings: DataFrame, file: str) -> DataFrame:
    """Findings of a file by its whole path or, where there is none of that path, by its name."""
    named = findings.withColumn("_same", F.col("file") == file).filter(F.col("_same") | (T.basename("file") == file.split("/")[-1]))
    some = named.agg(F.coalesce(F.max("_same"), F.lit(False)).alias("_some"))
    return named.crossJoin(F.broadcast(some)).filter("_same OR NOT _some").drop("_same", "_some")
