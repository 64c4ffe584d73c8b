"""Guideline references: scored join, catalogue, search, checks of explanations against what was attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def score(kind: Column, item: Column, category: Column, g: Column) -> Column:
    """100 for the type, 30 for the item, 5 for the category but only on top of one of those."""
    base = F.when(F.array_contains(F.transform(g["detector_types"], _key), _key(kind)), 100).otherwise(0) + F.when(_key(item) == _key(g["item"]), 30).otherwise(0)
    return F.when(base > 0, base + F.when(_key(category) == _key(g["category"]), 5).otherwise(0)).otherwise(0)


def attach(findings: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Findings with guideline_refs in order of score, page and id, and whether there are any.

    Guidelines are a catalogue of some tens of entries: it travels as one array, and no pairs of rows are made.
    """
    catalogue = guidelines.agg(F.collect_list(F.struct(*guidelines.columns)).alias("_all"))
    scored = F.transform("_all", lambda g: F.struct((-score(F.col("type"), F.col("guide_item"), F.col("guide_category"), g)).alias("s"), g["page_start"].alias("page_start"), g["id"].alias("id"), g.alias("ref")))
    refs = F.transform(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), lambda x: x["ref"])
    out = findings.crossJoin(F.broadcast(catalogue)).withColumn("guideline_refs", refs).drop("_all")
    some = F.size("guideline_refs") > 0
    return out.withColumn("guideline_grounding_status", F.when(some, "matched").otherwise("missing")).withColumn("analysis_status", F.when(some, "confirmed").otherwise("needs_review"))


def by_detector(guidelines: DataFrame, kind: str) -> DataFrame:
    return guidelines.filter(F.array_contains(F.transform("detector_types", _key), kind.strip().lower()))


def search(guidelines: DataFrame, term: str, limit: int) -> DataFrame:
    """Entries whose id, item, category, types or aliases have a term, in order of page and id."""
    some = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    texts = [F.col(c) for c in ("id", "item", "category")] + [some(c) for c in ("detector_types", "aliases") if c in guidelines.columns]
    return guidelines.filter(F.lower(F.concat_ws(" ", *texts)).contains(term.lower())).orderBy("page_start", "id").limit(max(0, limit))


def page_ends(guidelines: DataFrame, last: int) -> DataFrame:
    from pyspark.sql import Window

    return guidelines.withColumn("page_end", F.lead("page_start", 1, last + 1).over(Window.orderBy("page_start", "id")) - 1)


def refiltered(findings: DataFrame) -> DataFrame:
    """Of the references that a finding has, those of its type or item, best first and else in their order. A single one that
    says neither is kept, as older results have it; several of which none fits are dropped."""
    refs = F.col("guideline_refs")
    scored = F.transform(refs, lambda g, i: F.struct((-score(F.col("type"), F.col("guide_item"), F.col("guide_category"), g)).alias("s"), i.alias("i"), g.alias("ref")))
    fitting = F.filter(scored, lambda x: x["s"] < 0)
    best = F.transform(F.array_sort(F.transform(fitting, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i")))), lambda x: F.get(refs, x["i"]))
    return findings.withColumn("guideline_refs", F.when(F.size(fitting) > 0, best).when(F.size(refs) == 1, refs).otherwise(F.filter(refs, lambda x: F.lit(False))))


def catalogue(findings: DataFrame) -> DataFrame:
    """One row for each reference that findings have: its section, pages, and all citations of it, each once."""
    every = findings.select(F.explode("guideline_refs").alias("r")).select("r.*")
    section = F.concat_ws(" - ", "category", "item")
    return every.groupBy("id").agg(F.min(section).alias("section"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("citations")))).alias("allowed_citations"))


def from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """References from the text of a catalogue file: nested entries flattened, what is absent empty, pages 0."""
    cite = "struct<source:string,version:string,page_start:int,page_end:int,section:string>"
    entry = f"struct<id:string,source:struct<title:string,version:string,source_file:string>,scope:struct<category:string,item:string,page_start:int,page_end:int>,mapping:struct<detector_types:array<string>,aliases:array<string>>,content:struct<overview:string,security_measures:string,diagnosis:string,code_examples:string,references:string>,citations:array<{cite}>>"
    raw = texts.select(F.explode(F.from_json(column, f"struct<references:array<{entry}>>")["references"]).alias("r"))
    text = lambda path, name: F.coalesce(F.col(f"r.{path}"), F.lit("")).alias(name)
    listed = lambda path, name: F.coalesce(F.col(f"r.{path}"), F.array().cast("array<string>")).alias(name)
    page = lambda name: F.coalesce(F.col(f"r.scope.{name}"), F.lit(0)).alias(name)
    return raw.select(
        text("id", "id"), text("source.title", "source_title"), text("source.version", "source_version"), text("source.source_file", "source_file"), text("scope.category", "category"), text("scope.item", "item"), page("page_start"), page("page_end"), listed("mapping.detector_types", "detector_types"), listed("mapping.aliases", "aliases"),
        *(text(f"content.{c}", c) for c in ("overview", "security_measures", "diagnosis", "code_examples", "references")), F.coalesce("r.citations", F.array().cast(f"array<{cite}>")).alias("citations"),
    )


def load(spark, path: str) -> DataFrame:
    """The catalogue file of a path."""
    return from_json(spark.read.text(path, wholetext=True))


# Lines that a page's head and foot bring, and the headings of an item's sections.
RUNNING_LINES = ("전자정부 SW개발보안 진단원을 위한 소프트웨어 보안약점 진단가이드", "제1장 개요", "제2장 소프트웨어 개발보안", "제3장 분석·설계단계 보안항목 진단", "제4장 구현단계 보안약점 진단", "부록")
SECTIONS = [("가", "overview"), ("나", "security_measures"), ("다", "code_examples"), ("라", "diagnosis"), ("마", "references"), ("바", "extra")]
HEADING = r"^\s*([가-바])\.\s*(?:개요|보안대책|코드예제|진단방법|참고자료|기타)\s*$"


def cleaned(c: Column | str) -> Column:
    """A page range's text without running heads, page numbers and runs of blank lines."""
    lines = F.transform(F.split(F.replace(c, F.lit("\f"), F.lit("\n")), "\r\n|\r|\n", -1), lambda x: F.rtrim(x))
    kept = F.filter(lines, lambda x: ~F.trim(x).isin(*RUNNING_LINES) & ~F.trim(x).rlike(r"^\d{1,3}$"))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sections(c: Column | str) -> Column:
    """A map from section to its text: lines are dealt to the last heading before them in one fold."""
    letters = F.create_map(*(F.lit(x) for pair in SECTIONS for x in pair))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<k:string,v:string>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        head = F.regexp_extract(x, HEADING, 1)
        row = F.struct(acc["now"].alias("k"), x.alias("v"))
        opened = F.struct(letters[head].alias("k"), F.lit("").alias("v"))
        return F.when(head != "", F.struct(letters[head].alias("now"), F.array_append(acc["rows"], opened).alias("rows"))).when(acc["now"].isNull(), acc).otherwise(F.struct(acc["now"].alias("now"), F.array_append(acc["rows"], row).alias("rows")))

    rows = F.aggregate(F.split(c, "\n", -1), start, step, lambda acc: acc["rows"])
    names = F.array_distinct(F.transform(rows, lambda r: r["k"]))
    body = lambda name: F.array_join(F.transform(F.filter(rows, lambda r: r["k"] == name), lambda r: r["v"]), "\n")
    tidy = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.map_from_arrays(names, F.transform(names, lambda name: tidy(body(name))))


def converted(pages: DataFrame, items: DataFrame, last_page: int) -> DataFrame:
    """References from a guide's pages (page, text) and its items (item_no, category, item, page_start, detector_types)."""
    placed = page_ends(items.withColumn("id", F.lpad(F.col("item_no").cast("string"), 4, "0")), last_page).drop("id")
    found = placed.join(pages, F.col("page").between(F.col("page_start"), F.col("page_end")), "left")
    whole = found.groupBy(*placed.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    split = whole.withColumn("_text", cleaned("_text")).withColumn("_sections", sections("_text"))
    part = lambda name: F.coalesce(F.col("_sections")[name], F.lit("")).alias(name)
    return split.select(*placed.columns, *(part(n) for _, n in SECTIONS[:5]), (F.col("_text") == "").alias("empty"))


def quality(references: DataFrame) -> DataFrame:
    """How many references there are, and how many lack what."""
    return references.agg(F.count(F.lit(1)).alias("reference_count"), F.count_if("empty").alias("empty_text"), F.count_if(F.col("overview") == "").alias("missing_overview"), F.count_if(F.col("security_measures") == "").alias("missing_security_measures"))


def verify(explanations: DataFrame) -> DataFrame:
    """Notes on explanations that cite what wasn't attached or speak of other places.

    Columns text, cited_ids, ref_ids, file, lines and, where there are such, citations and allowed (structs of source,
    version, page_start, page_end, section). Files are told by path or name, lines as `line N` or as `N행`.
    """
    unknown = F.array_except("cited_ids", "ref_ids")
    spoken_files = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./\\-]+\.java"), F.lit(0)))
    name = lambda x: F.element_at(F.split(x, "/"), -1)
    files = F.filter(spoken_files, lambda x: ~((x == F.col("file")) | (name(x) == name(F.col("file")))))
    numbers = F.concat(F.regexp_extract_all("text", F.lit(r"(?i)line\s+(\d{1,5})"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(\d{1,5})\s*행"), F.lit(1)))
    spoken = F.array_except(F.transform(numbers, lambda x: x.cast("int")), "lines")
    cited = F.array_except("citations", "allowed") if "citations" in explanations.columns else F.array()
    told = lambda label, xs: F.transform(xs, lambda x: F.concat(F.lit(label), x.cast("string")))
    checked = explanations.withColumns({"unknown_ids": unknown, "unknown_files": files, "unknown_lines": spoken, "unknown_citations": F.size(cited)})
    notes = F.concat(told("unknown guideline ", F.col("unknown_ids")), told("other file ", F.col("unknown_files")), told("other line ", F.col("unknown_lines")), F.when(F.col("unknown_citations") > 0, F.array(F.lit("citation that isn't attached"))).otherwise(F.array().cast("array<string>")))
    return checked.withColumn("notes", notes).withColumn("grounded", F.size("notes") == 0)
