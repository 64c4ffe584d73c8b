"""Scalar functions of the analytics engine, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column | str) -> Column:
    """White space collapsed to single blanks, and none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stripped(c: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def truncated(c: Column | str, n: int) -> Column:
    """At most n characters, then an ellipsis in place of trailing blanks; n <= 0 leaves the text as it is."""
    c = F.col(c) if isinstance(c, str) else c
    if n <= 0:
        return c
    return F.when(F.char_length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("…"))).otherwise(c)


def first_filled(*cs: Column | str) -> Column:
    """The first that isn't null, empty or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))


def url_quoted(c: Column | str, safe_slash: bool = False) -> Column:
    """Percent-encoding of all but unreserved characters; form encoding differs in blanks, tildes and asterisks."""
    c = F.url_encode(c)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), *((("%2F", "/"),) if safe_slash else ())):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def source_link(base: Column | str, ref: Column | str, path: Column | str, first: Column | str | None = None, last: Column | str | None = None) -> Column:
    """base/blob/ref/path#Lx(-Ly); null where base, ref or path is missing."""
    c = F.concat(F.rtrim(F.col(base) if isinstance(base, str) else base, F.lit("/")), F.lit("/blob/"), url_quoted(ref), F.lit("/"), url_quoted(path, safe_slash=True))
    if first is None:
        return c
    first = F.col(first) if isinstance(first, str) else first
    c = F.when(first.isNull(), c).otherwise(F.concat(c, F.lit("#L"), first.cast("string")))
    if last is None:
        return c
    last = F.col(last) if isinstance(last, str) else last
    return F.when(last > first, F.concat(c, F.lit("-L"), last.cast("string"))).otherwise(c)


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def last_parts(c: Column | str, depth: int) -> Column:
    """The last parts of a path; a path of fewer parts is given without empty ones."""
    parts = F.filter(F.split(c, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - depth + 1), F.lit(depth)), "/")


def same_key(a: Column | str, b: Column | str) -> Column:
    """Whether two names are the same but for case and blanks around them."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def safe_int(c: Column | str) -> Column:
    """A whole number; 0 for what isn't one and for null."""
    return F.coalesce(F.expr(f"try_cast(`{c}` AS INT)") if isinstance(c, str) else c.try_cast("int"), F.lit(0))


def safe_filename(c: Column | str) -> Column:
    """Letters, digits and -_. stay, all else becomes a hyphen; 'analysis' where nothing is left."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^-+|-+$", ""), F.lit("")), F.lit("analysis"))


def report_name(repository: Column | str, analysis_id: Column | str) -> Column:
    return F.concat(F.lit("report-"), safe_filename(repository), F.lit("-"), F.substring(analysis_id, 1, 8), F.lit(".pdf"))


def slug(c: Column | str, number: Column | str) -> Column:
    """Runs of other characters than letters and digits of Latin and Hangul become hyphens; item-<number> where nothing is left."""
    made = F.lower(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z\uAC00-\uD7A3]+", "-"), "^-+|-+$", ""))
    number = F.col(number) if isinstance(number, str) else number
    return F.coalesce(F.nullif(made, F.lit("")), F.concat(F.lit("item-"), number.cast("string")))


def bare_type(c: Column | str) -> Column:
    """A type without its arguments and brackets."""
    return F.trim(F.regexp_extract(c, r"^[^<\[]*", 0))


def without_this(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^this\.", "")


def fenced_json(c: Column | str) -> Column:
    """What stands in the first fence, or the whole text."""
    c = F.col(c) if isinstance(c, str) else c
    inside = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return stripped(F.when(c.rlike(r"(?is)```(?:json)?\s*.*?```"), inside).otherwise(c))


def proposed_patch(c: Column | str) -> Column:
    """The body of a Markdown text's section that proposes a change, or null."""
    return F.nullif(stripped(F.regexp_extract(c, r"(?ims)^#{1,6}\s+(?:Proposed patch|수정 예시|패치 제안)[ \t]*\n(.*?)(?=^#{1,6}\s+|\z)", 1)), F.lit(""))


def truncated_values(c: Column | str, n: int) -> Column:
    """A map's texts, each cut to n characters."""
    return F.transform_values(c, lambda k, v: truncated(v, n))


def without_key(c: Column | str, hidden: str) -> Column:
    """A map without a key, however its letters and underscores are written."""
    return F.map_filter(c, lambda k, v: F.replace(F.lower(k), F.lit("_"), F.lit("")) != hidden)


def repository_address(c: Column | str) -> Column:
    """(owner, name) of a repository's address, or null."""
    c = F.rtrim(F.trim(c), F.lit("/"))
    pattern = r"^https://github\.com/([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("owner"), F.regexp_extract(c, pattern, 2).alias("name")))


def step_kinds(chain: Column | str, function: Column | str) -> Column:
    """What each step of a chain is: the function it begins in, its sink at the end, a control, or data."""
    chain, function = (F.col(x) if isinstance(x, str) else x for x in (chain, function))
    last = F.size(chain) - 1
    return F.transform(chain, lambda x, i: F.when((i == 0) & (F.trim(function) != "") & x.endswith(F.concat(F.lit("."), F.trim(function))), "function").when(i == last, "sink").when(F.lower(x).rlike(r"control|check|limit|validation|not seen|unclear"), "control").otherwise("data"))


def chain_sink(chain: Column | str, function: Column | str) -> Column:
    """The last step's bare name that isn't the function itself: of the last call that a step shows, or of the step."""
    chain, function = (F.col(x) if isinstance(x, str) else x for x in (chain, function))

    def name(x: Column) -> Column:
        shown = F.regexp_extract_all(x, F.lit(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("), F.lit(1))
        said = F.when(F.size(shown) > 0, F.element_at(shown, -1)).otherwise(F.trim(x))
        return F.element_at(F.split(said, r"\."), -1)

    own = F.coalesce(F.element_at(F.split(F.trim(function), r"\."), -1), F.lit(""))
    names = F.filter(F.transform(F.reverse(chain), name), lambda x: (x != "") & (x != own))
    first = F.get(names, F.lit(0))
    plain = F.regexp_extract(first, r"([A-Za-z_$][\w$]*)\s*(?:\(|$)", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), first, F.lit(""))


def display_time(c: Column | str) -> Column:
    """An ISO time as yyyy-MM-dd HH:mm:ss; what can't be read is passed through."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss"), c)


def titled(c: Column | str) -> Column:
    """SQL_INJECTION as Sql Injection."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def algorithm(c: Column | str) -> Column:
    return F.upper(F.replace(c, F.lit("_"), F.lit("-")))


def progress_percent(done: Column | str, total: Column | str) -> Column:
    """72 + round(done / total * 20), half to even, with done within 0..total; 92 without a total."""
    done, total = (F.col(x) if isinstance(x, str) else x for x in (done, total))
    within = F.greatest(F.lit(0), F.least(done, total))
    return F.when(total <= 0, F.lit(92)).otherwise(F.lit(72) + F.bround(within / total * 20).cast("int"))


def snippet_lines(c: Column | str) -> tuple[Column, Column]:
    """First and last line number that a rendered snippet shows."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*>?\s*(\d+)\s*\|"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_min(numbers), F.array_max(numbers)


def merged_text(texts: Column | str, label: str) -> Column:
    """Fold an ordered array of texts: each that is empty or already contained is skipped, others are appended under a label."""
    texts = F.col(texts) if isinstance(texts, str) else texts
    return F.aggregate(texts, F.lit(""), lambda acc, x: F.when((F.coalesce(x, F.lit("")) == "") | acc.contains(x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(f"\n\n{label}: "), x)))


def distinct_filled(xs: Column | str) -> Column:
    """An array's distinct strings in order, blanks left out."""
    return F.array_distinct(F.filter(xs, lambda x: F.trim(x) != ""))


def without_fences(c: Column | str) -> Column:
    """Markdown without its fenced blocks; lines outside are those before which an even number of fence lines stands."""
    lines = F.split(c, "\n", -1)
    folded = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept")), lambda acc, x: F.when(F.ltrim(x).startswith("```"), F.struct((~acc["inside"]).alias("inside"), acc["kept"].alias("kept"))).when(acc["inside"], acc).otherwise(F.struct(acc["inside"].alias("inside"), F.array_append(acc["kept"], x).alias("kept"))))
    return F.array_join(folded["kept"], "\n")


#: Elements that act, and lines that speak of the machinery instead of the code; a parameter of sanitized_markdown().
_ACTIVE = r"(?is)<\s*/?\s*(?:script|style|iframe|object|embed|form|input|button|textarea|select|option|meta|link)[^>]*>"
_MACHINERY = r"(?i)\bjson\b|code_snippet|call_chain|guideline_refs|source_link|\b(?:CVE|CWE|CVSS)(?:[-_:]?\w+)?"


def sanitized_markdown(c: Column | str, unwanted: str = _MACHINERY) -> Column:
    """Tags of active elements removed, unwanted lines outside of fences left out, runs of blank lines collapsed."""
    lines = F.split(F.regexp_replace(c, _ACTIVE, ""), "\n", -1)
    empty = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fence = F.trim(x).startswith("```")
        keep = fence | acc["inside"] | ~x.rlike(unwanted)
        return F.struct(F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), F.when(keep, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    kept = F.array_join(F.aggregate(lines, empty, step, lambda acc: acc["kept"]), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def merged_structs(xs: Column | str, identity: list[str]) -> Column:
    """An array's structs, of those that agree in the identity fields the first."""
    xs = F.col(xs) if isinstance(xs, str) else xs
    same = lambda x: F.struct(*(x[f] for f in identity))
    first = lambda x, i: F.array_position(F.transform(xs, same), same(x)) == i + 1
    return F.filter(xs, first)
