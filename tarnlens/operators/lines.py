"""Scans over the lines of texts, without joining a table of lines with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_lines(df: DataFrame, text: str, out: str = "lines") -> DataFrame:
    return df.withColumn(out, F.split(text, "\n", -1))


def exploded_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def first_line(lines: Column, holds) -> Column:
    """Number of the first line for which holds(line) is true, or 0."""
    return F.array_position(F.transform(lines, holds), True)


def rendered_context(lines: Column, at: Column, around: int = 3) -> Column:
    """The lines around one, numbered, the line itself marked: what a range join over lines would give, within the row."""
    first, last = F.greatest(F.lit(1).cast("bigint"), at - around), F.least(F.size(lines).cast("bigint"), at + around)
    width = F.length(last.cast("string"))
    shown = F.transform(F.sequence(first, last), lambda i: F.concat(F.when(i == at, F.lit("> ")).otherwise(F.lit("  ")), F.lpad(i.cast("string"), width, F.lit(" ")), F.lit(" | "), F.element_at(lines, i.cast("int"))))
    return F.array_join(shown, "\n")


def matched_rules(text: str, rules: list[tuple]) -> Column:
    """The ids of the rules that a text matches, in order: all rules in one pass over the table.

    A rule is (id, pattern) or (id, pattern, literal): a text without the literal can't match and is spared the pattern.
    """

    def holds(pattern: str, literal: str | None = None) -> Column:
        found = F.col(text).rlike(pattern)
        return F.col(text).contains(literal) & found if literal else found

    return F.array_compact(F.array(*(F.when(holds(*rest), F.lit(name)) for name, *rest in rules)))


def scan(df: DataFrame, key: str, text: str, rules: list[tuple]) -> DataFrame:
    """(key, rule), one row per rule that matches."""
    return df.select(key, F.explode(matched_rules(text, rules)).alias("rule"))
