"""Line deduplication.

Method: explode normalised lines, hash them, count the distinct documents of each hash, drop the lines over the
threshold, reassemble by position. What is shuffled are 16-byte hashes with line positions, never the lines; counting
is pre-aggregated on the map side, so a line that a third of all documents hold is one row per task. The join that
marks a document's repeated lines is a plain equi-join, which Spark splits where one hash has very many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CODE_POINTS = 10
MIN_DOCS = 2


def line_key(line: bytes) -> bytes:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return common.lower_ascii(line.strip())


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def line_hashes(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """Rows (id, th, key, positions): the hash of each distinct key of a document's row that is long enough, and its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, keys, positions = [], [], [], []
            for doc_id, th, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(common.utf8(text).split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_code_points and _code_points(key) >= min_code_points:
                        own.setdefault(common.h128(key), []).append(i)
                ids.extend([doc_id] * len(own))
                hashes.extend([th] * len(own))
                keys.extend(own.keys())
                positions.extend(own.values())
            yield common.batch(["id", "th", "key", "positions"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())], [ids, hashes, keys, positions])

    return common.arrow_map(docs, run, "id bigint, th bigint, key binary, positions array<int>")


def _reassemble(batches: Iterator[pa.RecordBatch], with_text: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [], [], [], []
        for text, dropped in zip(b.column("text").to_pylist(), b.column("dropped").to_pylist(), strict=True):
            lines = common.utf8(text).split(b"\n")
            gone = set(dropped or ())
            kept = b"\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else common.utf8(text)
            for column, value in zip(out, (len(lines), len(gone), kept.decode("utf-8", "surrogatepass") if with_text else None, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        rest = b.drop_columns(["text", "dropped"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[*rest.schema.names, "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_code_points: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_text, kept_sha256, *carry), one per input row.

    A key found in min_docs documents or more loses its lines everywhere but in the document of the smallest id.
    A null or empty text is one empty line. Rows that repeat an id are one document for the count, and each row loses
    the lines that its document loses; a null id counts as one document, smaller than all others. Ids are integers; other
    types raise TypeError. `carry` names columns to pass through, which must not be named like a computed one; other
    columns are ignored, whatever their names. Without with_text, kept_text is null.
    """
    source = docs.select(common.integer_id(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    rows = line_hashes(source, min_code_points)
    # rows of one id come from one place as a rule; should an id repeat, its rows count once
    repeated = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    if min_docs == 2:
        repeated = repeated.filter("last > first")
    else:
        repeated = rows.select("key", "id").distinct().groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    # written first, so that both sides of the join are dealt by it alone and Spark can split a key with very many rows
    repeated = common.settled(repeated.select("key", "first"), "lines")
    common.shrink_heaps(docs.sparkSession)
    marked = rows.join(repeated, "key").filter(F.col("id") != F.col("first"))
    # th tells rows of one id apart: positions are those of one text
    dropped = marked.groupBy("id", "th").agg(F.flatten(F.collect_list("positions")).alias("dropped"))
    kinds = dict(docs.dtypes)
    texts = docs.select(common.integer_id(docs, id_col).alias("_key"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    whole = texts.join(dropped.select(F.col("id").alias("_key"), F.col("th").alias("_th"), "dropped"), ["_key", "_th"], "left").drop("_key", "_th")
    extra = "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    done = common.arrow_map(whole.select("_id", *(f"_c{i}" for i in range(len(carry))), "text", "dropped"), partial(_reassemble, with_text=with_text), f"_id {kinds[id_col]}{extra}, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string")
    return done.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", "kept_text", "kept_sha256", *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


#: DuckDB has the same rule in SQL: keys by line, documents by key, lines rejoined by position.
OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT a.doc_id, a.pos, a.line, r.k IS NOT NULL AND a.doc_id <> r.first_doc AS gone FROM keyed a LEFT JOIN repeated r ON a.k = r.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
