"""Removal of byte strings that occur more than once, every occurrence of them.

The README says why this isn't a sort of all suffixes: their run would be many times the disk that is allowed. Suffixes are
taken at winnowed anchors only, and brought together by hash; see windows.py.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, windows

WINDOW = 400
GRAM = 320
#: Shorter strings that occur again are reported, not removed: a passage of 50 words has some 300 bytes. Every one of REPORT
#: bytes is found, by a winnowed gram of REPORT_GRAM bytes in it.
REPORT = 300
REPORT_GRAM = 200


def byte_units(datas: list[bytes]) -> list[windows.Units]:
    return [windows.Units(common.BYTE_CODES[np.frombuffer(d, np.uint8)], d) for d in datas]


def _covered(spans, length: int, window: int) -> np.ndarray:
    """Which bytes lie in the windows of a row's spans; spans may be null."""
    found = spans.values
    if found is None or not len(found):
        return np.zeros(length, bool)
    return windows.coverage(length, *(found.field(f).to_numpy().astype(np.int64) for f in ("start", "n")), window)


def _keep(window: int, report: int, with_bytes: bool):
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for i, text in enumerate(b.column("text").to_pylist()):
                data = kept = common.utf8(text)
                cover = _covered(b.column("spans")[i], len(data), window)
                runs = 0
                if cover.any():
                    kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
                    runs = int(cover[0]) + int(np.count_nonzero(cover[1:] & ~cover[:-1]))
                again = int(np.count_nonzero(_covered(b.column("reported")[i], len(data), report))) if report else None
                for column, value in zip(out, (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), again, kept if with_bytes else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept_bytes"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, report: int = 0, report_gram: int = REPORT_GRAM, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, kept_bytes), one per input row.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else, in the same document or another.
    n_repeated counts the bytes that repeated winnowed grams of `report_gram` bytes cover: at least that many of every string of
    `report` bytes or more that occurs again, nothing of strings under `report_gram`. They stay; with report 0 it is null. Null and empty texts have no bytes. Rows that repeat an id are occurrences like any others; equal
    rows of one id lose what they share. Ids are integers or null; other types raise TypeError. Other columns are ignored,
    whatever their names; an empty table gives an empty result. What is left of a text may split a character, so it is
    binary; without with_bytes it is null.
    """
    source = windows.keyed(docs, id_col, text_col)
    spans = windows.repeated_windows(source, byte_units, window, gram, keep_first=False)
    shorter = windows.repeated_grams(source, byte_units, report, report_gram) if report else spans.limit(0)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_id"), common.integer_id(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    whole = texts.join(spans, ["id", "th"], "left").join(shorter.withColumnRenamed("spans", "reported"), ["id", "th"], "left").select(F.col("_id").alias("id"), "text", "spans", "reported")
    done = common.arrow_map(whole, _keep(window, report_gram if report else 0, with_bytes), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated bigint, kept_bytes binary")
    return done.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), report=REPORT, with_bytes=False).drop("kept_bytes")
