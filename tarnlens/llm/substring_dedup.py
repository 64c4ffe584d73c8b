"""Substring deduplication by words, keeping the first occurrence: seed and extend.

Method: documents are joined on winnowed anchors (seeds), matches are extended both ways from them, by whole blocks and
at their edges word by word, and the union of the repeated windows leaves the maximal repeats of at least `window`
words. See windows.py for the rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, windows

WINDOW = 20
GRAM = 10


def word_units(datas: list[bytes]) -> list[windows.Units]:
    """Contents are compared as words joined by one blank."""
    return [windows.Units(*w) for w in common.words(datas)]


def _keep(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words, gone = common.utf8(text).split(), 0
                n = len(words)
                if (found := b.column("spans")[i].values) is not None and len(found):
                    cover = windows.coverage(n, *(found.field(f).to_numpy().astype(np.int64) for f in ("start", "n")), window)
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    gone = n - len(words)
                kept = b" ".join(words)
                for column, value in zip(out, (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text), one per input row.

    Null and empty texts have no words. A null id comes before all others. Rows that repeat an id are one document given
    several times: what they hold at the same place isn't earlier in one than in the other. Ids are integers; other types
    raise TypeError. Other columns are ignored, whatever their names; an empty table gives an empty result. Without
    with_text, kept_text is null.
    """
    source = windows.keyed(docs, id_col, text_col)
    spans = windows.repeated_windows(source, word_units, window, gram, keep_first=True)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("_id"), common.integer_id(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    whole = texts.join(spans, ["id", "th"], "left").select(F.col("_id").alias("id"), "text", "spans")
    return common.arrow_map(whole, _keep(window, with_text), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
