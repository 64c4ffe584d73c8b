"""Token counts without token ids.

Method: a pre-token is a maximal run of bytes between ASCII white space. The tokenizer drops white space and no
token crosses it, so a text's count is the sum over its pre-tokens. Pieces are counted once for each distinct pre-token
of the corpus; those counts are joined to the per-document pre-token frequencies and summed.

The join has two arms with the same result. The HEAD_ROWS most widespread pre-tokens of at most HEAD_BYTES bytes travel
as a broadcast of at most HEAD_ROWS * HEAD_BYTES bytes, whatever the corpus' size; the rest, each of them rare, are
joined by a shuffle. So no hot word reaches the shuffle, and nothing that grows is broadcast.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEAD_ROWS = 100_000
HEAD_BYTES = 48
#: Distinct pre-tokens that a task holds before it hands them on, and bytes of texts with long ones (over LONG on average).
FLUSH, FLUSH_BYTES, LONG = 120_000, 4 << 20, 64


def _load(path: str):
    # a pool of threads in each worker would only take memory: the tasks are parallel already
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pretokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    size = 0

    def out() -> pa.RecordBatch:
        return common.batch(["word", "docs"], [pa.binary(), pa.int64()], [list(held.keys()), list(held.values())])

    for b in batches:
        for text in b.column("text").to_pylist():
            data = common.utf8(text)
            words = set(data.split())
            size += len(data) if len(data) > LONG * len(words) else 0
            held.update(words)
            if len(held) > FLUSH or size > FLUSH_BYTES:
                yield out()
                held.clear()
                size = 0
    yield out()


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(path)
        for b in batches:
            words, docs = b.column("word").to_pylist(), b.column("docs").to_pylist()
            texts = [w.decode("utf-8", "surrogatepass") for w in words]
            pieces = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
            yield common.batch(["word", "docs", "pieces"], [pa.binary(), pa.int64(), pa.int32()], [words, docs, pieces])

    return run


def piece_vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """One row per distinct pre-token of the corpus: word, docs (documents that hold it), pieces."""
    seen = common.arrow_map(docs.select(F.col(text_col).alias("text")), _pretokens, "word binary, docs bigint")
    distinct = seen.groupBy("word").agg(F.sum("docs").alias("docs"))
    return common.settled(common.arrow_map(distinct, _counter(tokenizer_path), "word binary, docs bigint, pieces int"), "pieces")


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one per input row.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat an id, or whose id is null, are counted each by
    itself; ids may be of any type. Very long pre-tokens take the shuffled arm. Other columns of the input are ignored.
    An empty table gives an empty result. Special strings inside a text count as the tokenizer counts them by default.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    vocabulary = piece_vocabulary(docs, tokenizer_path, text_col)
    head = vocabulary.filter(F.length("word") <= HEAD_BYTES).orderBy(F.desc("docs"), "word").limit(HEAD_ROWS).select("word", "pieces")
    known = spark.sparkContext.broadcast({bytes(r.word): r.pieces for r in head.toLocalIterator()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pre-token beyond the head, and one for the input row itself: its key meets no pre-token, as \\xff
        is in no UTF-8 text, and spreads the rows."""
        from pyspark import TaskContext

        pieces, row = known.value, TaskContext.get().partitionId() << 40
        for b in batches:
            rows, keys, counts, took, sizes = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                row += 1
                data = common.utf8(text)
                total = 0
                for w, n in Counter(data.split()).items():
                    k = pieces.get(w)
                    if k is None:
                        rows.append(row)
                        keys.append(w)
                        counts.append(n)
                        took.append(None)
                        sizes.append(None)
                    else:
                        total += k * n
                rows.append(row)
                keys.append(b"\xff%d" % row)
                counts.append(total)
                took.append(i)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), b.column("id").take(pa.array(took, pa.int32()))], names=["row", "word", "n", "n_bytes", "id"])

    common.shrink_heaps(spark)
    parts = common.arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), split, f"row bigint, word binary, n bigint, n_bytes bigint, id {kind}")
    joined = parts.join(vocabulary.select("word", "pieces"), "word", "left")
    # an input row's own line has its sum over the head as n, and no pieces
    summed = joined.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce("pieces", F.lit(1)) * F.col("n")).alias("n_tokens"))
    return summed.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
