"""What the training-data operators share: scratch space, hashing, word splitting, Arrow batches."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: ASCII white space, the set `[\x20\x09-\x0D]`; `bytes.split()` and `bytes.strip()` use just this set.
SPACE = " \t\n\x0b\x0c\r"

#: Rows and bytes to an Arrow batch, whichever is reached first: a batch of long documents has fewer of them.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, one of
    our own where that is unset; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/tarnlens-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def uri_of(spark: SparkSession, path: str) -> str:
    """The URI of a path as Spark resolves it: a bare one lies in the default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toASCIIString()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; its folder is the cluster's to clean
        pass


#: Removes a write's shuffle files as soon as it has ended; what reads the written table needs none of them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tarnlens_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of settled tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.tarnlens_path)


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs give back the heap that work so far has made them take.

    A JVM keeps what it once took, up to its limit, whatever it holds; the Python workers beside it need that memory. Called
    before many files are written, as a JVM counts twice while it starts a process, which Hadoop's local file system does for
    each file. Only memory is touched: where it reaches not every executor, nothing else differs.
    """
    if spark.sparkContext.master.startswith("local["):
        return
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, so that a batch of very long texts fits a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(names: list[str], kinds: list[pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def h128(data: bytes) -> bytes:
    """A 128-bit content hash: at 10^12 distinct inputs a collision has a chance of about 10^-15."""
    return xxhash.xxh3_128_digest(data)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit content hashes of some ranges of bytes, two 64-bit numbers each."""
    one = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(raw[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A 64-bit code for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLANK = np.isin(np.arange(256), list(SPACE.encode()))
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


class Words(NamedTuple):
    """The words `[^\\x20\\x09-\\x0D]+` of a text: a code for each, all of them joined by one blank, and where each lies there.

    A word's code adds up a number for each of its bytes that depends on value and place in a way which isn't linear in
    either, so no regular structure of a word makes it agree with another's, as it can for polynomials modulo 2^64.
    """

    codes: np.ndarray
    raw: bytes
    begin: np.ndarray
    end: np.ndarray


def words(datas: list[bytes]) -> list[Words]:
    """The words of each of some texts. They are cut together, a piece at a time, as most texts are short."""
    data = b"\n".join(datas)
    codes, raws, sizes, starts, at = [], [], [], [], 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1
        x = np.frombuffer(data[at:stop] + b" ", np.uint8)
        inside = ~_BLANK[x]
        step = np.diff(inside.astype(np.int8), prepend=0)
        start, last = np.flatnonzero(step == 1), step == -1
        size = np.flatnonzero(last) - start
        if len(size):
            kept = x[inside]
            first = np.cumsum(size) - size
            place = np.arange(len(kept)) - np.repeat(first, size)
            z = BYTE_CODES[kept] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            z = (z ^ (z >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
            codes.append(mix(np.add.reduceat(z ^ (z >> np.uint64(29)), first) + size.astype(np.uint64)))
            held = inside | last  # each word and the blank behind it
            raws.append(np.where(inside, x, np.uint8(32))[held].tobytes())
            sizes.append(size)
            starts.append(start + at)
        at = stop
    none = np.zeros(0, np.int64)
    size, start = (np.concatenate(x) if x else none for x in (sizes, starts))
    code, raw = np.concatenate(codes) if codes else np.zeros(0, np.uint64), b"".join(raws)
    end = np.cumsum(size + 1) - 1
    begin = end - size
    cuts = np.searchsorted(start, np.cumsum([0, *(len(d) + 1 for d in datas)])).tolist()
    return [Words(code[a:b], raw, begin[a:b], end[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Stands for a null id: it comes before all others, and an integer id can't be this number itself.
NO_ID = -(2**63)


def integer_id(df: DataFrame, id_col: str):
    """The id as a bigint, null as NO_ID. Operators that speak of the smallest id take integer ids only."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {df.schema[id_col].dataType.simpleString()}: the operator orders documents by it")
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID).cast("bigint"))


def _letters_table(keep: Callable[[int], bool]) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


#: Bytes to lower-cased ASCII letters, digits and everything beyond ASCII; the rest to a blank.
_WORD_TABLE = _letters_table(lambda b: b >= 128 or chr(b).isalnum())
_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def letter_words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8 bytes."""
    return data.translate(_WORD_TABLE).split()


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER_TABLE)
