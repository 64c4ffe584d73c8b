"""Token ids in training order, as fixed-stride binary shards.

Method: documents are encoded once, in input order, each followed by the end id, and packed without gaps into sequences of
LENGTH ids. A keyed Feistel network with cycle-walking is a permutation of the sequence numbers: it gives every sequence its
global slot, with no table and no sort by a random key. Range partitions by shard write slot s at byte
(s mod rows) * stride of shard s div rows, so training reads sequentially and resumes at any slot by arithmetic.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import encoder

LENGTH = 2048
END_ID = 2
KEY = 0x243F6A8885A308D3
ROUNDS = 6
#: Least and most rows of a shard, and the number of shards that is aimed at between them.
LEAST_ROWS, MOST_ROWS, SHARDS = 256, 65_536, 1024


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & mask


def slots(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of some sequence numbers among `total`: a permutation of range(total) that the key chooses."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = np.array(numbers, np.uint64)
    walk = np.arange(len(out))
    while len(walk):  # a cycle of the larger domain is followed until it comes back into range; it must, as it began there
        x = out[walk]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ _round(right, k, mask)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def _filesystem(uri: str):
    """The store of a URI, and the path in it. A bare path names no store, so it is turned down."""
    from pyarrow import fs

    if not re.match(r"\w[\w+.-]*:/", uri):
        raise ValueError(f"{uri} has no scheme; shards go to a store that all executors reach, named by its URI")
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)


@lru_cache(maxsize=1)
def _codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair to a worker: most pieces are a few KB, and setting up a codec for each costs more than using it."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeezed(ids: bytes) -> bytes:
    """Ids on their way between stages. As they stand they compress better than by byte planes: words come again."""
    return _codecs()[0].compress(ids)


def unsqueezed(data: bytes) -> bytes:
    return _codecs()[1].decompress(data)


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        width = enc.width
        end = end_id.to_bytes(width, "little")
        gc.disable()  # what is made here are flat lists of texts and numbers, without cycles to be found
        try:
            for b in batches:
                ids = enc.packed(b.column("text").to_pylist(), end)
                yield common.batch(["part", "at", "n", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], [[part], [at], [len(ids) // width], [squeezed(ids)]])
                at += len(ids) // width
        finally:
            gc.enable()

    return run


def write_shards(docs: DataFrame, out: str, model_path: str, length: int = LENGTH, end_id: int = END_ID, key: int = KEY, rows_per_shard: int | None = None, text_col: str = "text") -> DataFrame:
    """Write shard-*.bin and index.json to `out`, and return rows (slot, shard, byte_offset, sequence, n_tokens, ids_sha256).

    Null and empty texts bring their end id alone; an empty table writes an index of no sequences. The last sequence is
    filled up with end ids, and n_tokens tells how many are its own. Texts longer than a sequence run on in the next; rows
    that repeat are packed as often as they come; other columns are ignored. `out` is a URI that executors can write to. A
    task that is repeated writes the same bytes under a name of its own and renames them.
    """
    spark = docs.sparkSession
    width = encoder(model_path).width
    packed = common.settled(common.arrow_map(docs.select(F.col(text_col).alias("text")), _tokens(model_path, end_id), "part bigint, at bigint, n bigint, ids binary"), "ids")
    # one number for each input partition comes to the driver
    totals = sorted((r.part, r.n) for r in packed.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator())
    ends = np.cumsum([n for _, n in totals]) if totals else np.zeros(0, np.int64)
    offsets = {p: int(e - n) for (p, n), e in zip(totals, ends, strict=True)}
    tokens = int(ends[-1]) if len(ends) else 0
    count = -(-tokens // length)
    rows = rows_per_shard or min(MOST_ROWS, max(LEAST_ROWS, -(-count // SHARDS)))
    shards = -(-count // rows)
    begun = spark.sparkContext.broadcast(offsets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "at", "n", "ids")), strict=True):
                first = begun.value[part] + at
                ids = unsqueezed(ids)
                edges = np.arange(first // length + 1, (first + n - 1) // length + 1) * length
                starts = np.concatenate((np.array([first]), edges))
                stops = np.concatenate((edges, np.array([first + n])))
                numbers = starts // length
                pieces = [squeezed(ids[(s - first) * width : (e - first) * width]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                slot = slots(numbers, count, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot // rows), pa.array(slot), pa.array(numbers), pa.array((starts % length).astype(np.int32)), pa.array(pieces, pa.binary())], names=["shard", "slot", "sequence", "at", "ids"])

    fill = np.full(length, end_id, np.dtype(f"<u{width}")).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _filesystem(out)
        attempt = TaskContext.get().taskAttemptId()
        held: list = []
        stream = shard = None

        def close() -> None:
            if stream is not None:
                stream.close()
                store.move(f"{base}/_attempt-{attempt}-{shard:08d}", f"{base}/shard-{shard:08d}.bin")

        def finished() -> tuple:
            slot, number, own = held[0], held[1], b"".join(map(unsqueezed, held[2]))
            whole = own + fill[len(own) :]
            if len(whole) != length * width or (len(own) < len(whole) and number != count - 1):
                raise ValueError(f"sequence {number} has {len(own) // width} ids")
            stream.write(whole)
            return slot, slot // rows, slot % rows * length * width, number, len(own) // width, hashlib.sha256(own).hexdigest()

        def told(found: list[tuple]) -> pa.RecordBatch:
            return common.batch(["slot", "shard", "byte_offset", "sequence", "n_tokens", "ids_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], [list(c) for c in zip(*found, strict=True)] if found else [[]] * 6)

        for b in batches:
            found = []
            for to, slot, number, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "sequence", "ids")), strict=True):
                if held and held[0] == slot:
                    held[2].append(ids)
                    continue
                if held:
                    found.append(finished())
                if to != shard:
                    close()
                    shard = to
                    stream = store.open_output_stream(f"{base}/_attempt-{attempt}-{shard:08d}")
                held = [slot, number, [ids]]
            yield told(found)
        if held:
            yield told([finished()])
        close()

    store, base = _filesystem(out)
    store.create_dir(base, recursive=True)
    # ranges of shards: their bounds are known, so nothing is sampled for them
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sequences = common.arrow_map(packed, cut, "shard bigint, slot bigint, sequence bigint, at int, ids binary")
    ordered = sequences.repartitionById(parts, F.floor(F.col("shard") * parts / max(1, shards)).cast("int")).sortWithinPartitions("slot", "at")
    index = common.settled(common.arrow_map(ordered, write, "slot bigint, shard bigint, byte_offset bigint, sequence bigint, n_tokens bigint, ids_sha256 string"), "index")
    common.dropped(packed)
    with store.open_output_stream(f"{base}/index.json") as f:
        f.write(json.dumps({"sequences": count, "tokens": tokens, "length": length, "width": width, "rows_per_shard": rows, "shards": shards, "key": key, "end_id": end_id}).encode())
    return index


def read_slots(out: str, start: int = 0) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order."""
    store, base = _filesystem(out)
    with store.open_input_stream(f"{base}/index.json") as f:
        x = json.loads(f.read())
    stride = x["length"] * x["width"]
    while start < x["sequences"]:
        with store.open_input_file(f"{base}/shard-{start // x['rows_per_shard']:08d}.bin") as f:
            f.seek(start % x["rows_per_shard"] * stride)
            while len(row := f.read(stride)) == stride:
                yield np.frombuffer(row, f"<u{x['width']}")
                start += 1


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = common.uri_of(spark, common.scratch_path(spark, "shards"))
    return write_shards(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("piece_bpe_32k.model"))
