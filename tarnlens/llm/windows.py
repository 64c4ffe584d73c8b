"""Windows of fixed length that occur more than once, found from winnowed anchors.

Every window of W units (words or bytes) has an anchor, the smallest hash among its K-grams, so equal windows have
equal anchors at equal places. Consecutive windows with one anchor at one place form a block. Three rounds, each on what the last left open:

1. Seeds. Blocks are joined on anchors; a block whose anchor occurs once in the corpus holds no repeated window.
2. Blocks of equal content are one class. All windows of a class with several members occur again.
3. Of each class that is still open one member is extended window by window, and equal windows are counted.

A round shuffles hashes and places only. Counts are pre-aggregated on the map side and the joins that mark the members are
plain equi-joins, so a passage that a third of all documents hold is split by Spark instead of landing in one task.
Anchors are chosen by a rolling hash, which only brings blocks together; contents are compared by xxh3 of their bytes, 128
bits, in which no structure of a text is known to collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows handled at once in a very long text.
CHUNK = 1 << 17
U = np.uint64
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, U)] * 2


class Units(NamedTuple):
    """A text as a sequence of units, words or bytes: a code for each, and where each lies in the bytes."""

    codes: np.ndarray
    raw: bytes
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    def digests(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Content hashes of the units from first to before after, two 64-bit numbers each."""
        if self.begin is None:
            return common.digests(self.raw, first, after)
        return common.digests(self.raw, self.begin[first], self.end[after - 1])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_tables[0]) < n:
        size = max(n, 1 << 16, min(2 * len(_tables[0]), CHUNK * 2))
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, U(b))
            x[0] = 1
            _tables[k] = np.multiply.accumulate(x)
    return _tables[0], _tables[1]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive codes, from prefix sums. It only chooses anchors: contents are never compared by it."""
    power, inverse = _powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * power[: len(codes)], out=prefix[1:])
    n = len(prefix) - k
    return common.mix((prefix[k:] - prefix[:n]) * inverse[:n])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, from minima that run forwards and backwards in blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, U(2**64 - 1))
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def blocks(units: Units, w: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, content hash, first window, number of windows) of the blocks of one text, a chunk at a time."""
    codes = units.codes
    for at in range(0, len(codes) - w + 1, CHUNK):
        grams = gram_hashes(codes[at : at + CHUNK + w - 1], k)
        anchors = window_minima(grams, w - k + 1)
        # the anchor is the rightmost smallest gram: an equal one that comes in begins a new block
        cut = np.flatnonzero((anchors[1:] != anchors[:-1]) | (grams[w - k + 1 :] == anchors[1:])) + 1
        start = np.concatenate((np.zeros(1, np.int64), cut))
        end = np.concatenate((cut, np.array([len(anchors)])))
        yield anchors[start].view(np.int64), units.digests(start + at, end + at + w - 1), start + at, end - start


def _seed_rows(coder: Callable[[list[bytes]], list[Units]], w: int, k: int):
    names = ["a", "c", "d", "id", "th", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            times = np.zeros(b.num_rows, np.int64)
            for i, units in enumerate(coder([common.utf8(t) for t in b.column("text").to_pylist()])):
                for part in blocks(units, w, k):
                    times[i] += len(part[0])
                    for column, value in zip(out, part, strict=True):
                        column.append(value)
            a, content, s, n = (np.concatenate(x) for x in out)
            took = pa.array(np.repeat(np.arange(b.num_rows), times))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(content[:, 0]), pa.array(content[:, 1]), b.column("id").take(took), b.column("th").take(took), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=names)

    return run


def _window_rows(coder: Callable[[list[bytes]], list[Units]], w: int):
    names = ["a", "c", "d", "id", "th", "pos", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, units in enumerate(coder([common.utf8(t) for t in b.column("text").to_pylist()])):
                found = b.column("blocks")[i].values
                a, start, n, need = (found.field(f).to_numpy(zero_copy_only=False) for f in ("a", "start", "n", "need"))
                pos = np.repeat(start.astype(np.int64), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                content = units.digests(pos, pos + w)
                one = pa.array([i]).take(pa.array(np.zeros(len(pos), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, n)), pa.array(content[:, 0]), pa.array(content[:, 1]), b.column("id").take(one), b.column("th").take(one), pa.array(pos.astype(np.int32)), pa.array(np.repeat(need, n))], names=names)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): th tells rows of one id apart, and equal rows of one id from no other."""
    return docs.select(common.integer_id(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def repeated_windows(source: DataFrame, coder: Callable[[list[bytes]], list[Units]], w: int, k: int, keep_first: bool) -> DataFrame:
    """Rows (id, th, spans array<struct<start,n>>): runs of windows that occur again or, with keep_first, that occur
    earlier (in a smaller id, or at a smaller start of the same id). source is keyed(). The result is a written table."""
    seeds = common.arrow_map(source, _seed_rows(coder, w, k), "a bigint, c bigint, d bigint, id bigint, th bigint, start int, n int")
    # what is counted is written before it is joined: then both sides are dealt by the join alone, and Spark can split a hot key
    again = common.settled(seeds.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("a"), "anchors")
    found = common.settled(seeds.join(again, "a"), "seeds")
    common.dropped(again)

    # a place fits a long where ids and texts allow it; else a decimal of 38 digits orders the same way
    low, high, far = found.agg(F.min("id"), F.max("id"), F.max(F.col("start") + F.col("n"))).first()
    kind = "bigint" if low is None or (low >= 0 and high < 1 << 38 and far < 1 << 24) else "decimal(38,0)"
    place = lambda at: F.col("id").cast(kind) * F.lit(1 << 24 if kind == "bigint" else 1 << 31).cast(kind) + F.col(at).cast(kind)

    placed = found.withColumn("place", place("start"))
    classes = common.settled(placed.groupBy("a", "c", "d").agg(F.count(F.lit(1)).alias("members"), F.min("place").alias("first")), "classes")
    told = placed.join(classes, ["a", "c", "d"])
    if keep_first:
        covered = told.filter("place <> first").select("id", "th", "start", "n")
        several = common.settled(classes.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("a"), "open")
        still = told.filter("place = first").join(several, "a").withColumn("need", F.lit(True))
    else:
        covered = told.filter("members > 1").select("id", "th", "start", "n")
        several = common.settled(classes.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("members").alias("least")).filter("m > 1 and least = 1").select("a"), "open")
        still = told.filter("place = first").join(several, "a").withColumn("need", F.col("members") == 1)
    wanted = still.groupBy("id", "th").agg(F.collect_list(F.struct("a", "start", "n", "need")).alias("blocks"))
    texts = source.join(wanted, ["id", "th"]).select("id", "th", "text", "blocks")
    single = common.settled(common.arrow_map(texts, _window_rows(coder, w), "a bigint, c bigint, d bigint, id bigint, th bigint, pos int, need boolean"), "windows")
    windows = single.withColumn("place", place("pos"))
    counted = windows.groupBy("a", "c", "d").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("first"), F.max("need").alias("wanted")).filter("m > 1 AND wanted")
    repeats = common.settled(counted.select("a", "c", "d", "first"), "repeats")
    more = windows.filter("need").join(repeats, ["a", "c", "d"]).filter("place <> first" if keep_first else "true")
    spans = covered.unionByName(more.select("id", "th", F.col("pos").alias("start"), F.lit(1).alias("n")))
    done = common.settled(spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    common.dropped(found, classes, several, single, repeats)
    common.shrink_heaps(source.sparkSession)
    return done


#: Low bits of a gram's hash that give way to its place, so that the smallest hash tells where it stands.
_PLACE = U((1 << 20) - 1)


def winnowed(codes: np.ndarray, w: int, k: int) -> Iterator[np.ndarray]:
    """Places of the grams of k codes that are the smallest by hash, the last of equal ones, in some window of w codes."""
    for at in range(0, len(codes) - w + 1, CHUNK):
        grams = gram_hashes(codes[at : at + CHUNK + w - 1], k)
        least = window_minima((grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=U)), w - k + 1)
        changed = np.concatenate((np.ones(1, bool), least[1:] != least[:-1]))
        yield at + (_PLACE - (least[changed] & _PLACE)).astype(np.int64)


def _gram_rows(coder: Callable[[list[bytes]], list[Units]], w: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, content = [], []
            for units in coder([common.utf8(t) for t in b.column("text").to_pylist()]):
                found = [np.zeros(0, np.int64), *winnowed(units.codes, w, k)]
                places.append(np.unique(np.concatenate(found)))
                content.append(units.digests(places[-1], places[-1] + k)[:, 0])
            took = pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in places]))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(content or none)), b.column("id").take(took), b.column("th").take(took), pa.array(np.concatenate(places or none).astype(np.int32))], names=["c", "id", "th", "start"])

    return run


def repeated_grams(source: DataFrame, coder: Callable[[list[bytes]], list[Units]], w: int, k: int) -> DataFrame:
    """Rows (id, th, spans array<struct<start,n>>) of the winnowed grams of k units that occur again, told by a 64-bit hash of
    their content. Every string of w units or more that occurs again holds such a gram at the same place; shorter ones that
    hold a gram may. One round, so it costs less than repeated_windows(). The result is a written table."""
    grams = common.arrow_map(source, _gram_rows(coder, w, k), "c bigint, id bigint, th bigint, start int")
    again = common.settled(grams.groupBy("c").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("c"), "grams")
    found = grams.join(again, "c").groupBy("id", "th").agg(F.collect_list(F.struct("start", F.lit(1).alias("n"))).alias("spans"))
    done = common.settled(found, "reported")
    common.dropped(again)
    return done


def coverage(length: int, start: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
    """Which of `length` units lie in a window that starts in one of the runs."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, np.minimum(start, length), 1)
    np.add.at(edge, np.minimum(start + n + w - 1, length), -1)
    return np.cumsum(edge[:-1]) > 0
