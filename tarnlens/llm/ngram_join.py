"""Jaccard join on word n-grams by T-occurrence search, and the components of its links.

Method: a document that shares T shingles with a query occurs in T of the query's inverted lists. DivideSkip sets the
longest lists apart, heap-merges the short ones, and probes the long ones by binary search for the documents that occurred
often enough; those that reach the required overlap are links.

To bring together what can be linked at all, without all pairs:

1. Equal sets are one class, represented by its smallest id.
2. Sets within the threshold differ in few shingles. If shingles are dealt into more parts than can differ, one part at
   least is equal in both (the pigeonhole principle), so each non-empty part is a signature. The size bands and the
   catch-all for sets with very many empty parts keep this exact. Very common shingles, by counters of a fixed number that
   all documents fill, are left out of the parts, so a passage that very many documents hold brings none of them together.
   Sets that share signatures, as many of a band as linked sets must, form candidate groups: T-occurrence once more, as a
   set that met others by accident shares a few. Bands of even and of odd numbers may be met in turn: signatures of one never
   meet those of the other, and only half of them are on disk at once.
3. A group is searched in chunks of bounded size. A pair that is known to be connected isn't searched again. Chunks are
   joined by one representative of each component found. Groups that are still in several components, and large, are split again
   by signatures of other seeds; what is left of all of them is searched whole: every set outside its group's largest component
   against all chunks, in blocks, and in as many rounds as keep what is dealt to a multiple of the sets. So no link between
   components is lost, no group meets in one task, and disk doesn't grow with the square of a group.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix
from .components import components

#: Sets and shingles to a chunk, and sets to a chunk or block of the last search: it compares all of them anyway, and larger
#: chunks meet fewer blocks, each with a copy of their sets.
CHUNK_SETS, CHUNK_SHINGLES, ACROSS_SETS = 64, 1 << 20, 1024
#: Groups whose last search has more blocks than this are split again before it; in others that costs more than it saves.
FEW_BLOCKS = 8
#: Copies of the sets' shingles that a round of the last search deals out at most, on average.
ROUND_COPIES = 4
#: Counters of shingles, a power of two, and the pieces that they are added up in.
COUNTERS, SEGMENTS = 1 << 19, 32
#: Times the mean count from which on a shingle is very common.
COMMON = 8


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct n-word shingles; with fewer words the whole sequence is one."""
    out = []
    for codes, *_ in common.words([common.lower_ascii(common.utf8(t)) for t in texts]):
        k = min(n, len(codes))
        grams = np.full(len(codes) - k + 1 if k else 0, k, np.uint64)
        for i in range(k):  # word after word is mixed in, so no two orders of the same words are alike
            grams = mix(grams + codes[i : len(codes) - k + 1 + i])
        out.append(np.unique(grams))
    return out


class Threshold:
    """A Jaccard threshold of percent / 100, and the size bands that go with it."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [0]

    def linked(self, a: int, b: int, common_size: int) -> bool:
        return 100 * common_size >= self.percent * (a + b - common_size)

    def least_overlap(self, size: int) -> int:
        """What a set of this size shares at least with any that it is linked to."""
        return -(-self.percent * size // 100)

    def fits(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def band(self, size: int) -> int:
        """Band t holds the sizes from ends[t] + 1 to ends[t + 1]; linked sizes are in one band or in neighbours."""
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
        low = 0
        high = len(self.ends) - 1
        while low < high:
            mid = (low + high) // 2
            if self.ends[mid] < size:
                low = mid + 1
            else:
                high = mid
        return low - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Into how many parts a band's sets are dealt, and how many of them at least are equal in linked sets."""
        low, high = self.ends[band] + 1, self.ends[band + 1]
        differ = high * (100 - self.percent) // self.percent
        if not differ:
            return 1, 1
        spare = 1
        for _ in range(3):
            empty = (differ + spare) * math.exp(-low / (differ + spare))
            spare = int(empty + 6 * math.sqrt(empty)) + 3
        return differ + spare, spare


def signatures(s: np.ndarray, threshold: Threshold, common_ones: np.ndarray | None = None, seed: int = 0, odd: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and for each how many of its band two linked sets have in common at least, whatever the seed by which shingles
    are dealt. The lowest bit tells a set's two bands apart; odd asks for that of an odd or of an even number alone.

    Shingles that common_ones (flags by counter) marks are left out of the parts: sets differ no more in what is left. Of the
    parts that are equal in linked sets at most a set's own empty ones bring no hash.
    """
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    own = threshold.band(len(s))
    if common_ones is not None:
        s = s[~common_ones[_counter(s)]]
    out, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for band in (own, own - 1) if own else (own,):
        if odd is not None and band & 1 != odd:
            continue
        k, spare = threshold.parts(band)
        part = (mix(s + np.uint64((seed << 32) + band + 1)) >> np.uint64(32)).astype(np.int64) % k
        order = np.argsort(part, kind="stable")
        dealt = part[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), dealt[1:] != dealt[:-1])))
        found = []
        if len(first):
            content = np.add.reduceat(mix(s[order] ^ np.uint64(0xA0761D6478BD642F)), first)
            found.append(mix(content + mix(dealt[first].astype(np.uint64) + np.uint64((band + 1) << 32))))
        empty = k - len(first)
        if empty >= spare:
            found.append(mix(np.array([(band + 1) << 32 | 0xFFFFFFFF], np.uint64)))
        mine = np.concatenate(found)
        out.append((mine & ~np.uint64(1)) | np.uint64(band & 1))
        needs.append(np.full(len(mine), max(1, spare - empty), np.int32))
    return np.concatenate(out).view(np.int64), np.concatenate(needs)


def led_by(signed: DataFrame, shared: DataFrame, on: list[str]) -> DataFrame:
    """(id, leads) of the sets that share as many signatures of a band as linked sets have in common at least; with fewer a
    set has only met others by accident. shared has the smallest id of each signature that several sets have."""
    met = signed.join(shared, on).groupBy("id", F.col("signature").bitwiseAND(F.lit(1)).alias("band"))
    counted = met.agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"), F.collect_set(F.when(F.col("id") != F.col("lead"), F.col("lead"))).alias("leads"))
    return counted.filter("n >= need AND size(leads) > 0").select("id", "leads")


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


class Lists:
    """Inverted lists of some sets; each list has the sets' numbers in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.names, self.begin, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def search(self, query: np.ndarray, threshold: Threshold, skip) -> Iterator[int]:
        """Numbers of the linked sets, without those that skip(number) turns down when their time comes."""
        need = threshold.least_overlap(len(query))
        at = np.searchsorted(self.names, query)
        at[at == len(self.names)] = 0
        known = self.names[at] == query if len(self.names) else np.zeros(len(query), bool)
        if int(known.sum()) < need:
            return
        terms, at = query[known], at[known]
        order = np.argsort(self.count[at], kind="stable")
        longest = int(self.count[at[order[-1]]])
        apart = min(need - 1, int(need / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = order[: len(order) - apart], terms[order[len(order) - apart :]]
        merged = heapq.merge(*(self.owner[self.begin[i] : self.begin[i] + self.count[i]].tolist() for i in at[short].tolist()))
        last, times = -1, 0
        for number in [*merged, -1]:
            if number == last:
                times += 1
                continue
            if times >= need - apart and threshold.fits(len(query), self.sizes[last]) and not skip(last):
                s = self.sets[last]
                place = np.searchsorted(s, long)
                place[place == len(s)] = 0
                if threshold.linked(len(query), len(s), times + int((s[place] == long).sum())):
                    yield last
            last, times = number, 1


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]


def _within(percent: int):
    """Links that connect the sets of one chunk: (id, smallest id connected)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, sets, threshold = table.column("id").to_pylist(), _sets(table), Threshold(percent)
        lists, union = Lists(sets), Union(len(sets))
        for q, s in enumerate(sets):
            for other in lists.search(s, threshold, lambda x: x >= q or union.find(x) == union.find(q)):
                union.join(q, other)
        return _edges([(ids[q], ids[union.find(q)]) for q in range(len(sets))])

    return run


def _across(percent: int):
    """Links between a chunk's sets and a block of queries that have other labels, one for each pair of labels."""

    def run(table: pa.Table) -> pa.Table:
        threshold, asked = Threshold(percent), table.filter(table.column("asked"))
        chunk = table.filter(pa.compute.invert(table.column("asked")))
        if not len(asked) or not len(chunk):
            return _edges([])
        labels, lists, found = chunk.column("label").to_pylist(), Lists(_sets(chunk)), []
        known: dict[int, int] = {}

        def root(x: int) -> int:
            while known.get(x, x) != x:
                x = known[x]
            return x

        for label, s in zip(asked.column("label").to_pylist(), _sets(asked), strict=True):
            for other in lists.search(s, threshold, lambda x, own=label: root(labels[x]) == root(own)):
                known[max(root(label), root(labels[other]))] = min(root(label), root(labels[other]))
                found.append((label, labels[other]))
        return _edges(found)

    return run


def _sized(n: int):
    """A row per document, and the task's counts of shingles in SEGMENTS rows without a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["id", "n_shingles", "digest", "counts"]
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), n)
            if sets:
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], kinds[1]), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], kinds[2]), pa.nulls(len(sets), kinds[3])], names=names)
        if counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(SEGMENTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SEGMENTS, kinds[0]), pa.array(range(SEGMENTS), kinds[1]), pa.nulls(SEGMENTS, kinds[2]), pa.array(parts, kinds[3])], names=names)

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SEGMENTS, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(x), np.int64)
    return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def shingle_counters(parts: DataFrame) -> np.ndarray:
    """The tasks' counters added up, first in groups of tasks and then all; COUNTERS numbers come to the driver."""
    rows = parts.select(F.col("n_shingles").alias("segment"), "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("some"))
    few = common.settled(rows.groupBy("segment", "some").applyInArrow(_added, "segment bigint, counts binary"), "counters")
    total = np.zeros((SEGMENTS, COUNTERS // SEGMENTS), np.int64)
    for r in few.groupBy("segment").applyInArrow(_added, "segment bigint, counts binary").toLocalIterator():
        total[r.segment] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.minimum(total.ravel(), 2**31 - 1).astype(np.int32)


def _signed(n: int, percent: int, common_ones, odd: bool | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = Threshold(percent)
        for b in batches:
            found = [signatures(s, threshold, common_ones.value, odd=odd) for s in shingle_sets(b.column("text").to_pylist(), n)]
            yield _signature_rows(found, [b.column("id")], ["id"])

    return run


def _signature_rows(found: list[tuple[np.ndarray, np.ndarray]], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    took = pa.array(np.repeat(np.arange(len(found)), [len(f) for f, _ in found]))
    both = [pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, k)) for i, k in ((0, np.int64), (1, np.int32))]
    return pa.RecordBatch.from_arrays([*both, *(c.take(took) for c in columns)], names=["signature", "need", *names])


def _resigned(percent: int, common_ones, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = Threshold(percent)
        for b in batches:
            found = [signatures(np.frombuffer(x, np.uint64), threshold, common_ones.value if common_ones else None, seed) for x in b.column("shingles").to_pylist()]
            yield _signature_rows(found, [b.column(c) for c in ("part", "id", "label")], ["part", "id", "label"])

    return run


def several_labels(told: DataFrame) -> DataFrame:
    """Of rows with part and label those of parts with several labels, with the part's most frequent label as main."""
    most = told.groupBy("part", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("part").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    return common.settled(told.join(common.settled(most.filter("kinds > 1").select("part", "main"), "main"), "part"), "told")


def split_again(told: DataFrame, known: DataFrame, percent: int, common_ones) -> DataFrame:
    """Parts split by signatures of other seeds, as long as that at least halves them: linked sets share one by every seed, so
    sets that only chains of accidents brought together come apart, and no link is lost. Odd seeds leave no shingles out, so
    sets of nothing but very common ones are told apart, too. A set that meets none of another label is left out. known has
    the shingles of each id."""
    size, columns = told.count(), [c for c in told.columns if c not in ("part", "main")]
    for seed in itertools.count(1):
        signed = common.arrow_map(told.join(known, "id").select("part", "id", "label", "shingles"), _resigned(percent, None if seed % 2 else common_ones, seed), "signature bigint, need int, part bigint, id bigint, label bigint")
        key = ["part", "signature"]
        shared = signed.groupBy(*key).agg(F.min("id").alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).filter("high > low").select(*key, "lead")
        led = led_by(signed, common.settled(shared, "shared"), key)
        parts = components(common.arrow_map(led, _chained, "a bigint, b bigint"))
        left = several_labels(told.select(*columns).join(parts.select(F.col("node").alias("id"), F.col("label").alias("part")), "id"))
        was, size = size, left.count()
        told = left
        if not size or (seed > 1 and 2 * size > was):
            return told
    raise AssertionError


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set and the leads of its signatures are connected if each is to the smallest of them: most of those pairs are the
    same for many sets, and paths stay short."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        for own, leads in zip(b.column("id").to_pylist(), b.column("leads").to_pylist(), strict=True):
            least = min(own, *leads)
            seen.update((least, x) for x in (own, *leads) if x != least)
        if len(seen) > 100_000:
            yield from _edges(sorted(seen)).to_batches()
            seen.clear()
    yield from _edges(sorted(seen)).to_batches()


def _shingled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "part", "size", "shingles"])

    return run


def chunk_counts(rows: DataFrame, by: str, sets: int, out: str = "chunks") -> DataFrame:
    """(by, out) of the groups that need several chunks of so many sets and of CHUNK_SHINGLES shingles: a small table."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / sets), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    return common.settled(rows.groupBy(by).agg(need.alias(out)).filter(F.col(out) > 1), out)


def dealt(rows: DataFrame, counts: DataFrame, by: str = "part", count: str = "chunks", to: str = "chunk", salt: int = 7) -> DataFrame:
    """Each group's sets dealt by hash into its chunks; a group that isn't listed has one."""
    return rows.join(counts, by, "left").withColumn(count, F.coalesce(count, F.lit(1).cast("bigint"))).withColumn(to, F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)))


def search_rounds(told: DataFrame, blocks: DataFrame, chunks: DataFrame, sets: DataFrame) -> int:
    """In how many rounds all blocks meet all chunks, so that each deals out some ROUND_COPIES times the sets' shingles."""
    size = told.groupBy("part").agg(F.sum("size").alias("every"), F.sum(F.when(F.col("label") != F.col("main"), F.col("size"))).alias("asked"))
    one = lambda c: F.coalesce(c, F.lit(1).cast("bigint"))
    dealt_out = F.sum(F.col("every") * one("blocks") + F.col("asked") * one("chunks"))
    copies = size.join(blocks, "part", "left").join(chunks, "part", "left").agg(dealt_out).first()[0] or 0
    return max(1, math.ceil(copies / (ROUND_COPIES * (sets.agg(F.sum("size")).first()[0] or 1))))


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", in_turn: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per input row.

    Two documents link when their sets of n-word shingles have a Jaccard similarity of percent / 100 or more; component_id
    is the smallest id reachable. Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an
    id are one node, each with its own n_shingles. A null id comes before all others, as its component_id shows by being
    null. Ids are integers; other types raise TypeError. Other columns are ignored, whatever their names; an empty table
    gives an empty result. in_turn has signatures of even and of odd bands met one after the other: results are the same, the
    disk for signatures is half as much, and shingles are cut twice more.
    """
    source = docs.select(common.integer_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = common.settled(common.arrow_map(source, _sized(n), "id bigint, n_shingles bigint, digest binary, counts binary"), "sized")
    sized = scanned.filter("digest IS NOT NULL").drop("counts")
    counters = shingle_counters(scanned.filter("digest IS NULL"))
    common_ones = docs.sparkSession.sparkContext.broadcast(counters > COMMON * max(1.0, float(counters.mean())))
    classes = common.settled(sized.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size")), "classes")

    # candidate groups: sets that share a signature are led to the smallest of them; of equal sets one takes part
    reps = classes.select(F.col("rep").alias("id")).distinct()
    held = common.settled(sized.join(classes, "digest").filter("id <> rep").select("id", "rep"), "held")
    copies = held.select("id").distinct().join(reps, "id", "left_anti")
    first_of_each = source.join(common.settled(copies, "copies"), "id", "left_anti")
    edge = "a bigint, b bigint"
    chains = []
    for odd in (False, True) if in_turn else (None,):
        signed = common.arrow_map(first_of_each, _signed(n, percent, common_ones, odd), "signature bigint, need int, id bigint")
        shared = common.settled(signed.groupBy("signature").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("last > lead").select("signature", "lead"), "shared")
        chains.append(common.settled(common.arrow_map(led_by(signed, shared, ["signature"]), _chained, edge), "chains"))
        common.dropped(shared)
    groups = components(reduce(DataFrame.unionByName, chains))
    common.dropped(*chains)
    told = groups.select(F.col("node").alias("id"), F.col("label").alias("part"))
    sets = common.arrow_map(source.join(told, "id").select("id", "text", "part"), _shingled(n), "id bigint, part bigint, size bigint, shingles binary")
    sets = common.settled(sets, "sets")
    known = sets.select("id", "shingles")

    counts = chunk_counts(sets, "part", CHUNK_SETS)
    first = common.settled(dealt(sets, counts).groupBy("part", "chunk").applyInArrow(_within(percent), edge).distinct(), "within")
    several = sets.drop("shingles").join(counts.select("part"), "part")
    links = first
    if several.limit(1).count():
        # one representative of each component of each chunk
        ones = sets.join(counts.select("part"), "part").join(first.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        second = dealt(ones, chunk_counts(ones, "part", CHUNK_SETS)).groupBy("part", "chunk").applyInArrow(_within(percent), edge)
        links = common.settled(first.unionByName(second), "links")
        labels = components(links).withColumnRenamed("node", "id")
        told = several_labels(several.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
        if told.limit(1).count():
            blocks = chunk_counts(told.filter("label <> main"), "part", ACROSS_SETS, "blocks")
            large = blocks.filter(F.col("blocks") > FEW_BLOCKS).select("part")
            if large.limit(1).count():
                rest = told.join(large, "part", "left_anti")
                told = rest.unionByName(split_again(told.join(large, "part", "left_semi"), known, percent, common_ones).select(*rest.columns))
                blocks = chunk_counts(told.filter("label <> main"), "part", ACROSS_SETS, "blocks")
            asked = told.filter("label <> main")
            chunks = chunk_counts(told, "part", ACROSS_SETS)
            every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(c, F.lit(1).cast("bigint")) - 1))
            mine = ["part", "chunk", "block", "label", "shingles"]
            index = dealt(told.join(asked.select("part").distinct(), "part", "left_semi").join(known, "id"), chunks).join(blocks, "part", "left").withColumn("block", every("blocks"))
            queries = dealt(asked.join(known, "id"), blocks, count="blocks", to="block", salt=11).join(chunks, "part", "left").withColumn("chunk", every("chunks"))
            met = index.select(*mine, F.lit(False).alias("asked")).unionByName(queries.select(*mine, F.lit(True).alias("asked")))
            rounds = search_rounds(told, blocks, chunks, sets)
            for r in range(rounds):
                mine_now = met.filter(F.pmod(F.xxhash64("part", "chunk", "block", F.lit(13)), F.lit(rounds)) == r)
                third = common.settled(mine_now.groupBy("part", "chunk", "block").applyInArrow(_across(percent), edge), "across")
                links = links.unionByName(third)
    common.dropped(sets)
    # an id whose rows have different texts is one node: it ties their classes together
    tied = held.unionByName(reps.join(held.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("rep")))
    apart = tied.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("last > a").select("id", "a")
    ties = tied.join(common.settled(apart, "apart"), "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    found = common.settled(components(links.unionByName(common.settled(ties, "ties"))), "components").select(F.col("node").alias("rep"), "label")
    class_of = common.settled(classes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("label", "rep").alias("label")), "classes")
    # a row without shingles is of the node that its id's other rows are
    blank = sized.filter("n_shingles = 0").select("id").distinct()
    others = common.settled(sized.filter("n_shingles > 0").join(blank, "id", "left_semi").join(class_of, "digest").groupBy("id").agg(F.min("label").alias("node")), "others")
    common.shrink_heaps(docs.sparkSession)
    out = sized.join(class_of, "digest", "left").join(others, "id", "left").select("id", "n_shingles", F.coalesce("label", "node", "id").alias("label"))
    bare = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return out.select(bare("id").alias(id_col), "n_shingles", bare("label").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(common.table(spark, sf_dir, "documents"), n=3, percent=90)
