"""Benchmark decontamination by a prefix-filtered set join.

Method: every item is cut into windows of `window` words (a shorter item is one window). Words are ordered by rarity in
the whole corpus; a window must be contained whole, so one word is prefix enough: its rarest. Occurrences of prefix words
in documents are joined to the windows that have the word as prefix. A pair is turned down where the document is too short
on either side of the word (length and positional bounds); what is left is verified word by word over the window's own
length.

Nothing is broadcast but two filters of FILTER_BITS bits, whatever the size of the benchmark: they keep words that are in
no window away from the shuffles, and what they let through by mistake meets nothing in the joins. So documents are read
twice, once to count words and once for the occurrences, and only occurrences are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
FILTER_BITS = 1 << 23
#: Distinct words that a task holds before it hands their counts on.
FLUSH = 100_000


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def window_rows(items: DataFrame, window: int) -> DataFrame:
    """Rows (item, words), a row for each distinct window of an item, from rows (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(item_windows(common.letter_words(common.utf8(t)), window)) for t in b.column("text").to_pylist()]
            took = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column("item").take(took), pa.array([[x.decode("utf-8", "surrogatepass") for x in w] for f in found for w in f], pa.list_(pa.string()))], names=["item", "words"])

    return common.arrow_map(items, run, "item string, words array<string>")


class WordFilter:
    """Which words may be of a set, by two bits of their hashes. A bounded number of short words that aren't is remembered,
    so most of a text is told by one difference of sets."""

    KEPT, KEPT_BYTES = 250_000, 48

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tobytes()
        self.others: set[bytes] = set()

    def __contains__(self, word: bytes) -> bool:
        h = xxhash.xxh64_intdigest(word, 42)
        a, b = h % FILTER_BITS, (h >> 32) % FILTER_BITS
        return bool(self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1)

    def among(self, words: list[bytes]) -> set[bytes]:
        """Those of the words that the filter lets through."""
        new = set(words).difference(self.others)
        found = {w for w in new if w in self}
        if len(self.others) > self.KEPT:
            self.others.clear()
        self.others.update(w for w in new.difference(found) if len(w) <= self.KEPT_BYTES)
        return found


def filter_bits(words: DataFrame) -> np.ndarray:
    """The filter of a column of words: FILTER_BITS bits, made by the executors."""
    h = F.xxhash64("word")  # XXH64 of the word's bytes with seed 42, as WordFilter takes it
    places = words.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h")).select(F.shiftright(F.pmod("h", F.lit(FILTER_BITS)), 6).alias("at"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"))
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in places.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["at"]] = r.bits
    return bits.view(np.uint64)


def word_documents(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (word, n): in how many of all documents a word occurs, for the given words and perhaps some others."""
    held = texts.sparkSession.sparkContext.broadcast(filter_bits(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = WordFilter(held.value), Counter()
        out = lambda: common.batch(["word", "n"], [pa.string(), pa.int64()], [[w.decode("utf-8", "surrogatepass") for w in own], list(own.values())])
        for b in batches:
            for text in b.column("text").to_pylist():
                own.update(known.among(common.letter_words(common.utf8(text))))
            if len(own) > FLUSH:
                yield out()
                own.clear()
        yield out()

    return common.arrow_map(texts.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _occurrences(held, reach: int):
    """A row for each document and one for each occurrence of a prefix word, with up to `reach` words on its either side."""
    names, kinds = ["n_words", "word", "at", "before", "after"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFilter(held.value)
        joined = lambda words: (b" %b " % b" ".join(words) if words else b" ").decode("utf-8", "surrogatepass")
        for b in batches:
            rows, took = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = common.letter_words(common.utf8(text))
                live = known.among(words)
                found = [at for at, w in enumerate(words) if w in live] if live else []
                rows.append((len(words), None, None, None, None))
                rows += [(None, words[at].decode("utf-8", "surrogatepass"), at, joined(words[max(0, at - reach) : at]), joined(words[at + 1 : at + 1 + reach])) for at in found]
                took += [i] * (1 + len(found))
            took = pa.array(took, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(took), b.column("th").take(took), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "th", *names])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items, contaminated, text_hash), one per input row.

    text_hash, xxhash64 of the text, tells rows of one id apart. Null and empty texts have no words and no hits; null and wordless items have no windows. Equal items, and items
    that repeat a window, are all named. Rows with null or repeated ids are judged each by its own text; ids may be of any
    type that can be compared. A null item id is named "null". Either table may be empty. Other columns are ignored,
    whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    asked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    owners = common.settled(window_rows(asked, window), "owners")

    # the prefix of a window: its rarest word
    windows = owners.select("words").distinct()
    placed = windows.select("words", F.posexplode("words").alias("place", "word"))
    frequency = common.settled(word_documents(texts, placed.select("word")), "frequency")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")
    rarest = placed.join(frequency, "word", "left").groupBy("words").agg(F.min(rank).alias("rarest"))
    side = lambda part: F.when(F.size(part) == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")))
    after = F.expr("slice(words, rarest.place + 2, size(words))")
    prefixes = common.settled(rarest.select(F.col("rarest.word").alias("word"), F.col("rarest.place").alias("place"), F.size("words").alias("size"), side(F.expr("slice(words, 1, rarest.place)")).alias("head"), side(after).alias("tail"), "words"), "prefixes")

    held = docs.sparkSession.sparkContext.broadcast(filter_bits(prefixes.select("word")))
    passed = common.settled(common.arrow_map(texts, _occurrences(held, window - 1), f"id {kind}, th bigint, n_words bigint, word string, at bigint, before string, after string"), "occurrences")
    common.dropped(frequency)
    # all words before the prefix word and all behind it; blanks at both ends make the ends of strings the ends of words
    met = passed.filter("word IS NOT NULL").join(prefixes, "word").filter("at >= place AND endswith(before, head) AND startswith(after, tail)")
    hits = common.settled(met.select("id", "th", (F.col("at") - F.col("place")).alias("start"), F.col("at").alias("at"), "size", "words").distinct(), "hits")
    span = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda x, s: F.struct(F.greatest(x["end"], s["end"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], x["end"]))).alias("n"))
    covered = hits.groupBy("id", "th").agg(span.alias("spans")).select("id", "th", F.aggregate("spans", start, step, lambda x: x["n"]).alias("n_hit"))
    named = hits.select("id", "th", "words").distinct().join(owners, "words").groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    summary = covered.join(named.withColumnsRenamed({"id": "_id", "th": "_th"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("_id", "_th", "n_hit", "items")
    summary = common.settled(summary, "summary")
    common.dropped(hits, prefixes, owners)
    common.shrink_heaps(docs.sparkSession)
    rows = passed.filter("word IS NULL").select("id", "th", "n_words")
    found = rows.join(summary, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.col("th").alias("text_hash"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_force(words: list[bytes], items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> tuple[int, list[str]]:
    """The same by trying every window at every place; for tests."""
    hit, names = set(), set()
    for name, item in items:
        for w in item_windows(item, window):
            for start in range(len(words) - len(w) + 1):
                if tuple(words[start : start + len(w)]) == w:
                    hit.update(range(start, start + len(w)))
                    names.add(name)
    return len(hit), sorted(names)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
