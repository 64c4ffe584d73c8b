"""Toxicity by a counterfactual-regularised linear classifier.

Method: logistic regression on hashed word and character-gram features, with a penalty on score changes under
counterfactuals. In each sentence of the labelled sample every identity term is swapped for each other term of its kind;
the sentence is scored as it stands and as swapped, and the squared change of its margin is part of the loss. So a mention
of a group as such carries no evidence, and neutral mentions aren't rejected for it.

Fitting takes a bounded sample (SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows, those of the smallest hash of their id, whatever
the corpus' size); scoring passes over every whole text. The only broadcast is the weight vector, of fixed size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 18
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 6000
THRESHOLD = 0.7
STEPS, RATE, L2, SWAP = 200, 0.25, 3e-5, 1.0
#: A feature must differ by so many standard errors, and be in so many sampled documents.
SCREEN, LEAST_DOCUMENTS = 5.0, 4
#: Words remembered while scoring, and their longest; unspaced scripts have runs as long as a text, which hardly recur.
KEPT_WORDS, KEPT_BYTES = 300_000, 64

#: Terms that name groups, by kind, in the corpus' languages; a parameter of fit().
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish", "polish"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("deutsche", "türken", "russen", "polen", "franzosen", "amerikaner", "chinesen"),
    ("flüchtlinge", "einwanderer", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("français", "allemands", "russes", "turcs", "polonais", "américains", "chinois"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("españoles", "mexicanos", "alemanes", "rusos", "turcos", "franceses", "chinos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word: itself and the 5-grams of all its bytes with marks at both ends.

    A word of an unspaced script can be a whole text; its features are gathered as hashes, DIMENSIONS at most.
    """
    padded = b"<" + word + b">"
    grams = {zlib.crc32(padded[i : i + 5]) % DIMENSIONS for i in range(len(padded) - 4)} if len(padded) > 5 else set()
    return [zlib.crc32(b"=" + word) % DIMENSIONS, *sorted(grams)]


def document_features(text: str | None) -> np.ndarray:
    """The features that a text has, each once."""
    return np.array(sorted({f for w in set(common.letter_words(common.utf8(text))) for f in word_features(w)}), np.int32)


class Model:
    """Weights of the features that matter; scoring remembers what a word brings."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def margin(self, text: str | None) -> float:
        found: set[int] = set()
        kept = self.kept
        for w in set(common.letter_words(common.utf8(text))):
            live = kept.get(w)
            if live is None:
                live = tuple(f for f in word_features(w) if f in self.weights)
                if len(w) <= KEPT_BYTES:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = live
            if live:
                found.update(live)
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.margin(text)))))


def _kinds(terms: tuple[tuple[str, ...], ...]) -> dict[bytes, list[bytes]]:
    """Each term's alternatives: the other terms of its kinds."""
    out: dict[bytes, list[bytes]] = {}
    for kind in terms:
        for t in kind:
            out.setdefault(t.encode(), []).extend(o.encode() for o in kind if o != t)
    return out


def counterfactuals(text: str | None, kinds: dict[bytes, list[bytes]]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Each sentence of a text that mentions a term, as its words, with the same words after one term's swap."""
    if kinds.keys().isdisjoint(common.letter_words(common.utf8(text))):
        return
    for sentence in re.split(r"[.!?\n]+", text or ""):
        words = common.letter_words(common.utf8(sentence))
        for term in sorted(kinds.keys() & set(words)):
            for other in kinds[term]:
                yield words, [other if w == term else w for w in words]


def change(before: list[bytes], after: list[bytes]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The features that a sentence loses and gains by its swap. What both have, such as a gram that another word also
    holds, changes no score."""
    lost = {f for w in set(before) for f in word_features(w)}
    gained = {f for w in set(after) for f in word_features(w)}
    return tuple(sorted(lost - gained)), tuple(sorted(gained - lost))


def screened(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features' share differs between the classes by more than chance gives among all of them (z > SCREEN)."""
    share = (toxic + clean + 1) / (n1 + n0 + 2)
    z = (toxic / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (np.abs(z) > SCREEN) & (toxic + clean >= LEAST_DOCUMENTS)


Swaps = dict[tuple[tuple[int, ...], tuple[int, ...]], float]


def train(documents: list[np.ndarray], labels: np.ndarray, swaps: Swaps, swap: float = SWAP) -> Model:
    """Minimise class-balanced log loss + L2 + swap * mean squared change of the margin over the counterfactuals, by
    full-batch Adam. `swaps` has how often a sentence lost and gained certain features when one of its terms was swapped.

    With one class only, the score is that class's; with no rows it is a half.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model({}, 0.0 if not len(labels) else (4.0 if labels[0] else -4.0))
    counts = [np.bincount(np.concatenate([d for d, y in zip(documents, labels, strict=True) if y == c]), minlength=DIMENSIONS) for c in (1, 0)]
    names = np.flatnonzero(screened(*counts, int(labels.sum()), int(len(labels) - labels.sum())))
    place = np.full(DIMENSIONS, -1, np.int64)
    place[names] = np.arange(len(names))
    live = [found[found >= 0] for found in (place[d] for d in documents)]
    rows = np.repeat(np.arange(len(live)), [len(d) for d in live])
    ids = np.concatenate(live)
    y = labels.astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    # the changes as a sparse matrix: which counterfactual, which feature, gained or lost
    pair, name, sign, share = [], [], [], []
    for n, ((lost, gained), times) in enumerate(sorted(swaps.items())):
        share.append(times)
        for found, s in ((lost, -1.0), (gained, 1.0)):
            mine = place[list(found)] if found else np.zeros(0, np.int64)
            mine = mine[mine >= 0]
            pair += [n] * len(mine)
            name += mine.tolist()
            sign += [s] * len(mine)
    pairs, touched, signs = np.array(pair, np.int64), np.array(name, np.int64), np.array(sign)
    shares = np.array(share) / max(1.0, sum(share))
    w, bias = np.zeros(len(names)), 0.0
    m1, m2, b1, b2 = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        margin = bias + np.bincount(rows, weights=w[ids], minlength=len(documents))
        pull = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        grad = np.bincount(ids, weights=pull[rows], minlength=len(names)) + L2 * w
        if len(pairs):
            moved = np.bincount(pairs, weights=signs * w[touched], minlength=len(shares))
            grad += np.bincount(touched, weights=2 * swap * (shares * moved)[pairs] * signs, minlength=len(names))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * pull.sum(), 0.99 * b2 + 0.01 * pull.sum() ** 2
        rate = RATE * (1 - t / (STEPS + 1))
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-4)
        bias -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-4)
    return Model({int(n): float(x) for n, x in zip(names, w, strict=True)}, float(bias))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text leaves 1 on division by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def _sampled(terms: tuple[tuple[str, ...], ...]):
    kinds = _kinds(terms)
    swap = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [[dict(zip(("lost", "gained"), change(*x), strict=True)) for x in counterfactuals(t, kinds)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([document_features(t) for t in texts], pa.list_(pa.int32())), pa.array(found, pa.list_(swap))], names=["toxic", "features", "swaps"])

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, DIMENSIONS), np.int64)
    for b in batches:
        for y, f in zip(b.column("toxic").to_pylist(), b.column("features"), strict=True):
            counts[1 - y, f.values.to_numpy()] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["feature", "n1", "n0"])


def _screened_rows(live):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(DIMENSIONS, bool)
        flags[live.value] = True
        kept = lambda found: [f for f in found if flags[f]]
        for b in batches:
            features = [kept(f) for f in b.column("features").to_pylist()]
            moved = [[{"lost": kept(s["lost"]), "gained": kept(s["gained"])} for s in row] for row in b.column("swaps").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(features, pa.list_(pa.int32())), pa.array(moved, b.schema.field("swaps").type)], names=["toxic", "features", "swaps"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN), swap: float = SWAP, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """Learn from labelled rows that aren't held out: at most sample[0] toxic and sample[1] clean ones.

    Of several labels of one id the highest counts; null labels and ids without a document are left out; ties in the hash
    that chooses the sample are broken by the id. The sample is bounded before any text is read; features are screened
    where it lies, so what comes to the driver is the screened features of at most that many rows, and how often
    sentences lost and gained them when a term was swapped.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    ordered = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = ordered(1, sample[0]).unionByName(ordered(0, sample[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("toxic", "text")
    # written by all tasks at once, then read a few parts at a time
    written = common.settled(common.arrow_map(texts, _sampled(terms), "toxic int, features array<int>, swaps array<struct<lost:array<int>,gained:array<int>>>"), "sample")
    taken = written.coalesce(4)
    sizes = {r.toxic: r.n for r in taken.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if len(sizes) < 2:
        return train([], np.array([*sizes], np.int64), {}, swap)
    counts = np.zeros((2, DIMENSIONS), np.int64)
    for r in common.arrow_map(taken, _tallied, "feature bigint, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(F.col("n1") + F.col("n0") >= LEAST_DOCUMENTS).toLocalIterator():
        counts[:, r.feature] = r.n1, r.n0
    live = np.flatnonzero(screened(counts[0], counts[1], sizes[1], sizes[0]))
    left = common.arrow_map(taken, _screened_rows(docs.sparkSession.sparkContext.broadcast(live)), "toxic int, features array<int>, swaps array<struct<lost:array<int>,gained:array<int>>>")
    left = common.settled(left, "screened")
    rows = sorted((r.toxic, r.features) for r in left.select("toxic", "features").toLocalIterator())
    changes = left.select(F.explode("swaps").alias("swap")).groupBy("swap.lost", "swap.gained").agg(F.count(F.lit(1)).alias("n"))
    swaps = {(tuple(r.lost), tuple(r.gained)): float(r.n) for r in changes.toLocalIterator()}
    common.dropped(left, written)
    return train([np.array(x, np.int64) for _, x in rows], np.array([y for y, _ in rows], np.int64), swaps, swap)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, *carry), one per input row.

    Null and empty texts have the score of no evidence. Null and repeated ids are scored each by itself; ids may be of any
    type. `carry` names columns to pass through, which must not be named like a computed one; other columns are ignored,
    whatever their names.
    """
    common.shrink_heaps(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "text"), pa.array([own.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=[*(n for n in b.schema.names if n != "text"), "score"])

    source = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(text_col).alias("text"))
    extra = "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    scored = common.arrow_map(source, run, f"_id {kinds[id_col]}{extra}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
