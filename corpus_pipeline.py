"""Corpus preparation: toxicity, line deduplication, near duplicates, benchmark decontamination, encoding.

STAGES are (name, function); a function takes (spark, docs, sf_dir), and its result is written as Parquet and read again as
the next one's docs. Each works on all rows that its predecessor kept, and all but the last return the columns of
documents. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlens.llm import common, decontaminate, line_dedup, ngram_join, pieces, toxicity


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of names that no operator uses, so that none can clash with a computed one."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows that aren't held out."""
    own, names = _renamed(docs)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(own, model, id_col=names["doc_id"], text_col=names["text"], carry=tuple(n for c, n in names.items() if c != "doc_id"))
    return scored.filter("predicted = 0").select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go everywhere but in the document of the smallest id; n_chars follows the text."""
    own, names = _renamed(docs)
    done = line_dedup.dedup_lines(own, id_col=names["doc_id"], text_col=names["text"], carry=tuple(n for c, n in names.items() if c not in ("doc_id", "text")))
    now = {"text": F.col("kept_text")}
    if "n_chars" in names:
        now["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*(now.get(c, F.col(n)).alias(c) for c, n in names.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles at 0.8 exactly one stays: the one of the smallest id.

    Every row is a document of its own, also where ids are null or repeat. A null id comes before all others; of rows of
    one id that of the smallest hash of its text stays, and of equal rows any one. Rows without shingles link with
    nothing and all stay.
    """
    unsure = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if not unsure.limit(1).count():
        found = ngram_join.link_components(docs, n=5, percent=80, in_turn=True)
        gone = found.filter("doc_id <> coalesce(component_id, doc_id) OR (component_id IS NULL AND doc_id IS NOT NULL)").select("doc_id")
        gone = common.settled(gone, "copies")
        common.shrink_heaps(spark)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # numbers of rows stand in for ids; written, so that they are the same in every pass
    rows = common.settled(docs.withColumn("_near_row", F.monotonically_increasing_id()), "rows")
    found = ngram_join.link_components(rows, n=5, percent=80, id_col="_near_row", in_turn=True).filter("n_shingles > 0").select("_near_row", "component_id")
    placed = common.settled(rows.select("_near_row", F.struct("doc_id", F.xxhash64("text").alias("th"), "_near_row").alias("place")).join(found, "_near_row"), "placed")
    first = common.settled(placed.groupBy("component_id").agg(F.min("place").alias("first")), "first")
    gone = placed.join(first, "component_id").filter("_near_row <> first._near_row").select("_near_row")
    gone = common.settled(gone, "copies")
    common.shrink_heaps(spark)
    return rows.join(gone, "_near_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go, each row judged by its own text."""
    own, names = _renamed(docs)
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    gone = common.settled(found.filter("contaminated").select("doc_id", "text_hash").distinct(), "leaks")
    common.shrink_heaps(spark)
    same = F.col(names["doc_id"]).eqNullSafe(gone["doc_id"]) & (F.xxhash64(names["text"]) == gone["text_hash"])
    return own.join(gone, same, "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of what they decode to."""
    import public_tokenizers

    common.shrink_heaps(spark)
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL has no classifier, no similarity components and no tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
