"""A corpus pipeline over ``documents``; each stage's result is written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.  An empty table
gives an empty one; columns that a stage does not read pass through (names that begin with
``_tw_`` are reserved, others as each operator states); texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import bpe, mixing, quality, shingles, suffix_dedup
from tabweave.llm.common import scope, stage, unstage
from tabweave.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; the share of stop words, judged in languages that
    have a list, stands in for op6's rule that there is one, and stray symbols count too.

    A null or empty text has no words and goes.  Rows are judged one by one, repeated ones alike;
    a null language counts as one that has a list.
    """
    rules = (*[r for r in quality.THRESHOLDS if r[0] != "long_text_without_stop_words"], *quality.RATIOS)
    return quality.quality_rules(docs, thresholds=rules, lang="lang").filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Near copies share at least 0.8 of their five-word shingles (Jaccard).  SimHash fingerprints of these
    are linked by op2's ball hashing and checked exactly; as its balls cannot reach all such pairs, the
    shingle sets are then joined exactly, too, so that none is lost.  Null and empty texts
    are copies of each other; rows without a doc_id come last, and rows that share one are judged
    by their texts; of rows equal in both one stays.
    """
    return shingles.keep_one(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that stand elsewhere too go, wherever they stand; documents stay with
    what remains, which may be an empty text.

    A null text becomes an empty one.  Null and repeated doc_ids do not matter: rows are named by
    their texts too, and a row that stands twice is a repeat of itself.
    """
    cut = suffix_dedup.remove_repeats(spark, docs, as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (documents without words, or with a null text: not
    at all).  A null source is a source of its own; of documents that tie in length the first in
    a seeded order are taken, and repeated rows count one by one.
    """
    mixed = mixing.mix_sources(spark, docs, mixing.word_count())
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_tw_copy")
    return mixed.filter("copies > 0").select(*docs.columns, times).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text decoded from them; a null text has none and becomes an
    empty one.  Rows are encoded one by one, repeated ones alike; columns named ``ids``,
    ``n_tokens`` or ``decoded`` are replaced.
    """
    ranks, pattern = vocabulary()
    tokens = bpe.encode(spark, docs, ranks, pattern, decoded="decoded")
    return tokens.select(*[F.col("decoded").cast("string").alias(c) if c == "text" else c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup by SimHash and shingle sets", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", mixing_sources),
    ("byte-level BPE", byte_level_bpe),
]

#: Fingerprints, knapsacks and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before = docs
        with scope(spark, lambda: [docs]):  # once a stage is written, nothing reads what it has staged
            docs = stage(spark, step(spark, before, sf_dir), name.replace(" ", "-").lower())
        unstage(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
