"""Different texts without a key stay different, whatever their 32-bit hashes."""

import hashlib

from pyspark.sql import functions as F

from tabweave.llm import suffix_dedup


def colliding_texts():
    """Different texts with equal 32-bit hashes (null flag included)."""
    half = lambda i: hashlib.sha512(str(i).encode()).hexdigest()
    return [f"{half(i)} {half(i + 10**9)}" for i in (261747, 296049)]


def test_suffix_identity_is_wider_than_32_bits(spark):
    texts = colliding_texts()
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    named = docs.select(F.hash(F.col("doc_id").isNull(), F.col("text")).alias("old"), suffix_dedup._key_columns(F.col("doc_id"), F.col("text"))["_tw_k"].alias("k"))
    assert named.select("old").distinct().count() == 1 and named.select("k").distinct().count() == 2
    docs = docs.union(spark.createDataFrame([(1, texts[0])], docs.schema))
    cut = suffix_dedup.remove_repeats(spark, docs, as_text=True).collect()
    assert sorted(r.kept for r in cut) == sorted(["", "", texts[1]])
