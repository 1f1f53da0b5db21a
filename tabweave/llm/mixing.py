"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, rank_within, stage, text_of

#: Words that the dynamic programme fits exactly; what exceeds it is filled greedily first.
FIT_WORDS = 1 << 20


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take, for a total as near below ``budget`` as can be.

    Every length first gives the share of its documents that the budget is of all words, so
    the selection keeps the source's mix of lengths.  What is left is spent on the longest
    remaining documents down to ``fit_words``, and that rest by a bounded knapsack over the
    documents left: one bit for each reachable sum, counts split into powers of two.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return take
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left, rest = counts - take, budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= fit_words:
            break
        n = min(int(left[i]), -(-(rest - fit_words) // int(lengths[i])), rest // int(lengths[i])) if lengths[i] else 0
        take[i], left[i], rest = take[i] + n, left[i] - n, rest - n * int(lengths[i])
    items = []
    for i in order:
        n, size = (min(int(left[i]), rest // int(lengths[i])) if lengths[i] else 0), 1
        while n > 0:
            items.append((int(i), min(size, n)))
            n, size = n - size, size * 2
    mask, reached, by = (1 << (rest + 1)) - 1, 1, np.full(rest + 1, -1, np.int32)
    for k, (i, n) in enumerate(items):
        new = (reached << (n * int(lengths[i]))) & mask & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = k
            reached |= new
            if reached >> rest & 1:
                break
    at = reached.bit_length() - 1
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _weights(spark: SparkSession, sources: DataFrame, cap: int) -> DataFrame:
    """Targets by weights 1, 2, 3, 1, ... in order of the sources; none above ``cap`` sizes.

    Shares of sources at the cap are dealt anew among the others until none is above; only
    sums travel to the driver.
    """
    ranked = rank_within(spark, sources, [], ["_tw_null", "_tw_source"], "_at").withColumn("weight", (F.col("_at") % 3 + 1).cast("double"))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    limit, price = F.col("source_size") * F.lit(float(cap)), None
    while True:
        over = F.lit(False) if price is None else limit < F.col("weight") * F.lit(price)
        s = ranked.agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weights")).first()
        now = (total - s.capped) / s.weights if s.weights else 0.0
        if price is not None and now <= price:
            break
        price = now
    return ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(price))).drop("_at")


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", kind="stable")
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    copies = int(target // size) if size else 0
    rest = round(target - copies * size)
    take = fit_budget(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), rest)
    return pd.DataFrame({"_tw_source": group["_tw_source"], "_tw_null": group["_tw_null"], "size": group["size"], "source_size": group["source_size"], "target": group["target"], "_tw_copies": copies, "_tw_extra": take})


def mix_sources(spark: SparkSession, docs: DataFrame, size: Column, cap: int = 3, seed: int = 9) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words the mix takes).

    Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, ...; together they
    share all words.  A source's target is met by whole rounds over its documents plus, for
    the rest, a subset whose sizes sum to it: the source's histogram of exact sizes (one
    row for each size, whatever the number of documents) goes through :func:`fit_budget`, and
    of each size the first documents in a seeded order are selected.

    Null texts, and texts without words, have size 0 and take 0.  Repeated rows count and are
    selected one by one.  An empty table gives an empty table; columns named like a result are
    replaced, others pass through (``_tw_source``, ``_tw_null``, ``_tw_hash``, ``_tw_hash2`` and ``_tw_rank`` are
    reserved), and a text of any length is only counted.  A hot source, or one size that
    a third of all rows have, spreads over tasks (see ``rank_within``).
    """
    added = {"size", "source_size", "target", "taken", "copies"}
    base = docs.select(
        *[c for c in docs.columns if c not in added],
        size.cast("long").alias("size"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_tw_source"),
        F.col("source").isNull().alias("_tw_null"),
    )
    keys = ["_tw_null", "_tw_source", "size"]
    histogram = stage(spark, base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = histogram.groupBy("_tw_null", "_tw_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = _weights(spark, sources, cap)
    schema = "_tw_source string, _tw_null boolean, size long, source_size long, target double, _tw_copies long, _tw_extra long"
    # Dealt by a fixed number, as adaptive execution would put all sources into one task.
    dealt = histogram.join(targets, ["_tw_null", "_tw_source"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_tw_null", "_tw_source")
    fitted = dealt.groupBy("_tw_null", "_tw_source").applyInPandas(_fit_source, schema)
    plan = stage(spark, fitted, "plan")
    # Two hashes of the whole row order rows of one size; rows that tie in both are equal.
    row = [c for c, kind in base.dtypes if not kind.startswith(("map", "variant"))]
    hashed = base.withColumn("_tw_hash", F.xxhash64(F.lit(seed), *row)).withColumn("_tw_hash2", F.xxhash64(F.lit(seed + 1), *row))
    ranked = rank_within(spark, hashed, keys, ["_tw_hash", "_tw_hash2"], "_tw_rank")
    times = F.col("_tw_copies") + (F.col("_tw_rank") < F.col("_tw_extra")).cast("long")
    out = ranked.join(plan, keys).withColumn("copies", F.when(F.col("size") > 0, times).otherwise(F.lit(0).cast("long")))
    return out.select(*[c for c in docs.columns if c not in added], "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix of ``documents``; texts stay where they are read, and are counted once."""
    sizes = stage(spark, docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    return mix_sources(spark, sizes, F.col("size"))
