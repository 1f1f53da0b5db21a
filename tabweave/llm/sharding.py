"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_within, stage, text_of

#: Strata whose sizes are sent to all tasks.
FEW_STRATA = 10_000


def interleaved_shards(spark: SparkSession, rows: DataFrame, strata: str, key: list[str], n_shards: int, seed: int = 8) -> DataFrame:
    """Deal rows into ``n_shards`` shards that each hold every stratum in its overall share.

    Rows are shuffled by a seeded hash of ``key`` and ranked inside their stratum; rank
    ``r`` of ``n`` rows stands at ``(r + 1/2) / n`` of the corpus, and the corpus sorted by
    that fraction is cut into runs of equal length.  Adds ``shard`` (int), ``slot`` (long, the
    place inside the shard, gapless from 0).  Shard sizes differ by one row at most, and a
    stratum's rows in two shards by a few.

    A null stratum is a stratum of its own.  Repeated rows and equal texts are dealt one by
    one (a group that holds a third of all rows could not stay in one shard of equal size).
    An empty table gives an empty table; columns named ``shard`` or ``slot`` are replaced, other
    columns pass through (``_tw_stratum``, ``_tw_hash``, ``_tw_rank``, ``_tw_n``, ``_tw_fraction``
    and ``_tw_place`` are reserved), and texts of any length travel with their row.  No stratum has to fit into a task: both ranks come
    from range-partitioned sorts of narrow rows.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    dealt = rows.select(*kept).withColumn("_tw_stratum", F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit("")))
    dealt = dealt.withColumn("_tw_hash", F.xxhash64(F.lit(seed), *key))
    ranked = rank_within(spark, dealt, ["_tw_stratum"], ["_tw_hash", *key], "_tw_rank")
    sizes = stage(spark, ranked.groupBy("_tw_stratum").agg(F.count(F.lit(1)).alias("_tw_n")), "strata")
    n_strata, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_tw_n"), F.lit(0))).first()
    # One row a stratum goes to all tasks if there are few; else both sides are dealt by stratum.
    sizes = F.broadcast(sizes) if n_strata <= FEW_STRATA else sizes
    placed = ranked.join(sizes, "_tw_stratum").withColumn("_tw_fraction", (F.col("_tw_rank") + 0.5) / F.col("_tw_n"))
    placed = rank_within(spark, placed, [], ["_tw_fraction", "_tw_stratum", "_tw_rank"], "_tw_place")
    # Integer arithmetic throughout: shard k begins at the first place with place * shards >= k * rows.
    placed = placed.withColumn("shard", F.expr(f"cast(_tw_place * {n_shards}L div {max(total, 1)}L as int)"))
    placed = placed.withColumn("slot", F.expr(f"_tw_place - (shard * {total}L + {n_shards - 1}L) div {n_shards}L"))
    return placed.select(*kept, "shard", "slot")


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 16, seed: int = 8) -> DataFrame:
    """Shard ``documents``: law ``rows`` (shard counts differ by one at most).

    The text travels nowhere: its size and checksum are worked out where it is read.  A null
    text has size 1 and the checksum of the empty text.
    """
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    dealt = interleaved_shards(spark, rows, "source", ["doc_id", "text_crc32", "size"], n_shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
