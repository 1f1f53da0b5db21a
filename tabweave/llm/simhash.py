"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, small_batches, stage, text_of
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Shingles that are hashed and counted at a time.
BLOCK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of some 64-bit hashes; of none, none is."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the XXH64 of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Replace ``text`` by ``out``, its 64 bits as a (signed) long; a null text is empty."""
    rest = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "_text")):
            made = [fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(made, np.uint64).view(np.int64))], names=[*b.schema.names[:-1], out])

    return docs.select(*[f.name for f in rest], text_of(text).alias("_text")).mapInArrow(*lean(run, T.StructType([*rest, T.StructField(out, T.LongType())])))


def ball(fp: str, radius: int):
    """Array of all values that differ from a long column in at most ``radius`` bits."""
    bits = [F.lit(-(1 << 63) if i == 63 else 1 << i) for i in range(64)]
    if radius < 2:
        return F.array(F.col(fp), *[F.col(fp).bitwiseXOR(b) for b in bits[: 64 * radius]])
    turned, values = F.array(*bits), F.array(F.col(fp))
    for _ in range(radius):
        values = F.array_distinct(F.flatten(F.transform(values, lambda v: F.concat(F.array(v), F.transform(turned, lambda b: v.bitwiseXOR(b))))))
    return values


def link_classes(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ``id`` of rows whose ``fp`` (all different) are near, for any radius.

    Each fingerprint emits every variant within half the radius; two fingerprints within the
    radius share one.  A variant's bucket holds at most as many fingerprints as a ball has values (65
    for a radius of 2), whatever the data.  All of a bucket are within an even radius, so each is linked
    with the one before it in its bucket, which connects the bucket.  Of an odd radius one side emits
    the larger half, and all pairs of the two sides that meet are verified.
    """
    if radius % 2:
        small, large = (classes.select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}"), F.explode(ball("fp", radius // 2 + k)).alias("variant")) for k, x in enumerate("ab"))
        met = small.join(large, "variant").filter("a <> b")
        near = met.filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return near.distinct()
    variants = classes.select("id", "fp", F.explode(ball("fp", radius // 2)).alias("variant"))
    before = Window.partitionBy("variant").orderBy("fp")
    pairs = variants.select("id", "fp", F.lag("id").over(before).alias("other"), F.lag("fp").over(before).alias("other_fp"))
    near = pairs.filter(F.col("other").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius))
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (long) and ``component_id``, the smallest key linked to the row.

    Texts with equal fingerprints form a class first (a group of copies, however large, is
    one row from then on); classes are linked by :func:`link_classes`, and links are followed
    to the end.  Null and empty texts have fingerprint 0 and are linked like others; repeated
    rows are one class and each is returned; a null key never is the smallest one unless its
    class has no other (component_id is null then); an empty table gives an empty table;
    other columns are not read, so their names do not matter.
    """
    small_batches(spark)
    marked = stage(spark, fingerprints(docs.select(key, text), text), "fingerprints")
    classes = stage(spark, marked.groupBy("fp").agg(F.min(key).alias("id")), "classes")
    keyed = classes.filter(F.col("id").isNotNull())
    found = components(spark, link_classes(keyed))
    placed = keyed.join(found, keyed["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    placed = stage(spark, placed, "components")
    return marked.join(placed, "fp", "left").select(key, "fp", "component_id")


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = near_duplicates(spark, docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
