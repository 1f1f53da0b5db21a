"""Connected components of links, without collecting links or components anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, unstage


def _local_stars(batches):
    """Replace the links of a batch by stars with the same components (union-find)."""
    for b in batches:
        ends = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) if b.num_rows else np.empty((2, 0), np.int64)
        nodes, at = np.unique(ends, return_inverse=True)
        label, (x, y) = np.arange(len(nodes)), at.reshape(2, -1)
        while True:
            low = np.minimum(label[x], label[y])
            before = label.copy()
            for side in (x, y):
                np.minimum.at(label, label[side], low)
                np.minimum.at(label, side, low)
            label = label[label]
            if (label == before).all():
                break
        kept = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[kept]].astype(np.int64)), pa.array(nodes[kept].astype(np.int64))], names=["a", "b"])


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b: long) but the smallest of
    its component; ``component`` is that smallest node.

    Rounds of large-star and small-star: every node's larger neighbours are attached to the
    smallest, then its smaller neighbours are.  Each round's table is written to the shared
    folder; joins are plain equi-joins of written tables, so that adaptive execution splits
    the partition of a node that very many others point to.  No links give no rows.
    """
    edges = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a < b")
    edges = stage(spark, edges.mapInArrow(*lean(_local_stars, "a long, b long")), "links")
    state = None
    for _ in range(max_rounds):
        # Large star: every node hands its larger neighbours to its smallest neighbour.
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = stage(spark, both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u"), "large-min")
        # Nodes that are their own smallest keep their links as they are.
        moved = edges.join(least, edges["a"] == least["u"], "left").select(F.coalesce("m", "a").alias("a"), "b")
        new = stage(spark, moved.distinct(), "large")
        for df in (least, edges):
            unstage(spark, df)
        # Small star: every node hands its smaller neighbours, and itself, to the smallest.
        least = stage(spark, new.groupBy("b").agg(F.min("a").alias("m")), "small-min")
        other = new.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stage(spark, least.select(F.col("m").alias("a"), "b").union(other).distinct().mapInArrow(*lean(_local_stars, "a long, b long")), "small")
        for df in (least, new):
            unstage(spark, df)
        s = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(s) == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        state = tuple(s)
    raise RuntimeError("components have not settled")
