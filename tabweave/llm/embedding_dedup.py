"""Embedding near-dedup: an exact metric range join in cells around pivots.

Unit vectors with cosine at least ``t`` are at most ``r = sqrt(2 - 2 t)`` apart.  Every
vector's home is the cell of its nearest pivot.  By the triangle inequality it can have a
partner at home in another cell only if it is within ``r`` of what that cell reaches: of the
cell's radius around its pivot, and of the plane half-way between the two pivots.  It is
replicated to those cells (to those before its own, so that each pair meets once), and then
cells join independently, as matrix products of blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, unstage
from .graph import components

THRESHOLD = 0.93
#: Vectors for each pivot; how many pivots, and how many numbers in them, are sent to all tasks at most.
VECTORS_PER_PIVOT, MAX_PIVOTS, MAX_VALUES = 256, 1 << 15, 1 << 22
#: Pivots are halved until vectors visit so many cells on average, by a sample of so many vectors:
#: where the triangle inequality prunes little, more cells only mean more copies.
MOST_VISITS, PROBES = 4.0, 1024
#: A cell is cut into this many chunks, of a size within the bounds; pairs of chunks are blocks.
CHUNKS, LEAST_CHUNK, MOST_CHUNK = 16, 512, 1 << 14
TILE = 512
#: Bytes of the five matrices of vectors by pivots that a worker holds, and of a chunk's vectors.
MATRIX_BYTES, CHUNK_BYTES = 64 << 20, 64 << 20
#: Rounding of distances; being generous here only replicates more.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Neither null nor zero, all components present and finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors (double) of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


class Pivots:
    """Pivots by part (label and length of vector): (cells, unit vectors); cells are numbered
    over all parts.  Holds nothing but that, so it grows with the number of pivots only."""

    def __init__(self, parts: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float):
        self.parts, self.reach = parts, math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    @staticmethod
    def parts_of(rows: list[tuple[str, list[float]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        by_part: dict[str, list[tuple[int, np.ndarray]]] = {}
        for i, (part, v) in enumerate(rows):
            v = np.asarray(v, np.float64)
            v = v / np.abs(v).max()
            by_part.setdefault(part, []).append((i, v / np.linalg.norm(v)))
        return {part: (np.array([i for i, _ in found]), np.stack([v for _, v in found])) for part, found in by_part.items()}

    def rows_at_once(self, part: str) -> int:
        """So many vectors that their matrices with all pivots of the part stay within ``MATRIX_BYTES``."""
        n = len(self.parts[part][0]) if part in self.parts else 1
        return max(1, min(2048, MATRIX_BYTES // (5 * 8 * n)))

    def home(self, part: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot; cell -1 for a part without pivots."""
        if part not in self.parts:
            return np.full(len(x), -1), np.zeros(len(x))
        cells, at = self.parts[part]
        dots = x @ at.T
        near = dots.argmax(axis=1)
        return cells[near], np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), near]))

    def visits(self, part: str, x: np.ndarray, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells before its home that a vector has to be replicated to; without
        the cells' radius, those on this side of its reach beyond the half-way planes."""
        if part not in self.parts:
            return np.empty(0, int), np.empty(0, int)
        cells, at = self.parts[part]
        dots = x @ at.T
        near = dots.argmax(axis=1)
        homes, own = np.unique(near, return_inverse=True)
        gaps = np.sqrt(np.maximum(0, 2 - 2 * at[homes] @ at.T))
        # Twin pivots have no plane between them: a distance of zero rules nothing out.
        to_plane = (dots[np.arange(len(x)), near][:, None] - dots) / np.where(gaps > 0, gaps, np.inf)[own]
        go = (to_plane <= self.reach) & (np.arange(len(cells))[None, :] < near[:, None])
        if radius is not None:
            go &= np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius[cells][None, :] + self.reach
        row, k = np.nonzero(go)
        return row, cells[k]


def choose_pivots(sample: list[tuple[str, list[float]]], probes: list[tuple[str, list[float]]], threshold: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """As many of the sampled pivots as keep the probes' visits within ``MOST_VISITS``."""
    tests = Pivots.parts_of(probes)
    while True:
        parts = Pivots.parts_of(sample)
        pivots = Pivots(parts, threshold)
        visits = 0
        for part, (_, x) in tests.items():
            step = pivots.rows_at_once(part)
            visits += sum(len(pivots.visits(part, x[at : at + step], None)[0]) for at in range(0, len(x), step))
        if visits <= MOST_VISITS * len(probes) or len(sample) <= 1:
            return parts
        sample = sample[: len(sample) // 2]


def _parts(batch: pa.RecordBatch, pivots: Pivots):
    """Rows of a batch by part: (part, row numbers, unit vectors)."""
    names = np.array(batch.column(batch.schema.get_field_index("part")).to_pylist(), dtype=object)
    vectors = batch.column(batch.schema.get_field_index("vector"))
    for part in dict.fromkeys(names):
        rows = np.flatnonzero(names == part)
        step = pivots.rows_at_once(part)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield part, some, unit_rows(vectors.take(pa.array(some)))


def _homes(shared, threshold: float):
    """(part, cell, radius, n) of a batch's vectors; the part is told only where it has no pivots."""

    def run(batches):
        pivots = Pivots(shared.value, threshold)
        for b in batches:
            for part, _, x in _parts(b, pivots):
                cell, far = pivots.home(part, x)
                found = pd.DataFrame({"cell": cell, "far": far}).groupby("cell").far.agg(["max", "size"]).reset_index()
                names = pa.array([part if c < 0 else None for c in found["cell"]], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(found["cell"].to_numpy(np.int32)), pa.array(found["max"].to_numpy(float)), pa.array(found["size"].to_numpy(np.int64))], names=["part", "cell", "radius", "n"])

    return run


def _visitors(shared, threshold: float, radius: np.ndarray):
    def run(batches):
        pivots = Pivots(shared.value, threshold)
        for b in batches:
            for part, _, x in _parts(b, pivots):
                cell, n = np.unique(pivots.visits(part, x, radius)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def _most(longest: int) -> int:
    """Vectors of a chunk at most, by their number and their bytes."""
    return max(1, min(MOST_CHUNK, CHUNK_BYTES // (8 * longest)))


def _chunks(n: int, most: int) -> int:
    return max(1, math.ceil(n / min(most, max(LEAST_CHUNK, n / CHUNKS))))


def _deal(shared, threshold: float, radius: np.ndarray, home_chunks: np.ndarray, visit_chunks: np.ndarray, undivided: dict[str, int]):
    """Each vector once for every block that it takes part in."""

    def run(batches):
        pivots = Pivots(shared.value, threshold)
        for b in batches:
            ids = b.column(b.schema.get_field_index("c")).to_numpy(zero_copy_only=False)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for part, rows, x in _parts(b, pivots):
                cell, _ = pivots.home(part, x)
                out: list[tuple[int, int, int, int, int]] = []  # row, cell, block's two chunks, side
                for k, c in enumerate(cell):
                    homes, visitors = (undivided.get(part, 1), 0) if c < 0 else (home_chunks[c], visit_chunks[c])
                    own = int(mixed[rows[k]] % np.uint64(homes))
                    out += [(rows[k], c, own, j, 0) for j in range(own, homes)]
                    out += [(rows[k], c, i, own, 1) for i in range(own)]
                    out += [(rows[k], c, own, -1 - d, 0) for d in range(visitors)]
                for k, c in zip(*pivots.visits(part, x, radius), strict=True):
                    d = int(mixed[rows[k]] % np.uint64(visit_chunks[c]))
                    out += [(rows[k], c, i, -1 - d, 1) for i in range(home_chunks[c])]
                for at in range(0, len(out), 20_000):
                    row, c, i, j, side = np.array(out[at : at + 20_000], np.int64).T
                    moved = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*moved.columns, *(pa.array(v.astype(np.int32)) for v in (c, i, j, side))], names=[*b.schema.names, "cell", "i", "j", "side"])

    return run


def _join_block(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, m, side = (table.column(n).to_numpy() for n in ("c", "m", "side"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks)
        x = unit_rows(vectors)
        inside = key[2] == key[3]
        left = np.arange(len(ids)) if inside else np.flatnonzero(side == 0)
        right = left if inside else np.flatnonzero(side == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = rank.copy()
        tiles = []
        for at in range(0, len(left), TILE):
            rows = left[at : at + TILE]
            near = x[rows] @ x[right].T >= threshold
            if inside:
                near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
            links[rows] += near @ m[right]
            if not inside:
                links[right] += m[rows] @ near
            if near.any():
                a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                tiles.append((rows[a], right[b], np.packbits(near[np.ix_(a, b)], axis=1), len(b)))
        moved = True
        while moved:
            before = label.copy()
            for a, b, bits, n in tiles:
                near = np.unpackbits(bits, axis=1, count=n).astype(bool)
                low = np.where(near, label[b][None, :], len(ids)).min(axis=1)
                label[a] = np.minimum(label[a], low)
                low = np.where(near, label[a][:, None], len(ids)).min(axis=0)
                label[b] = np.minimum(label[b], low)
            moved = (label != before).any()
        some, child = np.flatnonzero(links), np.flatnonzero(label != rank)
        return pa.table(
            {
                "c": pa.array(np.concatenate([ids[some], ids[child]]), pa.int64()),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(child), np.int64)]), pa.int64()),
                "root": pa.array([None] * len(some) + ids[order][label[child]].tolist(), pa.int64()),
            }
        )

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, per_pivot: int = VECTORS_PER_PIVOT) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other
    vectors of its label with cosine at least ``threshold``), component_id and kept.

    Null labels, null or zero vectors and vectors with null or non-finite components link
    with nothing, as do rows with a null vec_id; vectors of different lengths never link.
    Equal vectors of a label form a class first (named by 128 bits of label and vector), so a
    group of copies is one row in the join, and each copy counts the others.  Repeated rows
    are vectors of their own, and so are rows that share a vec_id and differ.  An empty table
    gives an empty table; other columns are not read.

    Pivots are a sample (the classes with the smallest hashes) of ``1 / per_pivot`` of the
    classes, ``MAX_PIVOTS`` and ``MAX_VALUES`` numbers at most, and fewer where they would
    not prune (see :func:`choose_pivots`); the sample decides the cells' sizes, never the
    result.  A cell, and a label without pivots, is cut into chunks and joined block by block;
    a block gives counts and a spanning forest of its links, never its pairs.
    """
    part = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    ok = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), part.alias("part"), ok.alias("ok"))
    fine = rows.filter("ok").select("vec_id", "vector", "part", F.xxhash64("part", "vector").alias("h1"), F.xxhash64(F.lit(1), "part", "vector").alias("h2"))
    grouped = fine.groupBy("h1", "h2").agg(F.first("part").alias("part"), F.first("vector").alias("vector"), F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("m"))
    classes = stage(spark, grouped.withColumn("c", F.monotonically_increasing_id()), "vectors")
    n, longest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    most, chunk = max(1, min(MAX_PIVOTS, MAX_VALUES // longest, n // per_pivot)), _most(longest)
    sample = [(r.part, r.vector) for r in classes.select("part", "vector", "h1", "h2").orderBy("h1", "h2").limit(most + PROBES).collect()]
    chosen = choose_pivots(sample[:most], sample[most:], threshold)
    shared, n_cells = spark.sparkContext.broadcast(chosen), 1 + max((int(cells.max()) for cells, _ in chosen.values()), default=-1)
    narrow = classes.select("c", "part", "vector", "m")
    radius, homes, visits = np.zeros(n_cells), np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
    found = narrow.mapInArrow(*lean(_homes(shared, threshold), "part string, cell int, radius double, n long"))
    found = stage(spark, found.groupBy("part", "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")), "homes")
    for r in found.filter("cell >= 0").collect():
        radius[r.cell], homes[r.cell] = r.radius, r.n
    # Of labels without pivots only those that have to be cut are told: one for a chunk of vectors at most.
    undivided = {r.part: _chunks(r.n, chunk) for r in found.filter((F.col("cell") < 0) & (F.col("n") > chunk)).collect()}
    for r in narrow.mapInArrow(*lean(_visitors(shared, threshold, radius), "cell int, n long")).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visits[r.cell] = r.n
    home_chunks = np.array([_chunks(k, chunk) for k in homes], np.int64)
    visit_chunks = np.array([_chunks(k, chunk) if k else 0 for k in visits], np.int64)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    dealt = narrow.mapInArrow(*lean(_deal(shared, threshold, radius, home_chunks, visit_chunks, undivided), f"{kinds}, cell int, i int, j int, side int"))
    joined = dealt.groupBy("part", "cell", "i", "j").applyInArrow(_join_block(threshold), "c long, links long, root long")
    joined = stage(spark, joined, "block-links")
    counts = joined.filter("root is null").groupBy("c").agg(F.sum("links").alias("links"))
    linked = components(spark, joined.filter("root is not null").select(F.col("root").alias("a"), F.col("c").alias("b")))
    placed = classes.join(counts, "c", "left").join(linked, F.col("c") == F.col("node"), "left")
    placed = stage(spark, placed.select("h1", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "c").alias("g")), "placed")
    names = stage(spark, placed.groupBy("g").agg(F.min("id").alias("component_id")), "names")
    placed = stage(spark, placed.join(names, "g").select("h1", "h2", "n_links", "component_id"), "named")
    linked = fine.select("vec_id", "h1", "h2").join(placed, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for df in (found, joined, names):
        unstage(spark, df)
    return linked.union(alone)
