"""Quality by compression: which of two dictionaries makes a text smaller?

Two zstandard dictionaries are trained on labelled text, one on good and one on bad.  A text is
compressed piece by piece with both, so that what it repeats of the dictionary, and not what it
repeats of itself, decides; (bad - good) / bytes of the sizes becomes a probability by a logistic
curve that is fitted on other labelled texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, per_process, small_batches, text_of

#: Bytes that are compressed at a time, and of a dictionary; zstandard's level.
PIECE, DICTIONARY_BYTES, LEVEL = 512, 256 << 10, 3
#: Labelled rows of a class that are read to fit the model, and pieces that a dictionary learns from.
SAMPLE_ROWS, SAMPLE_PIECES = 4_000, 40_000
#: Labelled rows with this remainder of crc32(id) mod 5 are held out: nothing is learnt from them.
FOLDS, HELD_OUT = 5, 0
#: The least score that predicts a good text.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text (empty: no compressed size tells), and the curve from
    the difference of sizes to a probability."""

    good: bytes
    bad: bytes
    base: float
    slope: float


def held_out(id: Column) -> Column:
    """Is a row held out?  A null id counts as an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def pieces_of(text: bytes) -> Iterator[bytes]:
    return (text[i : i + PIECE] for i in range(0, len(text), PIECE))


def _compressors(model: Model) -> tuple:
    import zstandard

    made = []
    for data in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=d).compress)
    return tuple(made)


def size_difference(text: str | None, good, bad) -> float:
    """(bad - good) / bytes of the compressed sizes of a whole text; 0 without a text."""
    data = (text or "").encode()
    return sum(len(bad(p)) - len(good(p)) for p in pieces_of(data)) / max(1, len(data))


def _differences(model: Model, tell: str, out: str):
    name = f"compressors {zlib.crc32(model.good)} {zlib.crc32(model.bad)} {len(model.good)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = per_process(name, lambda: _compressors(model))
        for b in batches:
            at = b.schema.get_field_index(tell)
            found = np.array([size_difference(t.as_py(), good, bad) for t in b.column(at)], float)
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(found)], names=[*[b.schema.names[i] for i in keep], out])

    return run


def differences(docs: DataFrame, model: Model) -> DataFrame:
    """The difference of sizes of each ``_tw_text``, as ``_tw_x`` in its place."""
    fields = [f for f in docs.schema.fields if f.name != "_tw_text"]
    return docs.mapInArrow(*lean(_differences(model, "_tw_text", "_tw_x"), T.StructType([*fields, T.StructField("_tw_x", T.DoubleType())])))


def train_dictionary(texts: list[bytes], seed: int = 0) -> bytes:
    """A dictionary from pieces of the texts, in a seeded order; empty if they hold too little."""
    import zstandard

    pieces = sorted((p for t in texts for p in pieces_of(t)), key=lambda p: (zlib.crc32(p, seed), p))[:SAMPLE_PIECES]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:  # too few or too much alike
        return b""


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Base and slope of a weighted logistic curve (Newton's steps, lightly held to zero)."""
    scale = float(np.std(x)) or 1.0
    a, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1] / scale)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled rows that are not held out.

    Of each class the ``SAMPLE_ROWS`` labelled ids with the smallest hash are read: two thirds of
    them (by another hash) make the dictionaries, the rest fits the curve, where each class
    counts as all its labels do.  Labels that are null, and rows without a document, teach nothing.
    If a class has too little text for a dictionary, the score of every text is the share of
    good labels (0.5 without any)."""
    small_batches(spark)
    told = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    told = told.filter(~held_out(F.col("id"))).dropDuplicates(["id"])
    many = {r.y: r.n for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(0), "id")
    chosen = told.filter("y = 0").orderBy(order, "id").limit(SAMPLE_ROWS).union(told.filter("y = 1").orderBy(order, "id").limit(SAMPLE_ROWS))
    texts = docs.select(F.col(f"`{id}`").alias("id"), text_of(F.col(f"`{text}`")).alias("_tw_text"))
    # The sample has a fixed size: it goes to all tasks, and the documents stay where they are.
    rows = texts.join(F.broadcast(chosen), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)))
    learnt: dict[int, list[bytes]] = {0: [], 1: []}
    # Only the pieces that a dictionary may learn from come to the driver.
    size = F.octet_length("_tw_text")
    piece = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / PIECE).cast("int"))).alias("k")
    pieces = rows.filter("fold < 2").select("y", F.col("_tw_text").cast("binary").alias("t"), piece).select("y", F.substring(F.col("t"), F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    for y in (0, 1):
        found = pieces.filter(F.col("y") == y).orderBy(F.crc32("piece"), "piece").limit(SAMPLE_PIECES)
        learnt[y] = [bytes(r.piece) for r in found.select("piece").collect()]
    good, bad = (train_dictionary(learnt[y]) for y in (1, 0))
    share = (many.get(1, 0) + 1) / (sum(many.values()) + 2)
    nothing = Model(b"", b"", math.log(share / (1 - share)), 0.0)
    if not good or not bad:
        return nothing
    seen = sorted((r.y, r["_tw_x"]) for r in differences(rows.filter("fold = 2").select("y", "_tw_text"), Model(good, bad, 0.0, 0.0)).collect())
    y, x = np.array([r[0] for r in seen], float), np.array([r[1] for r in seen], float)
    if not (0 < y.sum() < len(y)):
        return nothing
    weight = np.where(y == 1, many[1] / y.sum(), many[0] / (len(y) - y.sum()))
    return Model(good, bad, *fit_curve(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, held_out, score, predicted): the probability that each whole text is good.

    A null text counts as empty, and an empty one has no difference: its score is that of a
    text which both dictionaries fit alike.  Rows are scored one by one, so equal texts have
    equal scores; no other column is read."""
    rows = docs.select(F.col(f"`{id}`").alias("_tw_id"), text_of(F.col(f"`{text}`")).alias("_tw_text"))
    told = differences(rows, model) if model.good else rows.select("_tw_id", F.lit(0.0).alias("_tw_x"))
    chance = 1 / (1 + F.exp(-F.greatest(F.least(F.lit(model.base) + F.lit(model.slope) * F.col("_tw_x"), F.lit(500.0)), F.lit(-500.0))))
    return told.select(F.col("_tw_id").alias(id), held_out(F.col("_tw_id")).alias("held_out"), chance.alias("score"), (chance >= THRESHOLD).cast("int").alias("predicted"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Fit a model and score every document with it."""
    small_batches(spark)
    return score(docs, fit(spark, docs, labels, id, text, label), id, text)
