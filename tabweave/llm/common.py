"""Things that several training-data operators share.

* :func:`small_batches` and :func:`slices` bound what a task holds of long texts.
* :func:`rank_within` ranks rows inside groups without putting a group into one task.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import scope, stage, unstage  # noqa: F401

#: Letters that the contracts lower-case; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the batches in which texts travel to Python; bounds a task's memory, whatever the texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows travel to Python in batches of ``BATCH_BYTES`` at most (or one row).

    The session's default, 64 MB, is held several times by each task: in the JVM, on its way,
    and in Python.  A smaller setting of the user's stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", str(spark.conf.get(name, "64m")).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def per_process(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once in each Python process.

    Functions of this package travel to executors by value, so its own module variables are
    new for every task; a module of our own in ``sys.modules`` lives as long as the process.
    """
    held = sys.modules.setdefault("_tabweave_process", types.ModuleType("_tabweave_process")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def lean(run: Callable, schema) -> tuple:
    """The arguments of ``mapInArrow`` for a function whose process gives its memory back.

    Worker processes are used again and again; without this, what one task has freed stays
    with its process beside what the next tasks of others need."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return trimmed, schema


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cut a batch so that a slice holds about ``most`` bytes of a column, or one row."""
    data, n = batch.column(batch.schema.get_field_index(column)), batch.num_rows
    each = max(1, n * most // max(1, data.nbytes)) if n else 1
    for at in range(0, n, each):
        yield batch.slice(at, each)


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each row but the first: has it the value (or the null) of the row before it?"""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(now, before), False)
    return pc.or_(equal, pc.and_(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)


def _rank_rows(groups: list[str]):
    """Number the rows of each run of equal group keys in a sorted partition."""

    def run(batches):
        pid, started, last, seen, first = TaskContext.get().partitionId(), False, None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in groups]
            starts = np.zeros(n, bool)
            for c in columns:
                starts[1:] |= ~_same_as_before(c)
            starts[0] = not started or tuple(c[0].as_py() for c in columns) != last
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            local = np.where(begin >= 0, np.arange(n) - begin, np.arange(n) + seen)
            in_first = np.where(begin >= 0, (begin == 0) & (not started), first)
            last, seen, first, started = tuple(c[n - 1].as_py() for c in columns), int(local[-1]) + 1, bool(in_first[-1]), True
            more = [pa.array(np.full(n, pid, np.int32)), pa.array(local.astype(np.int64)), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_tw_pid", "_tw_local", "_tw_first"])

    return run


def rank_within(spark: SparkSession, df: DataFrame, groups: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Add ``rank``: each row's place (long, from 0) among the rows with equal ``groups``.

    A window function would put a whole group into one task.  Here the rows are
    range-partitioned by group *and* order, so a hot group spreads over many partitions; each
    partition counts on its own, and only the first group of a partition can have begun
    earlier, so one offset a partition (as many rows as partitions, which is what is
    broadcast) makes the ranks global.  Without ``groups`` the rank is over all rows.  Rows
    that tie in all columns of ``order`` get different ranks in an arbitrary order.  The
    result is read from a staged table, so reruns of a lost task see the same ranks.
    """
    df = df.withColumn("_tw_all", F.lit(0)) if not groups else df
    keys = groups or ["_tw_all"]
    sort = [*groups, *order]
    schema = T.StructType([*df.schema.fields, T.StructField("_tw_pid", T.IntegerType()), T.StructField("_tw_local", T.LongType()), T.StructField("_tw_first", T.BooleanType())])
    ranked = df.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(*lean(_rank_rows(keys), schema))
    staged = stage(spark, ranked, "rank")
    group = F.struct(*keys)
    edge = F.struct(*[F.col(f) for f in order], "_tw_local")
    edges = (
        staged.groupBy("_tw_pid")
        .agg(
            F.min(F.struct(group.alias("g"), edge.alias("o"))).alias("lo"),
            F.max(F.struct(group.alias("g"), edge.alias("o"))).alias("hi"),
            F.sum(F.col("_tw_first").cast("long")).alias("n_first"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("_tw_pid")
        .collect()
    )
    offsets, open_key, length = [], None, 0
    for e in edges:
        carried = length if e.lo.g == open_key else 0
        offsets.append((e["_tw_pid"], carried))
        length = carried + e.n if e.n_first == e.n else e.hi.o["_tw_local"] + 1
        open_key = e.hi.g
    table = spark.createDataFrame(offsets, "_tw_pid int, _tw_offset long")
    return (
        staged.join(F.broadcast(table), "_tw_pid", "left")
        .withColumn(rank, F.col("_tw_local") + F.when(F.col("_tw_first"), F.coalesce("_tw_offset", F.lit(0))).otherwise(F.lit(0)))
        .drop("_tw_pid", "_tw_local", "_tw_first", "_tw_offset", "_tw_all")
    )
