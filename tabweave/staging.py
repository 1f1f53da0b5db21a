"""Tables written to the cluster's shared folder to cut lineage, or to be read more than once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session that names no shared folder and has no executors but itself, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a session names none, ``LOCAL_DIR`` stands in only if all runs in one process; on a
    cluster executors would not see each other's files, so there it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DIR


def _place(spark: SparkSession, path: str):
    """The path and its file system, through Hadoop, so that any store works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, store = _place(spark, path)
    return store.exists(target)


def new_path(spark: SparkSession, label: str) -> str:
    """A folder in the shared one that is deleted when the driver's JVM ends, whether the
    session was stopped before or not."""
    path = f"{shared_dir(spark)}/tabweave-{label}-{uuid.uuid4().hex}"
    target, store = _place(spark, path)
    store.deleteOnExit(target)
    return path


def write_bytes(spark: SparkSession, data: bytes, label: str) -> str:
    """A file of the shared folder with these bytes; returns its path."""
    target, store = _place(spark, new_path(spark, label))
    out = store.create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return target.toString()


#: Paths of tables that were staged since each open scope began.
_OPEN: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession, keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Tables that are staged inside are freed at the end, but for those of ``keep``.

    For work whose result is written inside the scope: what is still lazy may read them."""
    _OPEN.append([])
    try:
        yield
    finally:
        made = _OPEN.pop()
        kept = {getattr(df, "staged_path", None) for df in keep()}
        for path in made:
            if path not in kept:
                drop_path(spark, path)
            elif _OPEN:
                _OPEN[-1].append(path)


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark has written into a folder, in the order of their partitions."""
    target, store = _place(spark, path)
    found = [f.getPath() for f in store.listStatus(target) if f.isFile() and re.match(r"part-\d+", f.getPath().getName())]
    return [f.toString() for f in sorted(found, key=lambda f: (int(re.match(r"part-(\d+)", f.getName())[1]), f.getName()))]


def join_files(spark: SparkSession, pieces: list[str | bytes], path: str) -> None:
    """One file of the bytes and files given, one behind the other, under a name that it gets once it is
    whole.  Bytes are copied from store to store in blocks; neither rows nor files are held."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part, store = _place(spark, f"{path}.part-{uuid.uuid4().hex}")
    out = store.create(part)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
                continue
            source, its_store = _place(spark, piece)
            stream = its_store.open(source)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    target, _ = _place(spark, path)
    store.delete(target, False)
    if not store.rename(part, target):
        raise OSError(f"{part} could not be renamed to {path}")


def stage(spark: SparkSession, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table that was written.

    Survives lost executors (the files are in the shared store) and evaluates ``df`` once.
    Staged tables live until :func:`unstage`, the end of their :func:`scope` or that of the driver, as
    lazy results may read them.
    """
    path = new_path(spark, label)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more."""
    if path := getattr(df, "staged_path", None):
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file made by :func:`new_path`."""
    target, store = _place(spark, path)
    store.delete(target, True)
    store.cancelDeleteOnExit(target)
