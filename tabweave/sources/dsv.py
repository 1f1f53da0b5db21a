"""Exact reading and writing of delimited files.

:func:`read_cells` gives rows of ``(url, rownum, sourcenum, is_comment, cells)`` with
``rows_before`` and ``files_before``: comments, skipped rows, blank rows, line numbers of rows
with line breaks in cells; :func:`table_rows` numbers them over all files.  Files in UTF-8 and in
encodings of one byte a character are read in parallel, block by block (see :mod:`.split`); others and zipped
ones are taken whole, by one task each, from whatever store Spark reads.  The format ``dsv`` is a Python
data source over local files.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import warnings
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import batched
from pathlib import Path
from typing import Any
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..staging import drop_path, join_files, new_path, part_files, path_exists, write_bytes
from .dialect import Dialect, normal_name

CELLS = "url string, rownum long, sourcenum long, is_comment boolean, cells array<string>"


def rows_of(lines: Iterable[str], d: Dialect, before: int = 0) -> Iterator[tuple[int, bool, list[str]]]:
    """(line number, is comment, cells); the number is that of the row's last line, after
    ``before`` lines.

    Skipped rows that hold anything become comments; a comment's cells are its text without
    the prefix.
    """
    reader, as_is = csv.reader(lines, **d.csv_options()), d.trim == "false" and not d.skip_columns
    for cells in reader:
        number = before + reader.line_num
        if d.comment_prefix and cells and cells[0].startswith(d.comment_prefix):
            yield number, True, [d.delimiter.join(cells)[len(d.comment_prefix) :].strip()]
        elif number <= d.skip_rows:
            if any(cells):
                yield number, True, [d.delimiter.join(cells)]
        elif not d.skip_blank_rows or any(cells):
            yield number, False, cells if as_is else [d.trimmed(c) for c in cells][d.skip_columns :]


def open_text(path: str, encoding: str) -> io.TextIOBase:
    """A file, or the member of ``path.zip`` if only that is there."""
    if not os.path.exists(path) and os.path.exists(f"{path}.zip"):
        archive = zipfile.ZipFile(f"{path}.zip")
        member = next((n for n in archive.namelist() if os.path.basename(n) == os.path.basename(path)), archive.namelist()[0])
        return io.TextIOWrapper(archive.open(member), encoding=encoding, newline="")
    return open(path, encoding=encoding, newline="")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _numbered(path: str, stream: Iterable[str], d: Dialect) -> Iterator[tuple]:
    rownum = 0
    for number, comment, cells in rows_of(stream, d):
        rownum += not comment
        yield path, rownum, number, comment, cells


class DsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.dialect = Dialect.of(json.loads(options.get("dialect", "{}")))
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open_text(partition.path, self.dialect.python_encoding) as stream:
            yield from _numbered(partition.path, stream, self.dialect)


class DsvSource(DataSource):
    """``spark.read.format("dsv")`` with options ``path`` or ``paths`` and ``dialect`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "dsv"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: Any) -> DsvReader:
        return DsvReader(dict(self.options))


def _zipped(spark: SparkSession, path: str) -> bool:
    return not path_exists(spark, path) and path_exists(spark, f"{path}.zip")


def _whole(d: Dialect):
    """Rows of files that are held whole, or of the member of a zip file that has its name."""

    def run(batches):
        from .split import _cells_batch

        for b in batches:
            for url, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stream: Any = pa.py_buffer(content.as_buffer())
                stream = io.BytesIO(stream)
                if url.endswith(".zip"):
                    url = url.removesuffix(".zip")
                    archive = zipfile.ZipFile(stream)
                    member = next((n for n in archive.namelist() if os.path.basename(n) == unquote(os.path.basename(url))), archive.namelist()[0])
                    stream = archive.open(member)
                rownum = 0
                for some in batched(rows_of(io.TextIOWrapper(stream, encoding=d.python_encoding, newline=""), d), 2_000):
                    yield _cells_batch(url, rownum, some)
                    rownum += sum(not comment for _, comment, _ in some)

    return run


def fetched(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that only the driver may fetch are put into the shared folder, one by one, and are
    read there like any other file."""
    from ..discover import fetch
    from ..model import is_url

    return [write_bytes(spark, fetch(p), "fetched.csv") if is_url(p) else p for p in paths]


def read_cells(spark: SparkSession, paths: str | list[str], dialect: Dialect | None = None) -> DataFrame:
    """All rows of delimited files (or folders of them) as cells, comments included and marked.

    ``rownum`` and ``sourcenum`` count the rows and lines of each file; ``rows_before`` and
    ``files_before`` are the rows of all files before it, and how many of these have rows.  Files come in
    the order of ``paths``, those of a folder by name."""
    from .split import read_split, splittable

    d = dialect or Dialect()
    paths = fetched(spark, [paths] if isinstance(paths, str) else list(paths))
    zipped = [p for p in paths if _zipped(spark, p)]
    whole = [p for p in paths if not splittable(d) or p in zipped]
    split = [p for p in paths if p not in whole]
    found, totals = [], {}
    if split:
        read = read_split(spark, split, d)
        if read is None:
            whole += split
        else:
            rows, totals = read
            named = len(split) == 1 and os.path.isfile(split[0])
            found.append(rows.withColumn("url", F.lit(split[0])) if named else rows)
            totals = {split[0]: n for n in totals.values()} if named else totals
    if whole:
        files = spark.read.format("binaryFile").load([f"{p}.zip" if p in zipped else p for p in whole])
        rows = files.select("path", "content").mapInArrow(_whole(d), CELLS)
        found.append(rows)
        if len(paths) > 1:
            totals |= dict(rows.filter(~F.col("is_comment")).groupBy("url").count().collect())
    return _placed(spark, reduce(DataFrame.union, found), paths, totals)


def put_lines(spark: SparkSession, lines: Iterable[str | bytes], dialect: Dialect | None = None) -> str:
    """Lines in the driver's memory (each with its end or without) as a file of the shared folder,
    which all readers take; it lives as long as the session."""
    encoding = (dialect or Dialect()).python_encoding
    data = [x if isinstance(x, bytes) else x.encode(encoding if not k else encoding.replace("utf-8-sig", "utf-8")) for k, x in enumerate(lines)]
    return write_bytes(spark, b"".join(x if x.endswith((b"\n", b"\r")) else x + "\n".encode(encoding.replace("utf-8-sig", "utf-8")) for x in data), "lines.csv")


def _bare_path(path: str) -> str:
    return re.sub("^file:/*(?=/)", "", path).rstrip("/")


def _placed(spark: SparkSession, rows: DataFrame, paths: list[str], totals: dict[str, int]) -> DataFrame:
    """Add what the files before a row's file hold: sums over one row a file, which are sent to all tasks."""
    if len(totals) < 2:
        return rows.withColumns({"rows_before": F.lit(0).cast("long"), "files_before": F.lit(0).cast("long")})
    given = [_bare_path(p) for p in paths]

    def order(url: str) -> tuple[int, str]:
        bare = _bare_path(url)
        return next((i for i, p in enumerate(given) if bare == p or bare.startswith(f"{p}/")), len(given)), url

    table, before = [], 0
    for k, url in enumerate(sorted(totals, key=order)):
        table.append((url, before, k))
        before += totals[url]
    return rows.join(F.broadcast(spark.createDataFrame(table, "url string, rows_before long, files_before long")), "url", "left")


def table_rows(rows: DataFrame, header: bool) -> DataFrame:
    """Rows of :func:`read_cells` without comments (and without the header of each file), numbered
    over all files."""
    body = rows.filter(~F.col("is_comment"))
    number = F.col("rows_before") + F.col("rownum")
    if header:
        body, number = body.filter("rownum > 1"), number - F.col("files_before") - 1
    return body.withColumn("rownum", number).drop("rows_before", "files_before")


def first_cells(spark: SparkSession, path: str, d: Dialect) -> list[str] | None:
    """The first row of a file that is no comment; only its begin is read."""
    if "://" in path and not path.startswith("file:") or not os.path.isfile(_bare_path(path)) and not os.path.isfile(_bare_path(path) + ".zip"):
        first = read_cells(spark, path, d).filter("rownum = 1 and not is_comment").select("cells").first()
        return list(first.cells) if first else None
    with open_text(_bare_path(path), d.python_encoding) as stream:
        return next((cells for _, comment, cells in rows_of(stream, d) if not comment), None)


def read_plain(spark: SparkSession, path: str | list[str], names: list[str], dialect: Dialect, one_line: bool = False) -> DataFrame:
    """Spark's own reader: string columns ``names``, no row numbers; for plain dialects.

    It splits files only if the caller declares by ``one_line`` that no cell holds a line break."""
    if not dialect.plain:
        raise ValueError("the dialect needs the exact reader")
    schema = ", ".join(f"`{n}` string" for n in names)
    options = dialect.spark_options() | {"multiLine": str(not one_line).lower(), "header": str(dialect.header).lower(), "enforceSchema": "true"}
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_dsv(spark: SparkSession, paths: str | list[str], dialect: Dialect | None = None, as_: str = "cells", restkey: str | None = None, restval: str | None = None) -> DataFrame:
    """Rows as ``cells``, as ``dicts`` (column ``row``: map by header) or as ``names``
    (a column for each header, made an identifier).

    Surplus cells go under ``restkey`` (joined by the delimiter) or are left out; missing
    ones are ``restval``.  The header is the first row of the first file; every file has one.  Rows are
    numbered over all files, without headers where they go by name.
    """
    d = dialect or Dialect()
    rows = read_cells(spark, paths, d)
    if as_ == "cells":
        return table_rows(rows, False).select("rownum", "sourcenum", "cells")
    if as_ not in ("dicts", "names"):
        raise ValueError(f"rows are cells, dicts or names, not {as_}")
    first = rows.filter("not is_comment and rownum = 1 and files_before = 0").select("cells").first()
    header = list(first.cells) if first else []
    body = table_rows(rows, True).filter(F.size("cells") > 0)
    cell = [F.coalesce(F.get("cells", F.lit(i)), F.lit(restval)) for i in range(len(header))]
    rest = F.array_join(F.slice("cells", len(header) + 1, F.greatest(F.size("cells") - len(header), F.lit(0))), d.delimiter)
    if as_ == "names":
        return body.select("rownum", "sourcenum", *[c.alias(normal_name(h, i)) for i, (h, c) in enumerate(zip(header, cell, strict=True))])
    last = {h: c for h, c in zip(header, cell, strict=True)}  # of equal headers the last one counts
    entries = F.map_from_arrays(F.array(*[F.lit(h) for h in last]), F.array(*last.values())) if last else F.create_map().cast("map<string,string>")
    if restkey:
        entries = F.when(F.size("cells") > len(header), F.map_concat(entries, F.create_map(F.lit(restkey), rest))).otherwise(entries)
    return body.select("rownum", "sourcenum", entries.alias("row"))


# Writing: expressions make the lines, Spark's text sink writes them, part by part.


def csv_line(cells: list[Column], d: Dialect) -> Column:
    """One line of a delimited file, quoted where it has to be; null cells are empty."""
    cells = [F.coalesce(c, F.lit("")) for c in cells]
    special = "[" + "".join(f"\\{c}" for c in (d.delimiter, *([d.quote_char] if d.quote_char else ()))) + r"\r\n]" + (r"|\\" if not d.double_quote else "") + ("|^ " if d.skip_initial_space else "")
    if d.quote_char is None:
        lost = F.raise_error(F.lit("a cell holds a delimiter or a line break, and the dialect has no quotes"))
        return F.concat_ws(d.delimiter, *[F.when(c.rlike(special), lost).otherwise(c) for c in cells])
    q = d.quote_char
    inner = (lambda c: F.replace(c, F.lit(q), F.lit(q + q))) if d.double_quote else (lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(q), F.lit("\\" + q)))
    comment = (lambda c: c.startswith(d.comment_prefix)) if d.comment_prefix else (lambda c: F.lit(False))
    quoted = [F.when(c.rlike(special) | comment(c), F.concat(F.lit(q), inner(c), F.lit(q))).otherwise(c) for c in cells]
    if len(quoted) == 1:  # a lone empty cell would be a blank line
        quoted = [F.when(quoted[0] == "", F.lit(q + q)).otherwise(quoted[0])]
    return F.concat_ws(d.delimiter, *quoted)


def _plain_line(cells: list[str], d: Dialect) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="", **d.csv_options()).writerow(cells)
    return out.getvalue()


def _lines_of(df: DataFrame, d: Dialect) -> DataFrame:
    """Rows as lines; a row whose first cell would be read as a comment is an error, as it would be lost."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    line = csv_line(cells, d)
    if d.comment_prefix:
        if df.columns and df.columns[0].startswith(d.comment_prefix) and d.header:
            raise ValueError(f"the header would be read as a comment: {df.columns[0]}")
        line = F.when(cells[0].startswith(d.comment_prefix), F.raise_error(F.concat(F.lit("a row would be read as a comment: "), cells[0]))).otherwise(line)
    if d.trim != "false":
        warnings.warn(f"blanks around cells are lost when they are read with trim {d.trim}", stacklevel=3)
    return df.select(line.alias("value"))


def _utf8(d: Dialect) -> bool:
    return d.python_encoding == "utf-8-sig"


def _write_lines(lines: DataFrame, path: str, end: str) -> None:
    """A folder of parts in UTF-8: each task writes its own, and only those of tasks that succeed count."""
    lines.write.mode("overwrite").text(path, lineSep=end)


def write_dir(df: DataFrame, path: str, d: Dialect | None = None, header: bool | None = None) -> int:
    """A folder of delimited parts in UTF-8, written in parallel, each with the header if there is
    one; returns the number of rows.  Every text of a cell is read back as it was."""
    d = d or Dialect()
    if not _utf8(d):
        raise ValueError(f"parts are written in UTF-8, not {d.encoding}")
    end, head = d.line_terminators[0], _plain_line(list(df.columns), d)
    seen = Observation(f"rows of {path}")
    lines = _lines_of(df, d).observe(seen, F.count(F.lit(1)).alias("n"))
    if d.header if header is None else header:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(head + end), "value")).otherwise(F.col("value")).alias("value"))
    _write_lines(lines, path, end)
    if not seen.get["n"] and (d.header if header is None else header):
        _write_lines(df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1), path, end)
    return seen.get["n"]


def write_file(df: DataFrame, path: str | None, d: Dialect | None = None, zipped: bool = False, order: list[str] | None = None) -> bytes | int:
    """One delimited file; returns the number of rows, or the bytes if ``path`` is None.

    Tasks write its parts, in the order of the rows, into the shared folder, and the parts are joined
    there; no row comes to the driver.  Bytes, zipped files and encodings other than UTF-8 are made
    by the driver, which takes one partition at a time."""
    d = d or Dialect()
    lines = _lines_of(df.orderBy(*order) if order else df, d)
    end, encoding = d.line_terminators[0], d.python_encoding.replace("utf-8-sig", "utf-8")
    head = [(_plain_line(list(df.columns), d) + end).encode(encoding)] if d.header else []
    if path is not None and not zipped and _utf8(d):
        spark, parts, seen = df.sparkSession, new_path(df.sparkSession, "parts"), Observation(f"rows of {path}")
        _write_lines(lines.observe(seen, F.count(F.lit(1)).alias("n")), parts, end)
        join_files(spark, [*head, *part_files(spark, parts)], path)
        drop_path(spark, parts)
        return seen.get["n"]
    n, sink = 0, io.BytesIO() if path is None or zipped else open(f"{path}.part", "wb")
    for data in head:
        sink.write(data)
    for row in lines.toLocalIterator():
        sink.write((row.value + end).encode(encoding))
        n += 1
    if path is None:
        return sink.getvalue()
    if zipped:
        with zipfile.ZipFile(f"{path}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(os.path.basename(path), sink.getvalue())
    else:
        sink.close()
        os.replace(f"{path}.part", path)
    return n


# Row-wise changes of a whole file.


def rewrite(spark: SparkSession, path: str, visitor: Callable[[int, list[str]], list[str] | None], dialect: Dialect | None = None) -> None:
    """Replace each row by what ``visitor(index, cells)`` makes of it, or drop it (None)."""
    d = dialect or Dialect()
    part = f"{path}.part"
    with open_text(path, d.python_encoding) as source, open(part, "w", encoding=d.python_encoding.replace("utf-8-sig", "utf-8"), newline="") as sink:
        for i, (_, _, cells) in enumerate(r for r in rows_of(source, d) if not r[1]):
            made = visitor(i, cells)
            if made is not None:
                sink.write(_plain_line(made, d) + d.line_terminators[0])
    shutil.move(part, path)


def visit_rows(rows: DataFrame, visitor: Callable[[int, list[str]], list[str] | None]) -> DataFrame:
    """The distributed form of :func:`rewrite`, over rows of :func:`read_cells`: the cells that
    ``visitor(index, cells)`` makes of each row, without those that it drops."""

    def run(batches):
        for b in batches:
            numbers, cells = (b.column(i).to_pylist() for i in range(2))
            made = [(n, visitor(n - 1, c)) for n, c in zip(numbers, cells, strict=True)]
            made = [(n, c) for n, c in made if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([c for _, c in made], pa.list_(pa.string()))], names=["rownum", "cells"])

    return table_rows(rows, False).select("rownum", "cells").mapInArrow(run, "rownum long, cells array<string>")


def filter_rows(df: DataFrame, keep: Column | Callable[[dict], bool], counter: str | None = None) -> tuple[DataFrame, Any]:
    """Rows that satisfy ``keep`` (a predicate, or a Python function of the row as a dict) and
    an observation whose ``get`` tells how many were removed, once the result was written."""
    if not isinstance(keep, Column):
        function = keep

        @F.pandas_udf("boolean")
        def kept(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(function(dict(r))) for r in rows.to_dict("records")], dtype=bool)

        keep = kept(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    seen = Observation(counter or "filter_rows")
    marked = df.withColumn("_tw_keep", F.coalesce(keep, F.lit(False)))
    marked = marked.observe(seen, F.sum((~F.col("_tw_keep")).cast("long")).alias("removed"))
    return marked.filter("_tw_keep").drop("_tw_keep"), seen


def add_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of both, columns by name."""
    return df.unionByName(more, allowMissingColumns=True)


def list_files(folder: str, suffix: str = ".csv") -> list[str]:
    return sorted(str(p) for p in Path(folder).rglob(f"*{suffix}"))
