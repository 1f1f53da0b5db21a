"""Typed scan: cells to values, with every complaint kept as data."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.types import Compiled
from ..functions.uritemplate import compile_template
from ..model import Column, Datatype, Table
from ..sources import dsv

ERROR = "struct<column:string,message:string>"


@dataclass(frozen=True)
class Field:
    """One column of a typed scan: its value (as parsed, and null where there is a
    complaint), its complaint (null if fine), its raw text."""

    name: str
    parsed: Expr
    value: Expr
    error: Expr
    raw: Expr | None
    column: Column | None


def compiled_type(column: Column) -> Compiled:
    return (column.inherit("datatype") or Datatype()).compiled()


def live_text(column: Column, text: Expr) -> Expr:
    """The text of a cell with its default, null if it is a null token (not for lists)."""
    nulls, default = column.inherit("null"), column.inherit("default")
    text = F.when(text == "", F.lit(default)).otherwise(text) if default else text
    if column.inherit("separator") is not None or not nulls:
        return text
    return F.when(~text.isin(nulls), text)


def _item(column: Column, x: Expr) -> Expr:
    nulls, default = column.inherit("null"), column.inherit("default")
    x = F.when(x == "", F.lit(default)).otherwise(x) if default else x
    return F.when(~x.isin(nulls), x) if nulls else x


def _items(column: Column, text: Expr) -> Expr:
    separator = column.inherit("separator").replace("\\E", "\\E\\\\E\\Q")
    return F.split(text, "\\Q" + separator + "\\E")


def parsed(column: Column, text: Expr) -> Expr:
    """The value of a live text: null if malformed; an empty list for an empty text."""
    kind, nulls = compiled_type(column), column.inherit("null")
    if column.inherit("separator") is None:
        return kind.parse(text)
    values = F.transform(_items(column, text), lambda x: kind.parse(_item(column, x)))
    values = F.when(~text.isin(nulls), values) if nulls else values
    return F.when(text == "", F.array().cast(f"array<{kind.spark_type}>")).otherwise(values)


def complaint(column: Column, raw: Expr, text: Expr, value: Expr) -> Expr:
    """What is wrong with a cell, or null, from its raw text, live text and value."""
    kind, nulls = compiled_type(column), column.inherit("null")
    listed = column.inherit("separator") is not None
    if listed:
        wrong = F.get(F.filter(F.transform(_items(column, text), lambda x: kind.error(_item(column, x))), lambda e: e.isNotNull()), F.lit(0))
        wrong = F.when((text != "") & (~text.isin(nulls) if nulls else F.lit(True)), wrong)
    else:
        wrong = kind.error(text, value)
    if not column.inherit("required"):
        return wrong
    gone = raw.isNull() | (text.isin(nulls) if listed and nulls else text.isNull())
    return F.when(gone, F.lit("required value is missing")).otherwise(wrong)


def write_cell(column: Column, value: Expr) -> Expr:
    """The text of a value: the first null token for null, items joined by the separator."""
    kind, nulls, separator = compiled_type(column), column.inherit("null"), column.inherit("separator")
    token = F.lit(nulls[0] if nulls else "")
    if separator is None:
        return F.coalesce(kind.format(value), token)
    shown = F.array_join(F.transform(value, lambda x: F.coalesce(kind.format(x), token)), separator)
    return F.coalesce(shown, F.lit(""))


def match_header(table: Table, header: list[str] | None, strict: bool = True) -> list[tuple[str, Column | None]]:
    """Which description belongs to each cell of a row, and the name it gets."""
    columns = [c for c in table.schema.columns if not c.virtual]
    if header is None:
        return [(c.header, c) for c in columns]
    if header == [c.header for c in columns]:
        return [(c.header, c) for c in columns]
    if not columns:
        return [(h or f"_col.{i + 1}", None) for i, h in enumerate(header)]
    if strict:
        found = [table.schema.column(h) for h in header]
        for h, c in zip(header, found, strict=True):
            if c is None:
                warnings.warn(f"{table.url}: no description of column {h}", stacklevel=3)
        return [(c.header if c else h, c) for h, c in zip(header, found, strict=True)]
    if len(header) != len(columns):
        warnings.warn(f"{table.url}: {len(header)} columns, {len(columns)} described", stacklevel=3)
    out = []
    for i, h in enumerate(header):
        c = columns[i] if i < len(columns) else None
        if c is not None and not c.has_title(h):
            warnings.warn(f"{table.url}: column {i + 1} is titled {h}", stacklevel=3)
        lang = c.title_language(h) if c is not None else None
        if lang and lang.split("-")[0] not in ("und", table.inherit("lang").split("-")[0]):
            warnings.warn(f"{table.url}: column {i + 1} is titled in {lang}", stacklevel=3)
        out.append((c.header if c else f"_col.{i + 1}", c))
    return out


def bind(table: Table, matched: list[tuple[str, Column | None]], raw: list[Expr], rows: DataFrame) -> Scan:
    """Fields over three projections: raw texts, live texts, values.

    Each stands on the one before, which it reads more than once, so that Spark does not
    merge them: a cell is parsed once, not once for every expression that looks at it."""
    present = {c.header for _, c in matched if c is not None}
    absent = [c for c in table.schema.columns if not c.virtual and c.header not in present]
    if lacking := [c.header for c in absent if c.own.get("required")]:
        raise ValueError(f"{table.url}: required columns are missing: {lacking}")
    numbers = [c for c in ("rownum", "sourcenum") if c in rows.columns]
    cells = range(len(matched))
    rows = rows.select(*numbers, *[r.alias(f"_r{i}") for i, r in enumerate(raw)])
    rows = rows.select("*", *[(live_text(c, F.col(f"_r{i}")) if c else F.col(f"_r{i}")).alias(f"_t{i}") for i, (_, c) in enumerate(matched)])
    rows = rows.select("*", *[(parsed(c, F.col(f"_t{i}")) if c else F.col(f"_t{i}")).alias(f"_v{i}") for i, (_, c) in enumerate(matched)])
    none = F.lit(None).cast("string")
    out = []
    for i in cells:
        name, c = matched[i]
        r, t, v = (F.col(f"_{x}{i}") for x in "rtv")
        error = complaint(c, r, t, v) if c else none
        value = F.when(error.isNull(), v) if c is not None and compiled_type(c).checks else v
        out.append(Field(name, v, value, error, r, c))
    for c in absent:
        nothing = F.lit(None).cast(array_type(c))
        out.append(Field(c.header, nothing, nothing, none, None, c))
    values = {f.name: f.value for f in out}
    for c in (c for c in table.schema.columns if c.virtual):
        template = c.inherit("valueUrl")
        made = compile_template(template, {**values, "_name": F.lit(c.header)}) if template else none
        out.append(Field(c.header, made, made, none, None, c))
    return Scan(table, out, rows)


def array_type(c: Column) -> str:
    kind = compiled_type(c).spark_type
    return f"array<{kind}>" if c.inherit("separator") is not None else kind


@dataclass(frozen=True)
class Scan:
    """``good``: typed rows without a complaint; ``errors``: (url, sourcenum, column, message);
    ``lenient``: all rows, malformed cells null and their text in ``_raw``; ``strict``: as
    ``good``, but a complaint ends the query."""

    table: Table
    fields: list[Field]
    rows: DataFrame

    def __iter__(self) -> Iterator[Row]:
        """The rows of ``strict`` on the driver, in order, a partition at a time."""
        rows = self.strict
        return iter((rows.orderBy("rownum") if "rownum" in rows.columns else rows).toLocalIterator())

    def _numbers(self) -> list[str]:
        return [c for c in ("rownum", "sourcenum") if c in self.rows.columns]

    def _errors(self) -> Expr:
        found = [F.when(f.error.isNotNull(), F.struct(F.lit(f.name).alias("column"), f.error.alias("message"))) for f in self.fields if f.column is not None and f.raw is not None]
        return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ERROR}>")

    def _fine(self) -> Expr:
        checks = [f.error.isNull() for f in self.fields if f.column is not None and f.raw is not None]
        return reduce(lambda a, b: a & b, checks, F.lit(True))

    def _values(self) -> list[Expr]:
        return [f.value.alias(f.name) for f in self.fields]

    def typed(self, *names: str) -> DataFrame:
        """Values of some columns (all without names), malformed cells null, nothing checked:
        columns that are not asked for are not parsed, and not read."""
        wanted = [f for f in self.fields if not names or f.name in names]
        return self.rows.select(*self._numbers(), *[f.parsed.alias(f.name) for f in wanted])

    @property
    def good(self) -> DataFrame:
        # Pushed below the projection that parses, the filter would parse every cell again; it
        # stays above one that holds a random column which it reads.
        held = self.rows.withColumn("_held", F.rand(0))
        return held.filter(self._fine() & (F.col("_held") >= 0)).select(*self._numbers(), *[f.parsed.alias(f.name) for f in self.fields])

    @property
    def strict(self) -> DataFrame:
        where = F.concat(F.lit(f"{self.table.url}:"), F.col("sourcenum").cast("string") if "sourcenum" in self.rows.columns else F.lit("?"))
        out = []
        for f in self.fields:
            stop = F.raise_error(F.concat(where, F.lit(f" {f.name}: "), f.error))
            out.append((F.when(f.error.isNotNull(), stop).otherwise(f.parsed) if f.column is not None and f.raw is not None else f.value).alias(f.name))
        return self.rows.select(*self._numbers(), *out)

    @property
    def lenient(self) -> DataFrame:
        wrong = [F.when(f.error.isNotNull(), F.struct(F.lit(f.name).alias("column"), f.raw.alias("text"))) for f in self.fields if f.column is not None and f.raw is not None]
        raw = F.map_from_entries(F.array_compact(F.array(*wrong))) if wrong else F.create_map().cast("map<string,string>")
        return self.rows.select(*self._numbers(), *self._values(), raw.alias("_raw"))

    def checked(self, *names: str) -> DataFrame:
        """All rows with some of their values and ``_errors``, their complaints."""
        wanted = [f.parsed.alias(f.name) for f in self.fields if f.name in names]
        return self.rows.select(*self._numbers(), *wanted, self._errors().alias("_errors"))

    def told(self, checked: DataFrame) -> DataFrame:
        """The complaints of rows made by :meth:`checked`, one by one."""
        number = F.col("sourcenum") if "sourcenum" in checked.columns else F.lit(None).cast("long")
        found = checked.select(number.alias("sourcenum"), F.explode("_errors").alias("e"))
        return found.select(F.lit(self.table.url).alias("url"), "sourcenum", "e.column", "e.message")

    @property
    def errors(self) -> DataFrame:
        return self.told(self.checked())

    def error_counts(self) -> DataFrame:
        """(column, n): complaints of each column, counted in one pass without a row for each."""
        checked = [f for f in self.fields if f.column is not None and f.raw is not None]
        counts = self.rows.agg(*[F.count(f.error).alias(str(i)) for i, f in enumerate(checked)])
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(str(i)).alias("n")) for i, f in enumerate(checked)])
        return counts.select(F.explode(pairs).alias("p")).select("p.column", "p.n")


def scan_frame(table: Table, df: DataFrame) -> Scan:
    """Scan a DataFrame whose columns, cast to string, are the cells."""
    numbers = [c for c in ("rownum", "sourcenum") if c in df.columns]
    header = [c for c in df.columns if c not in numbers]
    matched = match_header(table, header)
    return bind(table, matched, [F.col(f"`{h}`").cast("string") for h in header], df)


def scan(spark: SparkSession, table: Table, path: str | list[str] | None = None, strict_header: bool = True, one_line: bool = False) -> Scan:
    """Scan a table's delimited file (or files of one form, each with its own header): ``rownum``
    counts the rows of all files, ``sourcenum`` the lines of each.

    With ``one_line`` the caller declares that no cell holds a line break, that headers need no
    check and that no row number is needed; plain dialects are then read by Spark's splittable reader."""
    d, where = table.effective_dialect, path or table.location
    columns = [c for c in table.schema.columns if not c.virtual]
    if one_line and d.plain and columns and isinstance(where, str):
        return scan_frame(table, dsv.read_plain(spark, where, [c.header for c in columns], d, one_line=True))
    where = dsv.fetched(spark, [where] if isinstance(where, str) else list(where))
    rows = dsv.table_rows(dsv.read_cells(spark, where, d), d.header)
    header = None
    if d.header:
        first = dsv.first_cells(spark, where[0], d)
        header = list(first) if first is not None else [c.header for c in columns]
    elif not columns:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        header = [""] * width
    matched = match_header(table, header, strict_header)
    return bind(table, matched, [F.get("cells", F.lit(i)) for i in range(len(matched))], rows)


def comments(spark: SparkSession, table: Table, path: str | None = None) -> DataFrame:
    """(sourcenum, comment) of a table's file."""
    rows = dsv.read_cells(spark, path or table.location, table.effective_dialect)
    return rows.filter("is_comment").select("sourcenum", F.get("cells", F.lit(0)).alias("comment"))


def texts(table: Table, df: DataFrame) -> DataFrame:
    """Typed rows as the text of their cells, in the order of the description."""
    columns = [c for c in table.schema.columns if not c.virtual]
    if unknown := set(df.columns) - {c.header for c in columns} - {"rownum", "sourcenum"}:
        raise ValueError(f"{table.url}: columns that are not described: {sorted(unknown)}")
    return df.select(*[(write_cell(c, F.col(f"`{c.header}`")) if c.header in df.columns else F.lit(c.inherit("null")[0] if c.inherit("null") else "")).alias(c.header) for c in columns])


def write_table(table: Table, df: DataFrame, path: str | None = None, zipped: bool = False, as_bytes: bool = False) -> bytes | int:
    """Write typed rows as the table's delimited file."""
    order = ["rownum"] if "rownum" in df.columns else None
    out = texts(table, df.orderBy(*order) if order else df)
    return dsv.write_file(out, None if as_bytes else path or table.location, table.effective_dialect, zipped)
