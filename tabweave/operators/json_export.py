"""Tables as JSON: the standard and the minimal form of the tabular data recommendation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import once
from ..functions.types import ORDERED_TYPES, ZONED, ZONED_DATE, iso_text
from ..functions.uritemplate import compile_template
from ..model import NAMESPACES, Column, Datatype, Table, TableGroup, compact_name, expand_name, is_url
from ..staging import drop_path, join_files, new_path, part_files
from .scan import Field, Scan, compiled_type, scan

#: Types whose JSON value is a number or a boolean; others are written as text.
_BARE = ("decimal", "double", "bigint", "int", "smallint", "tinyint", "boolean")


def _quoted(text: Expr) -> Expr:
    """A text as a JSON string; most need no escapes."""
    escaped = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]\z", "")
    return F.when(text.rlike(r'["\\\x00-\x1F\x7F]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def literal(column: Column, value: Expr) -> Expr:
    """The JSON text of one value: numbers and booleans bare, all else quoted."""
    kind = compiled_type(column)
    quoted = _quoted
    base = (column.inherit("datatype") or Datatype()).base
    if base == "json":
        return value
    if kind.spark_type == "boolean":
        return value.cast("string")
    if kind.spark_type == "double":
        text = value.cast("string")
        special = F.when(F.isnan(value), quoted(F.lit("NaN"))).when(value == float("inf"), quoted(F.lit("INF"))).when(value == float("-inf"), quoted(F.lit("-INF")))
        return special.otherwise(text)
    if kind.spark_type == "string" and base in ORDERED_TYPES - {"time"}:  # digits of any number
        return value if base != "decimal" else F.when(value.contains("."), value).otherwise(F.concat(value, F.lit(".0")))
    if base == "decimal":
        text = value.cast("string") if not kind.spark_type.endswith(",0)") else F.concat(value.cast("string"), F.lit(".0"))
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    if kind.spark_type.startswith(_BARE):
        return value.cast("string")
    if kind.spark_type == "timestamp_ntz":
        return quoted(iso_text(value))
    if kind.spark_type == ZONED:
        return quoted(F.concat(iso_text(value["local"]), F.coalesce(value["zone"], F.lit(""))))
    if kind.spark_type == ZONED_DATE:
        return quoted(F.concat(F.date_format(value["local"], "yyyy-MM-dd"), F.coalesce(value["zone"], F.lit(""))))
    if kind.spark_type == "date":
        return quoted(F.date_format(value, "yyyy-MM-dd"))
    return quoted(kind.format(value))


def property_name(table: Table, column: Column) -> str:
    url = column.inherit("propertyUrl")
    if not url:
        return column.header
    made = expand_name(table.expand(url, {}, name=column.header) if "{" in url or not is_url(expand_name(url)) else url)
    return compact_name(made)


def _resolved(table: Table, template: str, values: dict[str, Expr]) -> Expr:
    """An expanded template as a URL, relative to the table's."""
    prefix, colon, rest = template.partition(":")
    if colon and prefix in NAMESPACES and not rest.startswith("//"):
        template = NAMESPACES[prefix] + rest
    made = compile_template(template, values)
    if is_url(template):
        return made
    if template.startswith("#"):
        return F.concat(F.lit(table.url), made)
    base = urljoin(table.url, ".") if is_url(table.url) else ""
    return F.when(made.rlike("^[a-z][a-z0-9+.-]*:"), made).otherwise(F.concat(F.lit(base), made))


@dataclass(frozen=True)
class Entry:
    """A cell as property name and JSON text, null if the cell is left out; of a list, its items
    without brackets; of a URL, the URL."""

    name: str
    text: Expr
    items: Expr | None = None
    url: Expr | None = None


def _entry(table: Table, field: Field, values: dict[str, Expr]) -> Entry:
    column = field.column
    name = property_name(table, column) if column else field.name
    if column is None:
        return Entry(name, F.when(field.value != "", _quoted(field.value)))
    url = column.inherit("valueUrl")
    if url:
        made = _resolved(table, url, {**values, "_name": F.lit(column.header)})
        if name == "rdf:type":
            known, full = None, made
            for p, u in sorted(NAMESPACES.items(), key=lambda x: -len(x[1])):
                short = F.concat(F.lit(f"{p}:"), F.substring(full, F.lit(len(u) + 1), F.length(full)))
                known = F.when(full.startswith(u), short) if known is None else known.when(full.startswith(u), short)
            made = known.otherwise(full)
            name = "@type"
        made = made if column.virtual else F.when(field.value.isNotNull(), made)
        return Entry(name, _quoted(made), url=made)
    if column.inherit("separator") is not None:
        items = F.array_join(F.transform(F.filter(field.value, lambda x: x.isNotNull()), lambda x: literal(column, x)), ",")
        items = F.when(F.size(field.value) > 0, items)
        return Entry(name, F.concat(F.lit("["), items, F.lit("]")), items=items)
    empty = (field.value == "") if compiled_type(column).spark_type == "string" else F.lit(False)
    fallback = F.when(field.raw.isNotNull() & field.error.isNotNull(), _quoted(field.raw)) if field.raw is not None else F.lit(None).cast("string")
    return Entry(name, F.when(~F.coalesce(empty, F.lit(False)), F.coalesce(literal(column, field.value), fallback)))


def _object(entries: list[Entry], subject: Expr | None, within: Callable[[Entry], Expr]) -> Expr:
    """A JSON object of the entries that are not null; equal names share one list.  ``within``
    gives the text of an entry, which may be a nested object."""
    by_name: dict[str, list[Entry]] = {}
    for e in entries:
        by_name.setdefault(e.name, []).append(e)
    parts = [] if subject is None else [F.concat(F.lit('"@id":'), _quoted(subject))]
    for name, found in by_name.items():
        text = within(found[0])
        if len(found) > 1:
            listed = any(e.items is not None for e in found)
            bare = F.array_compact(F.array(*[within(e) if e.items is None else e.items for e in found]))
            as_list = F.concat(F.lit("["), F.array_join(bare, ","), F.lit("]"))
            text = F.when(F.size(bare) > 1, as_list).when(F.size(bare) == 1, as_list if listed else F.get(bare, F.lit(0)))
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@dataclass(frozen=True)
class Subject:
    id: Expr | None
    entries: list[Entry]


def _framed(subjects: list[Subject]) -> Expr:
    """The objects of a row as an array of JSON texts.

    An object that exactly one URL of the row's cells refers to stands in the place of that
    URL, and not in the array; the row's own object always stands there, first, and so do objects
    that only refer to each other in a circle.  A row's URLs are edges between its objects, in an array:
    edges are counted, each object follows its only one upwards, and the objects that are nested are
    put into what holds them, the deepest first.  The work grows with the square of the subjects."""
    n = len(subjects)
    if n == 1:
        return F.array(_object(subjects[0].entries, subjects[0].id, lambda e: e.text))
    linked = [(j, e) for j, x in enumerate(subjects) for e in x.entries if e.url is not None]
    if not linked:
        return F.array(*[_object(x.entries, x.id, lambda e: e.text) for x in subjects])
    numbers, sources = F.sequence(F.lit(0), F.lit(n - 1)), F.array(*[F.lit(j) for j, _ in linked])
    ids = F.array(*[x.id if x.id is not None else F.lit(None).cast("string") for x in subjects[1:]])
    mark = lambda i: F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0001"))  # noqa: E731  no JSON text holds it bare

    def edges(ids: Expr) -> Expr:
        """The object that each URL refers to, 0 if there is none: nothing can hold the row's own."""
        return F.array(*[F.coalesce(F.array_position(ids, e.url), F.lit(0)).cast("int") for _, e in linked])

    def parents(to: Expr) -> Expr:
        """What holds the only URL that refers to an object, else -1."""
        only = lambda i: F.size(F.filter(to, lambda t: t == i)) == 1
        return F.transform(numbers, lambda i: F.when((i > 0) & only(i), F.get(sources, F.array_position(to, i).cast("int") - 1)).otherwise(F.lit(-1)))

    def depths(above: Expr) -> Expr:
        """How many objects stand around each one; 0 also for those that a circle holds."""
        start = lambda i: F.struct(i.cast("int").alias("at"), F.lit(0).alias("up"))
        step = lambda x, _: F.when(F.get(above, x["at"]) >= 0, F.struct(F.get(above, x["at"]).alias("at"), (x["up"] + 1).alias("up"))).otherwise(x)
        done = lambda x: F.when(F.get(above, x["at"]) < 0, x["up"]).otherwise(F.lit(0))
        return F.transform(numbers, lambda i: F.aggregate(numbers, start(i), step, done))

    def texts(to: Expr, deep: Expr) -> Expr:
        place = {id(e): F.get(to, F.lit(k)) for k, (_, e) in enumerate(linked)}
        within = lambda e: F.when(F.get(deep, place[id(e)]) > 0, mark(place[id(e)])).otherwise(e.text) if e.url is not None else e.text
        return F.array(*[_object(x.entries, x.id, within) for x in subjects])

    def folded(to: Expr, above: Expr, deep: Expr) -> Expr:
        inner = F.filter(F.transform(deep, lambda d, i: F.struct((-d).alias("d"), i.alias("i"))), lambda x: x["d"] < 0)
        put = lambda made, x: F.transform(made, lambda t, k: F.when(k == F.get(above, x["i"]), F.replace(t, mark(x["i"]), F.get(made, x["i"]))).otherwise(t))
        return F.filter(F.aggregate(F.array_sort(inner), texts(to, deep), put), lambda _, k: F.get(deep, k) == 0)

    return once(ids, lambda ids: once(edges(ids), lambda to: once(parents(to), lambda above: once(depths(above), lambda deep: folded(to, above, deep)))))


def describe_rows(s: Scan) -> DataFrame:
    """(rownum, sourcenum, describes, titles): the objects of each row as JSON texts.

    Cells with the row's subject make one object; a column with an ``aboutUrl`` of its own
    starts or joins another (see :func:`_framed`).  Without a subject of the row, its cells go
    into the only other object if there is just one."""
    table, numbers = s.table, s._numbers()
    values = {f.name: f.value for f in s.fields} | {"_row": F.col("rownum") if "rownum" in numbers else F.lit(1), "_sourceRow": F.col("sourcenum") if "sourcenum" in numbers else F.lit(1)}
    texts = {k: v.cast("string") if k.startswith("_") else _shown(s, k, v) for k, v in values.items()}
    row_subject = table.schema.inherit("aboutUrl")
    found: dict[str | None, list[Entry]] = {row_subject: []}
    for f in s.fields:
        if f.column is not None and f.column.suppress_output:
            continue
        about = (f.column.own.get("aboutUrl") if f.column is not None else None) or row_subject
        found.setdefault(about, []).append(_entry(table, f, texts))
    if row_subject is None and len(found) == 2:
        own = found.pop(None)
        about, others = next(iter(found.items()))
        found = {about: own + others}
    subjects = [Subject(_resolved(table, about, texts) if about else None, entries) for about, entries in found.items() if entries or about == row_subject]
    titles = []
    for t in table.schema.row_titles:
        column = table.schema.column(t)
        if column is not None:
            titles.append(next(f.value.cast("string") for f in s.fields if f.name == column.header))
    return s.rows.select(*numbers, _framed(subjects).alias("describes"), (F.array_compact(F.array(*titles)) if titles else F.array().cast("array<string>")).alias("titles"))


def _shown(s: Scan, name: str, value: Expr) -> Expr:
    field = next(f for f in s.fields if f.name == name)
    if field.column is None or field.column.virtual:
        return value.cast("string")
    kind = compiled_type(field.column)
    if field.column.inherit("separator") is not None:
        return F.array_join(F.transform(value, kind.format), ",")
    return kind.format(value)


def json_rows(s: Scan, minimal: bool = False) -> DataFrame:
    """(rownum, json): one JSON object for each row; lazy, one projection over the scan."""
    found = describe_rows(s)
    if minimal:
        return found.select("rownum", F.get("describes", F.lit(0)).alias("json"))
    url = F.concat(F.lit(json.dumps(s.table.url)[:-1] + "#row="), F.col("sourcenum").cast("string"), F.lit('"'))
    quoted = F.transform("titles", lambda t: F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2))
    title = F.when(F.size("titles") == 1, F.concat(F.lit(',"titles":'), F.get(quoted, F.lit(0)))).when(F.size("titles") > 1, F.concat(F.lit(',"titles":['), F.array_join(quoted, ","), F.lit("]"))).otherwise(F.lit(""))
    return found.select("rownum", F.concat(F.lit('{"url":'), url, F.lit(',"rownum":'), F.col("rownum").cast("string"), title, F.lit(',"describes":['), F.array_join("describes", ","), F.lit("]}")).alias("json"))


def _simplify(v: Any) -> Any:
    if isinstance(v, dict):
        if set(v) == {"@value"} or set(v) == {"@id"}:
            return next(iter(v.values()))
        return {("@type" if k == "rdf:type" else k): _simplify(x) for k, x in v.items() if not (k == "@language" and "@value" in v)} if "@value" not in v else v["@value"]
    if isinstance(v, list):
        return _simplify(v[0]) if len(v) == 1 else [_simplify(x) for x in v]
    return v


def _heads(group: TableGroup, minimal: bool) -> tuple[dict, list[tuple[Table, dict]]]:
    """What a document tells of the group, and of each table before its rows."""
    tables = []
    for t in (t for t in group.tables if not t.suppress_output):
        head: dict[str, Any] = {"url": t.url}
        if "@id" in t.at:
            head["@id"] = t.at["@id"]
        if t.notes:
            head["notes"] = _simplify(t.notes) if isinstance(t.notes, list) and len(t.notes) > 1 else [_simplify(x) for x in t.notes]
        tables.append((t, head | {k: _simplify(v) for k, v in t.common.items()}))
    out: dict[str, Any] = {}
    if not group.single:
        if "@id" in group.at:
            out["@id"] = group.at["@id"]
        out |= {k: _simplify(v) for k, v in group.common.items()}
    return out, tables


def write_json(spark: SparkSession, group: TableGroup, path: str, minimal: bool = False, scans: dict[str, Scan] | None = None) -> None:
    """The whole document as one file, a line for each row.

    Tasks write the rows of each table, in order, into parts in the shared folder, each row but the
    first with the comma before it; the parts are joined there with what stands around the rows.  No
    row comes to the driver."""
    about, tables = _heads(group, minimal)
    pieces: list[str | bytes] = [b"[\n" if minimal else (json.dumps(about, ensure_ascii=False)[:-1] + (", " if about else "") + '"tables": [\n').encode()]
    made, some = [], False
    for k, (t, head) in enumerate(tables):
        s = (scans or {}).get(t.url) or scan(spark, t, strict_header=False)
        first = s.rows.agg(F.min("rownum")).first()[0]
        starts = (F.col("rownum") == first) if not (minimal and some) else F.lit(False)
        lines = json_rows(s, minimal).orderBy("rownum").select(F.when(starts, F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("value"))
        made.append(new_path(spark, "json"))
        lines.write.text(made[-1])
        some = some or first is not None
        rows = part_files(spark, made[-1])
        pieces += rows if minimal else [((",\n" if k else "") + json.dumps(head, ensure_ascii=False)[:-1] + ', "row": [\n').encode(), *rows, b"]}\n"]
    join_files(spark, [*pieces, b"]\n" if minimal else b"]}\n"], path)
    for p in made:
        drop_path(spark, p)


def to_json(spark: SparkSession, group: TableGroup, minimal: bool = False, scans: dict[str, Scan] | None = None) -> Any:
    """The whole document, on the driver: for files whose JSON one process can hold.

    :func:`write_json` writes it as a file, :func:`json_rows` gives its rows."""
    out, tables = _heads(group, minimal)
    documents, every = [], []
    for t, head in tables:
        s = (scans or {}).get(t.url) or scan(spark, t, strict_header=False)
        rows = [json.loads(r.json) for r in json_rows(s, minimal).orderBy("rownum").toLocalIterator()]
        every += rows
        documents.append({**head, "row": rows})
    return every if minimal else {**out, "tables": documents}


def triples(s: Scan) -> DataFrame:
    """(rownum, about, property, value, is_url): each cell as a triple."""
    table = s.table
    texts = {f.name: _shown(s, f.name, f.value) for f in s.fields} | {"_row": F.col("rownum").cast("string"), "_sourceRow": F.col("sourcenum").cast("string")}
    made = []
    for f in s.fields:
        if f.column is not None and f.column.suppress_output:
            continue
        about = (f.column.inherit("aboutUrl") if f.column is not None else None) or table.schema.inherit("aboutUrl")
        subject = _resolved(table, about, texts) if about else F.concat(F.lit("_:row"), F.col("rownum").cast("string"))
        url = f.column.inherit("valueUrl") if f.column is not None else None
        value = _resolved(table, url, texts) if url else texts[f.name]
        name = property_name(table, f.column) if f.column is not None else f.name
        made.append(F.when(value.isNotNull() & (value != ""), F.struct(subject.alias("about"), F.lit(name).alias("property"), value.alias("value"), value.rlike("^https?://").alias("is_url"))))
    return s.rows.select("rownum", F.explode(F.array_compact(F.array(*made))).alias("t")).select("rownum", "t.*")
