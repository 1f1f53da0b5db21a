"""Descriptions made from data, from data packages, and as Markdown."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import compile_datatype
from .model import CONTEXT, Datatype, TableGroup
from .sources import dsv
from .sources.dialect import Dialect

#: Types that are tried, the most specific first.
CANDIDATES = ("boolean", "integer", "decimal", "double", "date", "dateTime", "time", "json", "anyURI")
_NARROW = {"boolean": r"^(?i:true|false)$", "json": r"^[\[{]", "anyURI": r"^[A-Za-z][A-Za-z0-9+.-]*://", "date": r"^\d{4}-", "time": r"^\d{2}:"}


def infer_types(df: DataFrame) -> dict[str, str]:
    """The most specific type that all non-empty cells of a column have; one aggregate."""
    tests = []
    for i, c in enumerate(df.columns):
        text = F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
        tests.append(F.count(text).alias(f"n{i}"))
        for name in CANDIDATES:
            fine = compile_datatype(name).parse(text).isNotNull()
            fine = fine & text.rlike(_NARROW[name]) if name in _NARROW else fine
            tests.append(F.count_if(fine).alias(f"{name}{i}"))
    found = df.agg(*tests).first()
    return {c: next((t for t in CANDIDATES if found[f"n{i}"] and found[f"{t}{i}"] == found[f"n{i}"]), "string") for i, c in enumerate(df.columns)}


def describe(spark: SparkSession, path: str, dialect: Dialect | None = None) -> dict:
    """A description of a delimited file with a header."""
    d = dialect or Dialect()
    rows = dsv.read_cells(spark, path, d).filter(~F.col("is_comment"))
    first = rows.filter("rownum = 1").select("cells").first()
    header = list(first.cells) if first else []
    wide = rows.filter("rownum > 1").select(*[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)])
    types = infer_types(wide) if header else {}
    columns = [{"name": h, "datatype": types[h]} for h in header]
    out: dict[str, Any] = {"@context": CONTEXT, "url": Path(path).name, "tableSchema": {"columns": columns}}
    return out | ({"dialect": d.asdict()} if d.asdict() else {})


# Data packages: types of fields and their datatypes; fixed values.
_FIELD_TYPES = {"string": "string", "number": "decimal", "integer": "integer", "boolean": "boolean", "date": "date", "time": "time", "datetime": "dateTime", "year": "gYear", "yearmonth": "gYearMonth", "duration": "duration", "object": "json", "array": "json", "geojson": "json", "any": "any"}


def _field(f: dict) -> dict:
    kind, fmt = f.get("type", "string"), f.get("format")
    datatype: dict[str, Any] = {"base": _FIELD_TYPES.get(kind, "string")}
    if kind == "string":
        datatype["base"] = {"binary": "binary", "uri": "anyURI"}.get(fmt, "string")
    if kind in ("number", "integer"):
        marks = {k: f[k] for k in ("decimalChar", "groupChar") if k in f} | ({"bareNumber": False} if f.get("bareNumber") is False else {})
        if marks:
            datatype["format"] = marks
    if kind == "boolean" and ("trueValues" in f or "falseValues" in f):
        datatype["format"] = f"{f.get('trueValues', ['true'])[0]}|{f.get('falseValues', ['false'])[0]}"
    if kind in ("date", "time", "datetime") and fmt not in (None, "default", "any"):
        datatype["format"] = fmt
    limits = f.get("constraints", {})
    if datatype["base"] not in ("json", "boolean", "any"):
        for k in ("minimum", "maximum"):
            if k in limits and kind not in ("string",):
                datatype[k] = limits[k]
        for k in ("minLength", "maxLength"):
            if k in limits and kind == "string":
                datatype[k] = limits[k]
    if "pattern" in limits and "format" not in datatype and kind == "string":
        datatype["format"] = limits["pattern"]
    out: dict[str, Any] = {"name": f["name"], "datatype": datatype if len(datatype) > 1 else datatype["base"]}
    if limits.get("required"):
        out["required"] = True
    if "title" in f:
        out["titles"] = f["title"]
    if "description" in f:
        out["dc:description"] = f["description"]
    if "rdfType" in f:
        out["propertyUrl"] = f["rdfType"]
    return out


def _dialect(d: dict) -> dict:
    names = {"delimiter": "delimiter", "quoteChar": "quoteChar", "doubleQuote": "doubleQuote", "skipInitialSpace": "skipInitialSpace", "header": "header", "commentChar": "commentPrefix", "lineTerminator": "lineTerminators"}
    return {names[k]: v for k, v in d.items() if k in names}


def from_datapackage(package: str | Path | dict) -> dict:
    """A description of the tables (csv files with a schema) of a data package."""
    if isinstance(package, (str, Path)):
        text = str(package)
        package = json.loads(text) if text.lstrip().startswith("{") else json.loads(Path(text).read_text(encoding="utf-8"))
    paths = {r["name"]: r["path"] for r in package.get("resources", []) if isinstance(r.get("path"), str)}
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    tables = []
    for r in package.get("resources", []):
        if r.get("scheme", "file") != "file" or r.get("format", "csv") != "csv" or "schema" not in r:
            continue
        s = r["schema"]
        schema: dict[str, Any] = {"columns": [_field(f) for f in s.get("fields", [])]}
        if "missingValues" in s:
            schema["null"] = s["missingValues"]
        if "primaryKey" in s:
            schema["primaryKey"] = listed(s["primaryKey"])
        keys = [{"columnReference": listed(k["fields"]), "reference": {"resource": paths[k["reference"]["resource"]] if k["reference"]["resource"] else r["path"], "columnReference": listed(k["reference"]["fields"])}} for k in s.get("foreignKeys", [])]
        if keys:
            schema["foreignKeys"] = keys
        table: dict[str, Any] = {"url": r["path"], "tableSchema": schema}
        dialect = _dialect(r.get("dialect", {})) | ({"encoding": r["encoding"]} if "encoding" in r else {})
        if dialect:
            table["dialect"] = dialect
        tables.append(table)
    out: dict[str, Any] = {"@context": CONTEXT, "tables": tables}
    for key, name in (("title", "dc:title"), ("description", "dc:description"), ("id", "dc:identifier"), ("homepage", "dcat:landingPage")):
        if key in package:
            out[name] = package[key]
    if package.get("licenses"):
        out["dc:license"] = package["licenses"][0].get("path") or package["licenses"][0].get("name")
    return out


def to_markdown(group: TableGroup) -> str:
    """A readable account of a group: its properties, tables, columns and keys."""

    def properties(common: dict) -> list[str]:
        return [f"{k} | {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in common.items()]

    def anchor(text: str) -> str:
        return "table-" + re.sub(r"[^a-z0-9]+", "", text.lower())

    out = ["# " + str(group.common.get("dc:title", "Dataset")), ""]
    if group.common:
        out += ["property | value", " --- | ---", *properties(group.common), ""]
    for t in group.tables:
        out += [f"## <a name=\"{anchor(t.url)}\"></a>Table {t.url}", ""]
        if t.common or t.schema.primary_key:
            out += ["property | value", " --- | ---", *properties(t.common)]
            out += [f"primary key | {', '.join(f'`{k}`' for k in t.schema.primary_key)}"] if t.schema.primary_key else []
            out += [""]
        targets = {c: k for k in t.schema.foreign_keys for c in k.columns}
        out += ["### Columns", "", "Name/Property | Datatype | Description", " --- | --- | --- "]
        for c in t.schema.columns:
            kind = c.inherit("datatype") or Datatype()
            name = f"[{c.header}]({c.own['propertyUrl']})" if "propertyUrl" in c.own else f"`{c.header}`"
            shown = f"list of `{kind.base}` (separated by `{c.inherit('separator')}`)" if c.inherit("separator") else f"`{kind.base}`"
            notes = [str(c.common[k]) for k in ("dc:description", "rdfs:comment") if k in c.common]
            notes += ["required"] if c.inherit("required") else []
            notes += [f"{k}: {v}" for k, v in kind.facets.items()] + ([f"format: {json.dumps(kind.format, ensure_ascii=False)}"] if kind.format else [])
            if c.name in t.schema.primary_key:
                notes.append("Primary key")
            if key := targets.get(c.header):
                notes.append(f"References [{key.resource or key.schema_reference}::{','.join(key.target)}](#{anchor(key.resource or '')})")
            out.append(f"{name} | {shown} | {'<br>'.join(notes)}")
        out.append("")
    return "\n".join(out)
