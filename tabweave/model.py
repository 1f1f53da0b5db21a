"""Descriptions of tables: metadata JSON to objects and back.  Driver only, no data."""

from __future__ import annotations

import copy
import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any
from urllib.parse import urljoin, urlparse

from . import validators
from .functions import uritemplate
from .functions.types import BOUNDS, LENGTHS, REGISTRY, Compiled, compile_datatype
from .sources.dialect import Dialect

#: The metadata context, and prefixes of its vocabulary that are used in names; fixed values.
CONTEXT = "http://www.w3.org/ns/csvw"
NAMESPACES = {
    "csvw": "http://www.w3.org/ns/csvw#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dc": "http://purl.org/dc/terms/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "http://schema.org/",
    "as": "https://www.w3.org/ns/activitystreams#",
    "cc": "http://creativecommons.org/ns#",
    "ctag": "http://commontag.org/ns#",
    "dc11": "http://purl.org/dc/elements/1.1/",
    "dctypes": "http://purl.org/dc/dcmitype/",
    "dqv": "http://www.w3.org/ns/dqv#",
    "duv": "https://www.w3.org/ns/duv#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "gr": "http://purl.org/goodrelations/v1#",
    "grddl": "http://www.w3.org/2003/g/data-view#",
    "ical": "http://www.w3.org/2002/12/cal/icaltzd#",
    "jsonld": "http://www.w3.org/ns/json-ld#",
    "ldp": "http://www.w3.org/ns/ldp#",
    "ma": "http://www.w3.org/ns/ma-ont#",
    "oa": "http://www.w3.org/ns/oa#",
    "odrl": "http://www.w3.org/ns/odrl/2/",
    "og": "http://ogp.me/ns#",
    "org": "http://www.w3.org/ns/org#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "qb": "http://purl.org/linked-data/cube#",
    "rdfa": "http://www.w3.org/ns/rdfa#",
    "rev": "http://purl.org/stuff/rev#",
    "rif": "http://www.w3.org/2007/rif#",
    "rr": "http://www.w3.org/ns/r2rml#",
    "sd": "http://www.w3.org/ns/sparql-service-description#",
    "sioc": "http://rdfs.org/sioc/ns#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "skosxl": "http://www.w3.org/2008/05/skos-xl#",
    "sosa": "http://www.w3.org/ns/sosa/",
    "ssn": "http://www.w3.org/ns/ssn/",
    "time": "http://www.w3.org/2006/time#",
    "v": "http://rdf.data-vocabulary.org/#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "void": "http://rdfs.org/ns/void#",
    "wdr": "http://www.w3.org/2007/05/powder#",
    "wrds": "http://www.w3.org/2007/05/powder-s#",
    "xhv": "http://www.w3.org/1999/xhtml/vocab#",
    "xml": "http://www.w3.org/XML/1998/namespace",
}
INHERITED = ("null", "lang", "textDirection", "separator", "ordered", "default", "datatype", "aboutUrl", "propertyUrl", "valueUrl", "required")


def is_url(text: str) -> bool:
    return urlparse(str(text)).scheme in ("http", "https")


def expand_name(name: str) -> str:
    """``prefix:name`` with a known prefix as a URL."""
    prefix, colon, rest = str(name).partition(":")
    return NAMESPACES[prefix] + rest if colon and prefix in NAMESPACES and not rest.startswith("//") else name


def compact_name(url: str) -> str:
    """A URL in a known namespace as ``prefix:name``."""
    best = max((p for p, u in NAMESPACES.items() if str(url).startswith(u)), key=lambda p: len(NAMESPACES[p]), default=None)
    return f"{best}:{url[len(NAMESPACES[best]):]}" if best else url


@dataclass
class NaturalLanguage:
    """Strings by language tag."""

    values: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, v: Any) -> NaturalLanguage | None:
        if v is None or isinstance(v, cls):
            return v
        listed = lambda x: [y for y in (x if isinstance(x, list) else [x]) if isinstance(y, str)]
        if isinstance(v, dict):
            for k in v:
                if not validators.is_language(k):
                    warnings.warn(f"not a language tag: {k}", stacklevel=2)
            return cls({k: listed(x) for k, x in v.items() if validators.is_language(k)})
        if isinstance(v, (str, list)):
            return cls({"und": listed(v)})
        warnings.warn(f"not a natural language property: {v!r}", stacklevel=2)
        return cls()

    def add(self, text: str, lang: str = "und") -> None:
        self.values.setdefault(lang, []).append(text)

    def first(self, lang: str = "und") -> str | None:
        return next((x for x in self.values.get(lang, [])), None) or next((x for xs in self.values.values() for x in xs), None)

    def all(self) -> Iterator[tuple[str, str]]:
        return ((lang, x) for lang, xs in self.values.items() for x in xs)

    def asdict(self) -> Any:
        if list(self.values) == ["und"]:
            return self.values["und"][0] if len(self.values["und"]) == 1 else self.values["und"]
        return {k: v[0] if len(v) == 1 else v for k, v in self.values.items()}


@dataclass
class Datatype:
    base: str = "string"
    format: Any = None
    facets: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, v: Any) -> Datatype | None:
        if v is None or isinstance(v, cls):
            return v
        if isinstance(v, str):
            v = {"base": v}
        if not isinstance(v, dict):
            raise ValueError(f"not a datatype: {v!r}")
        base = v.get("base", "string")
        if base not in REGISTRY:
            warnings.warn(f"unknown datatype: {base}", stacklevel=2)
            base = "string"
        if str(v.get("@id", "")) in {NAMESPACES["xsd"] + n for n in REGISTRY}:
            raise ValueError("a derived datatype may not have the @id of a built-in one")
        facets = {k: v[k] for k in (*LENGTHS, *BOUNDS) if v.get(k) is not None}
        made = cls(base, v.get("format"), facets, {k: x for k, x in v.items() if k not in ("base", "format", *facets)})
        made.compiled()
        return made

    def compiled(self) -> Compiled:
        return compile_datatype(self.base, self.format, **self.facets)

    def asdict(self) -> Any:
        d = {"base": self.base, **({"format": self.format} if self.format is not None else {}), **self.facets, **self.extra}
        return self.base if len(d) == 1 else d


@dataclass
class Description:
    """What all descriptions have: own inherited properties, common and @-properties."""

    own: dict[str, Any] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)
    at: dict[str, Any] = field(default_factory=dict)
    parent: Description | None = field(default=None, repr=False, compare=False)

    def _take(self, v: dict, known: tuple[str, ...]) -> dict:
        rest = {}
        for k, x in v.items():
            if k in INHERITED:
                self.own[k] = validators.inherited_property(k, x)
            elif k.startswith("@"):
                self.at[k] = validators.at_property(k, x, type(self).__name__)
            elif k in known:
                rest[k] = x
            elif ":" in k:
                self.common[k] = validators.common_property(x, NAMESPACES)
            else:
                warnings.warn(f"unknown property: {k}", stacklevel=3)
        if "null" in self.own:
            n = self.own["null"]
            self.own["null"] = [n] if isinstance(n, str) else list(n)
        if "datatype" in self.own:
            self.own["datatype"] = Datatype.of(self.own["datatype"])
        for k in ("aboutUrl", "propertyUrl", "valueUrl"):
            if k in self.own and not isinstance(self.own[k], str):
                warnings.warn(f"{k} is no template: {self.own[k]!r}", stacklevel=3)
                self.own[k] = None
        return rest

    def inherit(self, name: str) -> Any:
        """Own value, else that of the nearest description above that has one.

        ``default`` and ``lang`` have values of their own everywhere and so never come from
        above; ``null`` comes from above while it is the default ``[""]``.
        """
        if name in ("default", "lang"):
            return self.own.get(name, {"default": "", "lang": "und"}[name])
        node: Description | None = self
        while node is not None:
            value = node.own.get(name)
            if name == "null":
                if value is not None and value != [""]:
                    return value
            elif value is not None:
                return value
            node = node.parent
        return [""] if name == "null" else False if name == "required" else None

    def _json(self) -> dict:
        own = {k: v.asdict() if isinstance(v, Datatype) else v[0] if k == "null" and len(v) == 1 else v for k, v in self.own.items() if v is not None}
        return {**self.at, **self.common, **own}


@dataclass
class Column(Description):
    name: str | None = None
    titles: NaturalLanguage | None = None
    virtual: bool = False
    suppress_output: bool = False
    number: int | None = None

    @classmethod
    def of(cls, v: dict | str, parent: Description | None = None, number: int | None = None) -> Column:
        v = {"name": v} if isinstance(v, str) else v
        made = cls(parent=parent, number=number)
        rest = made._take(v, ("name", "titles", "virtual", "suppressOutput"))
        made.name, made.titles = rest.get("name"), NaturalLanguage.of(rest.get("titles"))
        made.virtual, made.suppress_output = bool(rest.get("virtual")), bool(rest.get("suppressOutput"))
        return made

    @property
    def header(self) -> str:
        return self.name or (self.titles and self.titles.first()) or f"_col.{self.number}"

    def has_title(self, text: str) -> bool:
        return self.name == text or (self.titles is not None and any(x == text for _, x in self.titles.all()))

    def title_language(self, text: str) -> str | None:
        """The language in which a text is a title of the column, if it is not its name."""
        if self.name == text or self.titles is None:
            return None
        return next((lang for lang, x in self.titles.all() if x == text), None)

    def asdict(self) -> dict:
        d = {"name": self.name, "titles": self.titles.asdict() if self.titles else None, "virtual": self.virtual or None, "suppressOutput": self.suppress_output or None}
        return {**{k: v for k, v in d.items() if v is not None}, **self._json()}


@dataclass
class ForeignKey:
    columns: list[str]
    resource: str | None
    schema_reference: str | None
    target: list[str]

    @classmethod
    def of(cls, v: dict) -> ForeignKey:
        listed = lambda x: [x] if isinstance(x, str) else list(x)
        ref = v["reference"]
        if ("resource" in ref) == ("schemaReference" in ref):
            raise ValueError("a reference names either a resource or a schema")
        return cls(listed(v["columnReference"]), ref.get("resource"), ref.get("schemaReference"), listed(ref["columnReference"]))

    def asdict(self) -> dict:
        where = {"resource": self.resource} if self.resource else {"schemaReference": self.schema_reference}
        return {"columnReference": self.columns, "reference": {**where, "columnReference": self.target}}


@dataclass
class Schema(Description):
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    row_titles: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, v: dict | None, parent: Description | None = None) -> Schema:
        made = cls(parent=parent)
        rest = made._take(copy.deepcopy(v) or {}, ("columns", "primaryKey", "foreignKeys", "rowTitles"))
        listed = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
        made.columns = [Column.of(c, made, i + 1) for i, c in enumerate(rest.get("columns") or [])]
        made.primary_key, made.row_titles = listed(rest.get("primaryKey")), listed(rest.get("rowTitles"))
        made.foreign_keys = [ForeignKey.of(k) for k in rest.get("foreignKeys") or []]
        made.check()
        return made

    def check(self) -> None:
        names = [c.name for c in self.columns if c.name]
        if len(set(names)) < len(names):
            raise ValueError(f"a column name is used twice: {names}")
        headers = [c.header for c in self.columns]
        if len(set(headers)) < len(headers):
            warnings.warn(f"a header is used twice: {headers}", stacklevel=2)
        if any(n.startswith("_") or any(x.isspace() for x in n) for n in names):
            warnings.warn(f"not a column name: {names}", stacklevel=2)
        seen_virtual = False
        for c in self.columns:
            if seen_virtual and not c.virtual:
                raise ValueError("virtual columns come last")
            seen_virtual |= c.virtual
        if self.primary_key and any(self.column(k) is None for k in self.primary_key):
            raise ValueError(f"the primary key names a column that is not there: {self.primary_key}")

    def column(self, spec: str) -> Column | None:
        """By header, then by title, then by property URL."""
        for test in (lambda c: c.header == spec, lambda c: c.has_title(spec), lambda c: c.own.get("propertyUrl") == spec):
            found = next((c for c in self.columns if test(c)), None)
            if found:
                return found
        return None

    def asdict(self) -> dict:
        one = lambda x: x[0] if len(x) == 1 else x
        d = {"columns": [c.asdict() for c in self.columns]} if self.columns else {}
        d |= {"primaryKey": one(self.primary_key)} if self.primary_key else {}
        d |= {"foreignKeys": [k.asdict() for k in self.foreign_keys]} if self.foreign_keys else {}
        d |= {"rowTitles": one(self.row_titles)} if self.row_titles else {}
        return {**d, **self._json()}


@dataclass
class Table(Description):
    url: str = ""
    schema: Schema = field(default_factory=Schema)
    dialect: Dialect | None = None
    notes: list = field(default_factory=list)
    suppress_output: bool = False
    inert: dict[str, Any] = field(default_factory=dict)
    base: str | None = None

    KNOWN = ("url", "tableSchema", "dialect", "notes", "suppressOutput", "tableDirection", "transformations")

    @classmethod
    def of(cls, v: dict, parent: Description | None = None, base: str | None = None) -> Table:
        made = cls(parent=parent, base=base)
        rest = made._take(v, cls.KNOWN)
        schema = rest.get("tableSchema")
        if isinstance(schema, str):
            schema = load_json(resolve(schema, base))
        made.url, made.schema = rest.get("url", ""), Schema.of(schema, made)
        made.dialect = Dialect.of(rest["dialect"], described=True) if "dialect" in rest else None
        made.notes, made.suppress_output = rest.get("notes") or [], bool(rest.get("suppressOutput"))
        made.inert = _inert(rest)
        return made

    @property
    def effective_dialect(self) -> Dialect:
        return self.dialect or getattr(self.parent, "dialect", None) or Dialect(comment_prefix=None)

    @property
    def local_name(self) -> str:
        return self.url

    @property
    def location(self) -> str:
        return resolve(self.url, self.base)

    def add_foreign_key(self, columns: str | list[str], resource: str, target: str | list[str]) -> None:
        key = ForeignKey.of({"columnReference": columns, "reference": {"resource": resource, "columnReference": target}})
        for c in key.columns:
            if self.schema.column(c) is None:
                raise ValueError(f"no column {c}")
        self.schema.foreign_keys.append(key)

    def expand(self, template: str | None, row: dict, rownum: int = 1, sourcenum: int = 1, name: str | None = None, qname: bool = False) -> str:
        """A template filled from a row, with prefixes expanded, relative to the table's URL."""
        if not isinstance(template, str):
            return self.url
        made = uritemplate.expand(template, {"_row": rownum, "_sourceRow": sourcenum, "_name": name, **row})
        made = expand_name(made)
        made = made if is_url(made) else urljoin(self.url, made) if not made.startswith("#") else self.url + made
        return compact_name(made) if qname else made

    def asdict(self) -> dict:
        d: dict[str, Any] = {"url": self.url}
        d |= {"tableSchema": self.schema.asdict()} if self.schema.asdict() else {}
        d |= {"dialect": self.dialect.asdict()} if self.dialect else {}
        d |= {"notes": self.notes} if self.notes else {}
        d |= {"suppressOutput": True} if self.suppress_output else {}
        return {**self._json(), **d, **self.inert}


@dataclass
class TableGroup(Description):
    tables: list[Table] = field(default_factory=list)
    dialect: Dialect | None = None
    notes: list = field(default_factory=list)
    inert: dict[str, Any] = field(default_factory=dict)
    base: str | None = None
    single: bool = False

    @classmethod
    def of(cls, v: dict, base: str | None = None) -> TableGroup:
        """From a description of a group or of one table."""
        v = copy.deepcopy(v)
        check_context(v.get("@context", CONTEXT))
        if "tables" not in v:
            made = cls(base=base, single=True)
            context = v.pop("@context", None)
            made.at = {"@context": context} if context else {}
            made.tables = [Table.of(v, made, base)]
            return made
        made = cls(base=base)
        rest = made._take(v, ("tables", "tableSchema", "dialect", "notes", "tableDirection", "transformations", "id", "url"))
        made.dialect = Dialect.of(rest["dialect"], described=True) if "dialect" in rest else None
        made.notes = rest.get("notes") or []
        made.inert = _inert(rest)
        for t in rest["tables"]:
            if "tableSchema" in rest and "tableSchema" not in t:
                t = {**t, "tableSchema": rest["tableSchema"]}
            made.tables.append(Table.of(t, made, base))
        return made

    @classmethod
    def from_file(cls, path: str | Path) -> TableGroup:
        return cls.of(load_json(str(path)), str(path))

    def table(self, url: str) -> Table | None:
        return next((t for t in self.tables if t.url == url), None)

    def foreign_keys(self) -> list[tuple[Table, ForeignKey]]:
        return [(t, k) for t in self.tables for k in t.schema.foreign_keys if k.resource]

    def validate_schema(self) -> None:
        """Do all foreign keys fit the tables and columns that they name?"""
        for t, key in self.foreign_keys():
            parent = self.table(key.resource)
            if parent is None:
                raise ValueError(f"{t.url}: no table {key.resource}")
            if len(key.columns) != len(key.target):
                raise ValueError(f"{t.url}: a foreign key with {len(key.columns)} columns for {len(key.target)}")
            for c, p in zip(key.columns, key.target, strict=True):
                mine, theirs = t.schema.column(c), parent.schema.column(p)
                if mine is None or theirs is None:
                    raise ValueError(f"{t.url}: a foreign key with a column that is not there: {c}, {p}")
                kinds = [(x.inherit("datatype") or Datatype()).base for x in (mine, theirs)]
                if kinds[0] != kinds[1]:
                    raise ValueError(f"{t.url}: {c} is {kinds[0]}, {p} is {kinds[1]}")

    def asdict(self) -> dict:
        if self.single:
            return {"@context": CONTEXT, **self.at, **self.tables[0].asdict()}
        d = {"@context": CONTEXT, **self._json(), "tables": [t.asdict() for t in self.tables], **self.inert}
        d |= {"dialect": self.dialect.asdict()} if self.dialect else {}
        return d | ({"notes": self.notes} if self.notes else {})

    def to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.asdict(), indent=4, ensure_ascii=False), encoding="utf-8")


def _inert(rest: dict) -> dict:
    """Properties that are checked and written again, and say nothing to a scan."""
    kept = {k: rest[k] for k in ("tableDirection", "transformations") if k in rest}
    if "transformations" in kept:
        kept["transformations"] = validators.transformations(kept["transformations"])
    if kept.get("tableDirection", "auto") not in ("rtl", "ltr", "auto"):
        warnings.warn(f"not a value of tableDirection: {kept.pop('tableDirection')!r}", stacklevel=3)
    return kept


def check_context(context: Any) -> None:
    if context == CONTEXT or (isinstance(context, list) and context and context[0] == CONTEXT and all(isinstance(x, dict) and set(x) <= {"@base", "@language"} for x in context[1:])):
        return
    raise ValueError(f"not a metadata context: {context!r}")


def resolve(link: str, base: str | None) -> str:
    """A link relative to where its description lies."""
    if is_url(link) or base is None:
        return link
    if is_url(base):
        return urljoin(base, link)
    return str(Path(base).parent / link)


def load_json(where: str) -> Any:
    from .discover import fetch

    return json.loads(fetch(where).decode("utf-8-sig"))


__all__ = ["CONTEXT", "Column", "Datatype", "Description", "Dialect", "ForeignKey", "NaturalLanguage", "Schema", "Table", "TableGroup", "compact_name", "expand_name", "replace", "resolve"]
