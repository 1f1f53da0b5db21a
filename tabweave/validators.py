"""What the properties of a description may hold.

A breach of a rule that makes the description meaningless is a ValueError; a value that a
processor is told to leave out warns, and the default stands in.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from typing import Any
from urllib.parse import urlparse

# Terms of the recommendation's context; fixed values.
TERMS = frozenset(
    """
    Cell Column Datatype Dialect Direction ForeignKey JSON NumericFormat Row Schema Table TableGroup TableReference
    Transformation aboutUrl base columnReference columns commentPrefix datatype decimalChar default delimiter describes
    dialect doubleQuote encoding foreignKeys format groupChar header headerRowCount json lang length lineTerminators
    maxExclusive maxInclusive maxLength maximum minExclusive minInclusive minLength minimum name notes null ordered
    pattern primaryKey propertyUrl quoteChar reference referencedRows required resource row rowTitles rownum
    schemaReference scriptFormat separator skipBlankRows skipColumns skipInitialSpace skipRows source suppressOutput
    tableDirection tableSchema tables targetFormat textDirection titles transformations trim uriTemplate url valueUrl
    virtual
    """.split()
)
_OBJECT_KEYS = {"@id", "@language", "@type", "@value"}
_LANGUAGE = re.compile(r"(?:[A-Za-z]{2,8}|[xi](?=-))(?:-[A-Za-z0-9]{1,8})*")


def is_language(tag: Any) -> bool:
    return isinstance(tag, str) and bool(_LANGUAGE.fullmatch(tag))


def link_id(value: Any) -> str | None:
    if not isinstance(value, str):
        warnings.warn(f"@id is no link: {value!r}", stacklevel=3)
        return None
    if value.startswith("_"):
        raise ValueError(f"@id may not be a blank node: {value}")
    return value


def _type_of_object(value: Any, prefixes: dict[str, str]) -> None:
    if isinstance(value, list):
        for v in value:
            _type_of_object(v, prefixes)
    elif not isinstance(value, str):
        raise ValueError(f"not a @type: {value!r}")
    elif value.startswith("_:"):
        raise ValueError(f"@type may not be a blank node: {value}")
    elif urlparse(value).scheme not in ("http", "https") and value not in TERMS and value.partition(":")[0] not in prefixes:
        raise ValueError(f"@type is neither a term, nor a prefixed name, nor a URL: {value}")


def common_property(value: Any, prefixes: dict[str, str]) -> Any:
    """The value of a common property: any JSON whose objects keep the rules of linked data."""
    if isinstance(value, list):
        return [common_property(v, prefixes) for v in value]
    if not isinstance(value, dict):
        return value
    at = {k for k in value if k.startswith("@")}
    if at - _OBJECT_KEYS:
        raise ValueError(f"not allowed in an object: {sorted(at - _OBJECT_KEYS)}")
    if "@value" in value:
        if len(value) > 2 or value.keys() - {"@value", "@language", "@type"}:
            raise ValueError("beside @value there may be either @language or @type")
        if not isinstance(value["@value"], (str, bool, int, float)):
            raise ValueError(f"@value is neither text, nor number, nor boolean: {value['@value']!r}")
    elif "@language" in value:
        raise ValueError("@language needs a @value")
    out = dict(value)
    if "@id" in out:
        out["@id"] = link_id(out["@id"])
    if "@language" in out and not is_language(out["@language"]):
        warnings.warn(f"not a language tag: {out.pop('@language')!r}", stacklevel=3)
    if "@type" in out:
        _type_of_object(out["@type"], prefixes)
    return {k: v if k in _OBJECT_KEYS else common_property(v, prefixes) for k, v in out.items()}


def _one_of(*allowed: Any) -> Callable[[Any], bool]:
    return lambda v: v in allowed


#: Inherited properties: what a value has to be, and what stands in for another one.
_INHERITED: dict[str, tuple[Callable[[Any], bool], Any]] = {
    "null": (lambda v: isinstance(v, str) or isinstance(v, list) and all(isinstance(x, str) for x in v), [""]),
    "lang": (is_language, "und"),
    "default": (lambda v: isinstance(v, str), ""),
    "separator": (lambda v: v is None or isinstance(v, str) and v != "", None),
    "ordered": (lambda v: v is None or isinstance(v, bool), False),
    "required": (lambda v: v is None or isinstance(v, bool), False),
    "textDirection": (_one_of(None, "ltr", "rtl", "auto", "inherit"), None),
}


def inherited_property(name: str, value: Any) -> Any:
    fits, default = _INHERITED.get(name, (lambda v: True, None))
    if value is None and name == "null":
        return []
    if fits(value):
        return value
    warnings.warn(f"not a value of {name}: {value!r}", stacklevel=3)
    return default


def at_property(name: str, value: Any, kind: str) -> Any:
    """An @-property of a description of one kind (Table, Schema, ...)."""
    if name == "@id":
        return link_id(value)
    if name == "@type" and value != kind:
        raise ValueError(f"@type of a {kind} is {value!r}")
    return value


def transformations(value: Any) -> list:
    if not isinstance(value, list):
        warnings.warn(f"transformations are no list: {value!r}", stacklevel=3)
        return []
    for v in value:
        if not isinstance(v, dict):
            warnings.warn(f"not a transformation: {v!r}", stacklevel=3)
        elif v.get("@type", "Template") != "Template":
            raise ValueError(f"@type of a Template is {v['@type']!r}")
    return value
