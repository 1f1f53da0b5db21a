"""JSON Schema: one predicate over parsed documents, or a function where no expression can tell."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_
from typing import Any
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that need to know what all others have looked at; fixed names.
_NEED_ALL = ("unevaluatedProperties", "unevaluatedItems")
#: Schemas in one predicate, references followed; of more, a function checks the documents.
MOST_PREDICATES = 300


class _NoPredicate(Exception):
    """A schema that comes back to itself, needs what its parts have looked at, or is too large."""


def resolve(root: Any, ref: str) -> dict | bool:
    """What a local reference stands for: a pointer (``#/$defs/x``), an anchor or the whole schema.

    A reference to another document, or to nothing, warns and allows everything."""
    where, _, fragment = ref.partition("#")
    found: Any = root
    if where and not (isinstance(root, dict) and where == str(root.get("$id", "")).partition("#")[0]):
        found = None
    elif fragment.startswith("/"):
        for step in unquote(fragment)[1:].split("/"):
            step = step.replace("~1", "/").replace("~0", "~")
            found = found.get(step) if isinstance(found, dict) else found[int(step)] if isinstance(found, list) and step.isdigit() and int(step) < len(found) else None
    elif fragment:
        found = next((x for x in _schemas(root) if x.get("$anchor") == fragment or x.get("$id") == f"#{fragment}"), None)
    if not isinstance(found, dict | bool):
        warnings.warn(f"reference that cannot be followed: {ref}", stacklevel=2)
        return True
    return found


def _schemas(x: Any) -> Iterator[dict]:
    if isinstance(x, dict):
        yield x
    for sub in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _schemas(sub)


class References:
    """References of a schema as they are followed, and how many schemas a predicate holds by now."""

    def __init__(self, root: dict):
        self.root, self.open, self.n = root, [], 0

    def count(self) -> None:
        self.n += 1
        if self.n > MOST_PREDICATES:
            raise _NoPredicate

    @contextmanager
    def followed(self, ref: str) -> Iterator[dict | bool]:
        if ref in self.open:
            raise _NoPredicate
        self.open.append(ref)
        yield resolve(self.root, ref)
        self.open.pop()


def java_part(pattern: str) -> str:
    """A pattern that may match anywhere, in Java's notation."""
    return re.sub(r"[(][?]P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)


#: Keywords that say nothing about what is valid; fixed names.
_SAYS_NOTHING = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "$anchor", "readOnly", "writeOnly", "deprecated", "format"}
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


def _same_json(at: Column, value: object) -> Column:
    """Is a document equal to a value?  Compared as normalised text, so the order of keys counts not."""
    made = F.try_parse_json(F.lit(json.dumps(value)))
    return F.to_json(at) == F.to_json(made)


def schema_predicate(at: Column, schema: dict | bool, refs: References) -> Column:
    """A JSON Schema as one predicate over a parsed document (a variant).

    Knows all that :func:`fits_schema` does but references that come back to themselves and the
    keywords of :data:`_NEED_ALL`."""
    refs.count()
    if isinstance(schema, bool):
        return F.lit(schema)
    # The kind of a document is worked out once, as a field of a function's variable.
    told = F.array(F.struct(at.alias("at"), F.coalesce(F.schema_of_variant(at), F.lit("")).alias("kind")))
    return F.coalesce(F.exists(told, lambda x: _predicate(x["at"], x["kind"], schema, refs)), F.lit(False))


def _predicate(at: Column, kind: Column, schema: dict, refs: References) -> Column:
    known, ok = set(_SAYS_NOTHING), F.lit(True)
    # A null inside a document is a variant of its own kind, with no value of any type.
    is_a = lambda *names: reduce(or_, [kind.startswith(n) for t in names for n in _KINDS.get(t, [])], F.lit(False))

    def fits(sub: dict | bool) -> Callable[[Column], Column]:
        return lambda x: schema_predicate(x, sub, refs)

    def key_is_like(pattern: str, like: bool) -> Callable[[Column, Column], Column]:
        return lambda k, _: k.rlike(java_part(pattern)) if like else ~k.rlike(java_part(pattern))

    def take(*keys: str):
        known.update(keys)
        return ((k, schema[k]) for k in keys if k in schema)

    number = F.when(is_a("number"), F.try_variant_get(at, "$", "double"))
    text = F.when(is_a("string"), F.try_variant_get(at, "$", "string"))
    entries = F.when(is_a("object"), F.try_variant_get(at, "$", "map<string,variant>"))
    items = F.when(is_a("array"), F.try_variant_get(at, "$", "array<variant>"))
    for _, wanted in take("type"):
        wanted = wanted if isinstance(wanted, list) else [wanted]
        whole = is_a("number") & (number == F.floor(number)) if "integer" in wanted else F.lit(False)
        ok = ok & (is_a(*wanted) | whole)
    for _, values in take("enum"):
        ok = ok & F.array_max(F.array(F.lit(False), *[_same_json(at, v) for v in values]))
    for _, value in take("const"):
        ok = ok & _same_json(at, value)
    bounds = {"minimum": lambda n, b: n >= b, "maximum": lambda n, b: n <= b, "exclusiveMinimum": lambda n, b: n > b, "exclusiveMaximum": lambda n, b: n < b, "multipleOf": lambda n, b: F.abs(n / b - F.round(n / b)) < 1e-9}
    for key, bound in take(*bounds):
        ok = ok & (number.isNull() | bounds[key](number, F.lit(float(bound))))
    sizes = {"minLength": (text, F.length), "maxLength": (text, F.length), "minItems": (items, F.size), "maxItems": (items, F.size), "minProperties": (entries, F.size), "maxProperties": (entries, F.size)}
    for key, bound in take(*sizes):
        what, size = sizes[key]
        ok = ok & (what.isNull() | (size(what) >= bound if key.startswith("min") else size(what) <= bound))
    for _, pattern in take("pattern"):
        ok = ok & (text.isNull() | text.rlike(java_part(pattern)))
    head = next((x for _, x in take("prefixItems")), None)
    each = next((x for _, x in take("items")), None)
    rest = next((x for _, x in take("additionalItems")), None)
    if isinstance(each, list):
        head, each = each, rest
    for i, sub in enumerate(head or ()):
        ok = ok & (items.isNull() | (F.size(items) <= i) | schema_predicate(F.get(items, F.lit(i)), sub, refs))
    if each is not None:
        later = F.slice(items, len(head) + 1, F.greatest(F.size(items) - len(head), F.lit(0))) if head else items
        ok = ok & (items.isNull() | F.forall(later, fits(each)))
    low, high = (next((x for _, x in take(k)), None) for k in ("minContains", "maxContains"))
    for _, sub in take("contains"):
        n = F.size(F.filter(items, fits(sub)))
        ok = ok & (items.isNull() | (n >= (1 if low is None else low)) & (n <= (2**31 - 1 if high is None else high)))
    for _, unique in take("uniqueItems"):
        ok = ok & (items.isNull() | (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) == F.size(items)) if unique else F.lit(True))
    def member(name: str) -> Column:
        """A key's value, null if there is none: by its path, or of all entries where no path names it."""
        if '"' in name or "\\" in name:
            return F.try_element_at(entries, F.lit(name))
        return F.try_variant_get(at, f'$["{name}"]', "variant")

    for _, names in take("required"):
        ok = ok & (reduce(and_, [member(n).isNotNull() for n in names], F.lit(True)) | ~is_a("object"))
    named = next((x for _, x in take("properties")), {})
    for key, sub in named.items():
        ok = ok & (member(key).isNull() | schema_predicate(member(key), sub, refs) | ~is_a("object"))
    matched = next((x for _, x in take("patternProperties")), {})
    for pattern, sub in matched.items():
        ok = ok & (entries.isNull() | F.forall(F.map_values(F.map_filter(entries, key_is_like(pattern, True))), fits(sub)))
    for _, sub in take("additionalProperties"):
        others = F.map_filter(entries, lambda k, _: ~k.isin(list(named)) if named else F.lit(True))
        for pattern in matched:
            others = F.map_filter(others, key_is_like(pattern, False))
        ok = ok & (entries.isNull() | F.forall(F.map_values(others), fits(sub)))
    for _, sub in take("propertyNames"):
        names = F.transform(F.map_keys(entries), lambda k: F.try_variant_get(F.try_parse_json(F.to_json(F.array(k))), "$[0]", "variant"))
        ok = ok & (entries.isNull() | F.forall(names, fits(sub)))
    for key in ("dependentRequired", "dependentSchemas", "dependencies"):
        for _, by_name in take(key):
            for name, then in by_name.items():
                wanted = reduce(and_, [member(n).isNotNull() for n in then], F.lit(True)) if isinstance(then, list) else schema_predicate(at, then, refs)
                ok = ok & (member(name).isNull() | wanted | ~is_a("object"))
    for _, ref in take("$ref"):
        with refs.followed(ref) as target:
            ok = ok & schema_predicate(at, target, refs)
    count = lambda subs: sum((schema_predicate(at, x, refs).cast("int") for x in subs), F.lit(0))
    for _, subs in take("allOf"):
        ok = ok & (count(subs) == len(subs))
    for _, subs in take("anyOf"):
        ok = ok & (count(subs) > 0)
    for _, subs in take("oneOf"):
        ok = ok & (count(subs) == 1)
    for _, sub in take("not"):
        ok = ok & ~schema_predicate(at, sub, refs)
    for _, sub in take("if"):
        ok = ok & F.when(schema_predicate(at, sub, refs), schema_predicate(at, schema.get("then", True), refs)).otherwise(schema_predicate(at, schema.get("else", True), refs))
    known |= {"then", "else"}
    for key in schema.keys() - known:
        warnings.warn(f"JSON Schema keyword that is not checked: {key}", stacklevel=2)
    return F.coalesce(ok, F.lit(False))


# Documents of any depth, checked one by one.

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _is_a(x: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return _is_number(x) and (kind == "number" or x == int(x) if abs(x) < float("inf") else kind == "number")
    return isinstance(x, _TYPES.get(kind, ()))


def _frozen(x: Any) -> Any:
    """A document as a value that is equal to another if the documents are: 1 and 1.0 are, 1 and true are not."""
    if isinstance(x, dict):
        return "object", frozenset((k, _frozen(v)) for k, v in x.items())
    if isinstance(x, list):
        return "array", tuple(_frozen(v) for v in x)
    return type(x).__name__ if not _is_number(x) else "number", x


class Checker:
    """Does a document fit a schema?  Keeps what was looked at, for the keywords about the rest."""

    def __init__(self, root: dict):
        self.root, self.open = root, set()

    def fits(self, x: Any, schema: dict | bool) -> bool:
        return self.looked_at(x, schema) is not None

    def looked_at(self, x: Any, s: dict | bool) -> set | None:
        """Keys, or places in a list, that the schema has looked at; None if the document does not fit."""
        if isinstance(s, bool):
            return set() if s else None
        seen: set = set()
        if not self._value_fits(x, s):
            return None
        for key in ("allOf", "anyOf", "oneOf"):
            if key in s:
                made = [found for found in (self.looked_at(x, sub) for sub in s[key]) if found is not None]
                if len(made) < {"allOf": len(s[key]), "anyOf": 1, "oneOf": 1}[key] or key == "oneOf" and len(made) > 1:
                    return None
                seen = seen.union(*made)
        more = [] if "$ref" not in s else [self._followed(x, s["$ref"])]
        if "if" in s:
            first = self.looked_at(x, s["if"])
            seen |= first or set()
            more.append(self.looked_at(x, s.get("then" if first is not None else "else", True)))
        if isinstance(x, dict):
            more += [self.looked_at(x, then) for name, then in {**s.get("dependencies", {}), **s.get("dependentSchemas", {})}.items() if name in x and not isinstance(then, list)]
            more.append(self._members(x, s))
        if isinstance(x, list):
            more.append(self._items(x, s))
        if "not" in s and self.fits(x, s["not"]) or any(found is None for found in more):
            return None
        seen = seen.union(*more)
        rest = {"unevaluatedProperties": dict, "unevaluatedItems": list}
        for key in (k for k in _NEED_ALL if k in s and isinstance(x, rest[k])):
            places = x.items() if isinstance(x, dict) else enumerate(x)
            left = [(k, v) for k, v in places if k not in seen]
            if not all(self.fits(v, s[key]) for _, v in left):
                return None
            seen |= {k for k, _ in left}
        return seen

    def _followed(self, x: Any, ref: str) -> set | None:
        if (id(x), ref) in self.open:  # a reference that leads to itself says nothing more
            return set()
        self.open.add((id(x), ref))
        try:
            return self.looked_at(x, resolve(self.root, ref))
        finally:
            self.open.discard((id(x), ref))

    def _value_fits(self, x: Any, s: dict) -> bool:
        kinds = s.get("type", [])
        kinds = kinds if isinstance(kinds, list) else [kinds]
        ok = not kinds or any(_is_a(x, k) for k in kinds)
        ok = ok and ("enum" not in s or _frozen(x) in [_frozen(v) for v in s["enum"]]) and ("const" not in s or _frozen(x) == _frozen(s["const"]))
        if _is_number(x):
            tests = {"minimum": lambda b: x >= b, "maximum": lambda b: x <= b, "exclusiveMinimum": lambda b: x > b, "exclusiveMaximum": lambda b: x < b, "multipleOf": lambda b: abs(x / b - round(x / b)) < 1e-9}
        elif isinstance(x, str):
            tests = {"minLength": lambda b: len(x) >= b, "maxLength": lambda b: len(x) <= b, "pattern": lambda b: re.search(b, x)}
        elif isinstance(x, list):
            tests = {"minItems": lambda b: len(x) >= b, "maxItems": lambda b: len(x) <= b, "uniqueItems": lambda b: not b or len({_frozen(v) for v in x}) == len(x)}
        elif isinstance(x, dict):
            needed = lambda b: all(n in x for name, names in b.items() if name in x and isinstance(names, list) for n in names)
            tests = {"minProperties": lambda b: len(x) >= b, "maxProperties": lambda b: len(x) <= b, "required": lambda b: all(n in x for n in b), "propertyNames": lambda b: all(self.fits(k, b) for k in x), "dependentRequired": needed, "dependencies": needed}
        else:
            tests = {}
        return bool(ok and all(test(s[k]) for k, test in tests.items() if k in s))

    def _members(self, x: dict, s: dict) -> set | None:
        seen: set = set()
        for name, sub in s.get("properties", {}).items():
            if name in x:
                if not self.fits(x[name], sub):
                    return None
                seen.add(name)
        for pattern, sub in s.get("patternProperties", {}).items():
            named = [k for k in x if re.search(pattern, k)]
            if not all(self.fits(x[k], sub) for k in named):
                return None
            seen.update(named)
        if "additionalProperties" in s:
            if not all(self.fits(v, s["additionalProperties"]) for k, v in x.items() if k not in seen):
                return None
            seen |= x.keys()
        return seen

    def _items(self, x: list, s: dict) -> set | None:
        seen: set = set()
        head, each = s.get("prefixItems"), s.get("items")
        if isinstance(each, list):
            head, each = each, s.get("additionalItems")
        for i, sub in enumerate((head or [])[: len(x)]):
            if not self.fits(x[i], sub):
                return None
            seen.add(i)
        if each is not None:
            if not all(self.fits(v, each) for v in x[len(head or ()) :]):
                return None
            seen |= set(range(len(x)))
        if "contains" in s:
            found = [i for i, v in enumerate(x) if self.fits(v, s["contains"])]
            if not s.get("minContains", 1) <= len(found) <= s.get("maxContains", len(x)):
                return None
            seen |= set(found)
        return seen


def _checked_one_by_one(text: Column, schema: dict) -> Column:
    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            if t is None:
                return False
            try:
                return Checker(schema).fits(json.loads(t), schema)
            except (ValueError, RecursionError):
                return False

        return texts.map(one).astype(bool)

    return fits(text)


def fits_schema(text: Column, document: Column, schema: dict) -> Column:
    """Does a document (given as text, and parsed as a variant) fit a JSON Schema?

    Knows type, enum, const, bounds, multipleOf, lengths, pattern, items, prefixItems,
    additionalItems, contains with its numbers, numbers and uniqueness of items, required,
    properties, patternProperties, additionalProperties, propertyNames, numbers of properties,
    dependentRequired, dependentSchemas, dependencies, unevaluatedProperties, unevaluatedItems, local
    references, and allOf, anyOf, oneOf, not, if.  Other keywords warn: they are not checked.

    A schema is one predicate of expressions, each reference compiled where it is followed.  Where a
    reference comes back to itself, where a keyword asks what others have looked at, and where a predicate
    would hold more than ``MOST_PREDICATES`` schemas, documents go through Python in batches; both tell
    the same."""
    if not any(k in x for x in _schemas(schema) for k in _NEED_ALL):
        try:
            return schema_predicate(document, schema, References(schema))
        except _NoPredicate:
            pass
    return document.isNotNull() & _checked_one_by_one(text, schema)
