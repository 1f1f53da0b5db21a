"""Datatypes: every name compiles to a parser, checks and a formatter over columns.

``compile_datatype`` works on the driver, once for a column; what it returns are plain
expressions, so parsing runs inside whole-stage code generation.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import DateFormat, parse_format
from .json_schema import fits_schema
from .numbers import PATTERN_CHARS, NumberFormat, format_decimal, format_exact, once, order_exact, parse_decimal, parse_exact, plain_number

BOUNDS = ("minimum", "minInclusive", "minExclusive", "maximum", "maxInclusive", "maxExclusive")
LENGTHS = ("length", "minLength", "maxLength")


@dataclass(frozen=True)
class Compiled:
    """Expressions of a datatype: text to value (null if malformed), and value to text."""

    name: str
    spark_type: str
    parse: Callable[[Column], Column]
    format: Callable[[Column], Column]
    checks: tuple[tuple[Callable[[Column, Column], Column], str], ...] = field(default=())
    #: What bounds compare, in this order of importance: all of them have to agree.
    order: Callable[[Column], tuple[Column, ...]] = lambda v: (v,)

    def error(self, text: Column, value: Column | None = None) -> Column:
        """The first complaint about a text, or null; ``value`` is what it was parsed to."""
        value = self.parse(text) if value is None else value
        complaint = F.when(value.isNull(), F.concat(F.lit(f"not a valid {self.name}: "), text))
        for fails, message in self.checks:
            complaint = complaint.when(fails(value, text), F.lit(message))
        return F.when(text.isNotNull(), complaint)


def java_regex(pattern: str) -> str:
    """Python's named groups in Java's notation; the whole text has to match."""
    return rf"^(?:{re.sub(r'[(][?]P<([A-Za-z][A-Za-z0-9]*)>', r'(?<\1>', pattern)})\z"


def _regex_or_warn(pattern: object) -> str | None:
    if not isinstance(pattern, str):
        return None
    try:
        re.compile(pattern)
    except re.error:
        warnings.warn(f"not a regular expression: {pattern}", stacklevel=3)
        return None
    return java_regex(pattern)


def _string(name: str, fmt: object) -> Compiled:
    rx = _regex_or_warn(fmt)
    return Compiled(name, "string", (lambda c: F.when(c.rlike(rx), c)) if rx else (lambda c: c), lambda v: v)


def _any(name: str, fmt: object) -> Compiled:
    return Compiled(name, "string", lambda c: c, lambda v: v)


def normal_uri(uri: Column) -> Column:
    """Scheme and host in lower case."""
    scheme, host = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)", 1)
    return F.concat(F.lower(scheme), F.lower(host), F.substring(uri, F.length(scheme) + F.length(host) + 1, F.length(uri)))


def _uri(name: str, fmt: object) -> Compiled:
    base = _string(name, fmt)
    return Compiled(name, "string", base.parse, normal_uri)


def _nmtoken(name: str, fmt: object) -> Compiled:
    return Compiled(name, "string", lambda c: F.when(c.rlike(r"^(?U)[\w.:-]*\z"), c), lambda v: v)


def _normalized(name: str, fmt: object) -> Compiled:
    squeeze = lambda c: F.regexp_replace(F.translate(c, "\r\n\t", "   "), r"^\s+|\s+$", "")
    return Compiled(name, "string", squeeze, squeeze)


def _base64(name: str, fmt: object) -> Compiled:
    lexical = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
    return Compiled(name, "binary", lambda c: F.when(c.rlike(lexical), F.try_to_binary(c, F.lit("base64"))), F.base64)


def _hex(name: str, fmt: object) -> Compiled:
    return Compiled(name, "binary", lambda c: F.when(c.rlike(r"^(?:[0-9A-Fa-f]{2})*\z"), F.unhex(c)), F.hex)


def _boolean(name: str, fmt: object) -> Compiled:
    yes, no = (["true", "1"], ["false", "0"]) if not fmt else ([x] for x in str(fmt).split("|"))
    return Compiled(name, "boolean", lambda c: F.when(c.isin(yes), F.lit(True)).when(c.isin(no), F.lit(False)), lambda v: F.when(v, F.lit(yes[0])).otherwise(F.lit(no[0])))


def _number_format(fmt: object) -> NumberFormat:
    if isinstance(fmt, str):
        fmt = {"pattern": fmt}
    fmt = dict(fmt or {})
    pattern = fmt.get("pattern")
    if pattern and not set(pattern) <= PATTERN_CHARS:
        warnings.warn(f"not a number pattern: {pattern}", stacklevel=3)
        pattern = None
    return NumberFormat(pattern, fmt.get("groupChar"), fmt.get("decimalChar"), fmt.get("exact") is True, fmt.get("bareNumber") is not False)


def _exact(name: str, f: NumberFormat, low: int | None = None, high: int | None = None, whole: bool = False) -> Compiled:
    """Numbers of any size as their digits, compared by a text that has their order."""

    def parse(c: Column) -> Column:
        def held(value: Column) -> Column:
            ok = ~value.contains(".") if whole else F.lit(True)
            for bound, fits in ((low, lambda a, b: a >= b), (high, lambda a, b: a <= b)):
                ok = ok & fits(order_exact(value), order_exact(F.lit(str(bound)))) if bound is not None else ok
            return F.when(ok, value)

        return once(parse_exact(c, f), held) if whole else parse_exact(c, f)

    return Compiled(name, "string", parse, lambda v: format_exact(v, f), order=lambda v: (order_exact(v),))


def _decimal(name: str, fmt: object) -> Compiled:
    """decimal(38, s): s is what the pattern allows behind the point, else 18.  A number with more
    digits than that holds is malformed, never rounded; with ``exact`` in the format, numbers of any
    size are kept as text."""
    f = _number_format(fmt)
    if f.exact:
        return _exact(name, f)
    return Compiled(name, f"decimal(38,{f.scale})", lambda c: parse_decimal(c, f, f.scale), lambda v: format_decimal(v, f))


def _between(low: int | None, high: int | None, spark_type: str) -> Callable[[str, object], Compiled]:
    """Whole numbers; the type or a comparison decides about the size."""
    # What a type cannot hold is null by itself.
    held = {"bigint": (-(2**63), 2**63 - 1), "smallint": (-(2**15), 2**15 - 1), "tinyint": (-128, 127)}.get(spark_type, (None, None))

    def build(name: str, fmt: object) -> Compiled:
        f = _number_format(fmt)
        if f.exact:
            return _exact(name, f, low, high, whole=True)

        def long_way(plain: Column) -> Column:
            # Groups and percent; whole if nothing but zeros stands behind the point.
            return F.regexp_extract(parse_decimal(plain, NumberFormat(), 3).cast("string"), r"^(-?\d+)(?:\.0*)?\z", 1).try_cast(spark_type)

        def parse(c: Column) -> Column:
            plain = plain_number(c, f)
            bare = F.translate(plain, ",", "") if f.pattern and f.grouping() else plain
            value = F.when(bare.rlike(r"^[+-]?\d+(?:\.0*)?\z"), F.substring_index(bare, ".", 1).try_cast(spark_type)).otherwise(once(plain, long_way))
            value = F.when(plain.rlike(f.regex()), value) if f.pattern else value
            for bound, fits in ((low, lambda v, b: v >= b), (high, lambda v, b: v <= b)):
                if bound is not None and bound not in held:
                    value = F.when(fits(value, F.lit(bound) if abs(bound) < 2**31 else F.lit(str(bound)).cast("decimal(20,0)")), value)
            return value

        return Compiled(name, spark_type, parse, lambda v: format_decimal(v.cast("decimal(38,0)"), f))

    return build


#: Lexical form of floating-point numbers, INF and NaN aside.
_FLOAT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"


def _float(name: str, fmt: object) -> Compiled:
    f = _number_format(fmt)

    def parse(c: Column) -> Column:
        c = c if f.bare else plain_number(c, NumberFormat(bare=False))
        # Casts also take a type's suffix, hexadecimal digits, blanks and names of infinity.
        fits = c.rlike(f.regex()) & F.translate(c, "%‰,", "").rlike(_FLOAT) if f.pattern else c.rlike(_FLOAT)
        special = F.when(c == "NaN", F.lit(float("nan"))).when(c == "-INF", F.lit(float("-inf")))
        special = special.when(c.isin("INF") if f.pattern else c.isin("INF", "+INF"), F.lit(float("inf")))
        return F.when(fits, c.try_cast("double")).otherwise(special)

    def show(v: Column) -> Column:
        text = F.regexp_replace(v.cast("string"), r"\.0$", "")
        return F.when(v == float("inf"), "INF").when(v == float("-inf"), "-INF").otherwise(text)

    return Compiled(name, "double", parse, show)


#: A value with an offset: its clock, and the offset as it counts (Z, +02:00; null if none).
ZONED, ZONED_DATE = "struct<local:timestamp_ntz,zone:string>", "struct<local:date,zone:string>"
_ISO = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)"
_OFFSET = r"(Z|[+-](?:0\d|1[0-4]):?[0-5]\d)\z"


def _zone(text: Column) -> Column:
    """An offset in one form: Z or +hh:mm; null if there is none."""
    bare = F.replace(F.trim(text), F.lit(":"))
    long = F.concat(F.substring(bare, 1, 3), F.lit(":"), F.rpad(F.substring(bare, 4, 2), 2, "0"))
    return F.when(bare == "Z", bare).when(bare != "", long)


def _shown_zone(zone: Column, marker: str) -> Column:
    """An offset as a marker (blanks before it included) asks for it."""
    blank, letters = marker[: len(marker) - len(marker.strip())], marker.strip()
    hours, minutes = F.substring(zone, 1, 3), F.substring(zone, 5, 2)
    shown = {1: F.when(minutes == "00", hours).otherwise(F.concat(hours, minutes)), 2: F.concat(hours, minutes), 3: zone}[len(letters)]
    zero = "Z" if letters[0] == "X" else {1: "+00", 2: "+0000", 3: "+00:00"}[len(letters)]
    return F.concat(F.lit(blank), F.when(zone == "Z", F.lit(zero)).otherwise(shown))


def _clock(c: Column, f: DateFormat) -> Column:
    return F.regexp_replace(c, f.zone_regex + r"\z", "") if f.zone else c


def iso_text(local: Column) -> Column:
    text = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def _instant(v: Column) -> tuple[Column, ...]:
    return (F.to_timestamp(F.concat(iso_text(v["local"].cast("timestamp_ntz")), F.coalesce(v["zone"], F.lit("Z")))),)


def _datetime(needs_zone: bool) -> Callable[[str, object], Compiled]:
    """Without a zone in the format, timestamp_ntz, and a text with an offset is malformed (it
    would be lost); with one, and for stamps, the clock and its offset."""

    def build(name: str, fmt: object) -> Compiled:
        fmt = fmt.get("pattern") if isinstance(fmt, dict) else fmt
        f = parse_format(fmt) if fmt else None
        if needs_zone and f and not f.zone:
            raise ValueError(f"{name} needs a zone marker: {fmt}")
        zoned = needs_zone or bool(f and f.zone)

        def local(c: Column) -> Column:
            if f is None:
                iso = rf"{_ISO}{_OFFSET}" if needs_zone else rf"{_ISO}\z"
                return F.when(c.rlike(iso), F.regexp_extract(c, _ISO, 1).try_cast("timestamp_ntz"))
            clock = _clock(c, f).try_cast("timestamp_ntz") if f.castable else F.try_to_timestamp(_clock(c, f), F.lit(f.spark)).cast("timestamp_ntz")
            return F.when(c.rlike(rf"^{f.lexical}{f.zone_regex if f.zone else ''}\z"), clock)

        def shown(v: Column) -> Column:
            return iso_text(v) if f is None else F.date_format(v, f.spark.replace("[", "").replace("]", ""))

        if not zoned:
            return Compiled(f"{name} without an offset" if f is None else name, "timestamp_ntz", local, shown)
        offset = (lambda c: F.regexp_extract(c, _OFFSET, 1)) if f is None else (lambda c: F.regexp_extract(c, f"({f.zone_regex})" + r"\z", 1))
        parse = lambda c: F.when(local(c).isNotNull(), F.struct(local(c).alias("local"), _zone(offset(c)).alias("zone")))
        return Compiled(name, ZONED, parse, lambda v: F.concat(shown(v["local"]), _shown_zone(v["zone"], f.zone) if f else v["zone"]), order=_instant)

    return build


def _date(name: str, fmt: object) -> Compiled:
    """A date; with a zone marker in the format, the date and its offset."""
    fmt = fmt.get("pattern") if isinstance(fmt, dict) else fmt
    try:
        f = parse_format(fmt or "yyyy-MM-dd")
        if f.time:
            raise ValueError(fmt)
    except ValueError:
        warnings.warn(f"not a date format: {fmt}", stacklevel=3)
        f = parse_format("yyyy-MM-dd")
    read = lambda c: c.try_cast("date") if f.castable else F.try_to_date(c, f.date)
    day = lambda c: F.when(c.rlike(rf"^{f.lexical}{f.zone_regex if f.zone else ''}\z"), read(_clock(c, f)))
    if not f.zone:
        return Compiled(name, "date", day, lambda v: F.date_format(v, f.date))
    parse = lambda c: F.when(day(c).isNotNull(), F.struct(day(c).alias("local"), _zone(F.regexp_extract(c, f"({f.zone_regex})" + r"\z", 1)).alias("zone")))
    return Compiled(name, ZONED_DATE, parse, lambda v: F.concat(F.date_format(v["local"], f.date), _shown_zone(v["zone"], f.zone)), order=_instant)


def _time(name: str, fmt: object) -> Compiled:
    """A time of day in canonical form: HH:mm:ss, the fraction, and the offset as Z or +hh:mm."""
    fmt = fmt.get("pattern") if isinstance(fmt, dict) else fmt
    f = parse_format(fmt or "HH:mm:ss", time_only=True)
    parts = rf"^(\d{{2}}:\d{{2}}:\d{{2}})(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})?\z"

    def parse(c: Column) -> Column:
        bare = F.regexp_replace(c, f.zone_regex + r"\z", "")
        digits = F.rpad(F.replace(F.substring_index(bare, ".", 1), F.lit(":")), 6, "0")
        h, m, s = (F.substring(digits, k, 2) for k in (1, 3, 5))
        zone = _zone(F.regexp_extract(c, f"({f.zone_regex})" + r"\z", 1))
        ok = c.rlike(rf"^{f.lexical}{f.zone_regex}\z") & (h < "24") & (m < "60") & (s < "60")
        return F.when(ok, F.concat(h, F.lit(":"), m, F.lit(":"), s, F.regexp_extract(bare, r"(\.\d+)?\z", 0), F.coalesce(zone, F.lit(""))))

    def show(v: Column) -> Column:
        clock = F.regexp_extract(v, parts, 1)
        digits = F.replace(clock, F.lit(":"))
        shapes = {"HH:mm:ss": clock, "HHmmss": digits, "HH:mm": F.substring(clock, 1, 5), "HHmm": F.substring(digits, 1, 4)}
        zone = F.regexp_extract(v, parts, 3)
        return F.concat(shapes[f.time], F.regexp_extract(v, parts, 2), F.when(zone != "", _shown_zone(zone, f.zone)).otherwise("") if f.zone else zone)

    def moment(v: Column) -> tuple[Column, ...]:
        zone = F.regexp_extract(v, parts, 3)
        return (F.to_timestamp(F.concat(F.lit("2000-01-01T"), F.regexp_extract(v, r"^[\d:.]+", 0), F.when(zone != "", zone).otherwise(F.lit("Z")))),)

    return Compiled(name, "string", parse, show, order=moment)


#: Days from which months are counted to compare durations; fixed values of the recommendation.
_STARTS = ("1696-09-01", "1697-02-01", "1903-03-01", "1903-07-01")


def _elapsed(v: Column) -> tuple[Column, ...]:
    """Microseconds from each of four days: one duration is longer if it is so from all."""
    days = (F.datediff(F.add_months(F.lit(d).cast("date"), v["months"]), F.lit(d).cast("date")) for d in _STARTS)
    return tuple(d.cast("long") * 86_400_000_000 + v["micros"] for d in days)


_DURATION = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?\z"


def _duration(months: bool, micros: bool) -> Callable[[str, object], Compiled]:
    def build(name: str, fmt: object) -> Compiled:
        rx = _regex_or_warn(fmt)

        def part(c: Column, k: int) -> Column:
            return F.coalesce(F.regexp_extract(c, _DURATION, k).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))

        def parse(c: Column) -> Column:
            ok = c.rlike(_DURATION) & c.rlike(r"\d[YMDHS]\z") & (c.rlike(rx) if rx else F.lit(True))
            if not months:
                ok = ok & ~c.rlike(r"^-?P[^T]*[YM]")
            if not micros:
                ok = ok & ~c.rlike("[DT]")
            sign = F.when(c.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
            m = ((part(c, 2) * 12 + part(c, 3)) * sign).cast("int")
            u = ((part(c, 4) * 86400 + part(c, 6) * 3600 + part(c, 7) * 60 + part(c, 8)) * 1000000 * sign).cast("long")
            return F.when(ok, F.struct(m.alias("months"), u.alias("micros")))

        def show(v: Column) -> Column:
            m, u = F.abs(v["months"]), F.abs(v["micros"])
            unit = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise(F.lit(""))
            whole = lambda expression: F.floor(expression).cast("long")
            seconds = F.pmod(u, F.lit(60_000_000)) / F.lit(1_000_000)
            s = F.when(seconds > 0, F.concat(F.regexp_replace(F.regexp_replace(seconds.cast("decimal(8,6)").cast("string"), "0+$", ""), r"\.$", ""), F.lit("S"))).otherwise(F.lit(""))
            day = F.concat(unit(whole(m / 12), "Y"), unit(m % 12, "M"), unit(whole(u / 86_400_000_000), "D"))
            clock = F.concat(unit(whole(u / 3_600_000_000) % 24, "H"), unit(whole(u / 60_000_000) % 60, "M"), s)
            body = F.concat(day, F.when(clock == "", "").otherwise(F.concat(F.lit("T"), clock)))
            sign = F.when((v["months"] < 0) | (v["micros"] < 0), "-").otherwise("")
            return F.concat(sign, F.lit("P"), F.when(body == "", F.lit("0D") if micros else F.lit("0M")).otherwise(body))

        return Compiled(name, "struct<months:int,micros:bigint>", parse, show, order=_elapsed)

    return build


def _json(name: str, fmt: object) -> Compiled:
    if isinstance(fmt, str):
        try:
            fmt = json.loads(fmt)
        except ValueError:
            fmt = None
    schema = fmt if isinstance(fmt, dict) else None

    def parse(c: Column) -> Column:
        parsed = F.try_parse_json(c)
        ok = parsed.isNotNull()
        return F.when(ok & fits_schema(c, parsed, schema) if schema else ok, c)

    return Compiled(name, "string", parse, lambda v: v)


# Names and their families, with the ranges of whole numbers; fixed values.
REGISTRY: dict[str, Callable[[str, object], Compiled]] = {
    **dict.fromkeys(("any", "anyAtomicType"), _any),
    **dict.fromkeys(("string", "QName", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth", "xml", "html"), _string),
    "anyURI": _uri,
    "NMTOKEN": _nmtoken,
    "normalizedString": _normalized,
    **dict.fromkeys(("base64Binary", "binary"), _base64),
    "hexBinary": _hex,
    "boolean": _boolean,
    **dict.fromkeys(("datetime", "dateTime"), _datetime(False)),
    "dateTimeStamp": _datetime(True),
    "date": _date,
    "time": _time,
    "duration": _duration(True, True),
    "dayTimeDuration": _duration(False, True),
    "yearMonthDuration": _duration(True, False),
    "decimal": _decimal,
    **dict.fromkeys(("integer", "int"), _between(None, None, "decimal(38,0)")),
    "long": _between(-(2**63), 2**63 - 1, "bigint"),
    "short": _between(-(2**15), 2**15 - 1, "smallint"),
    "byte": _between(-128, 127, "tinyint"),
    "unsignedLong": _between(0, 2**64 - 1, "decimal(20,0)"),
    "unsignedInt": _between(0, 2**32 - 1, "bigint"),
    "unsignedShort": _between(0, 2**16 - 1, "int"),
    "unsignedByte": _between(0, 255, "smallint"),
    "nonNegativeInteger": _between(0, None, "decimal(38,0)"),
    "positiveInteger": _between(1, None, "decimal(38,0)"),
    "nonPositiveInteger": _between(None, 0, "decimal(38,0)"),
    "negativeInteger": _between(None, -1, "decimal(38,0)"),
    **dict.fromkeys(("float", "number", "double"), _float),
    "json": _json,
}
ORDERED_TYPES = {n for n in REGISTRY if n in ("decimal", "float", "number", "double", "date", "datetime", "dateTime", "dateTimeStamp", "time") or "nteger" in n or n in ("int", "long", "short", "byte") or n.startswith("unsigned")}
DURATION_TYPES = {n for n in REGISTRY if n.lower().endswith("duration")}
MEASURED_TYPES = {"string", "anyURI", "NMTOKEN", "normalizedString", "base64Binary", "binary", "hexBinary", "QName", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth", "xml", "html", "json"}


def register(name: str) -> Callable:
    """Decorator: add a datatype; the function takes (name, format) and returns ``Compiled``."""

    def add(build: Callable[[str, object], Compiled]):
        REGISTRY[name] = build
        return build

    return add


def compile_datatype(base: str = "string", format: object = None, **facets: object) -> Compiled:
    """A datatype with its facets; contradictory facets raise ValueError."""
    if base not in REGISTRY:
        warnings.warn(f"unknown datatype: {base}", stacklevel=2)
        base = "string"
    built = REGISTRY[base](base, format)
    facets = {k: v for k, v in facets.items() if v is not None}
    if unknown := set(facets) - {*BOUNDS, *LENGTHS}:
        raise ValueError(f"unknown facets: {sorted(unknown)}")
    lengths, bounds = {k: int(facets[k]) for k in LENGTHS if k in facets}, {k: str(facets[k]) for k in BOUNDS if k in facets}
    if lengths and base not in MEASURED_TYPES:
        raise ValueError(f"{base} has no length")
    if bounds and base not in ORDERED_TYPES | DURATION_TYPES:
        raise ValueError(f"{base} has no order")
    if lengths.get("minLength", 0) > min(lengths.get("maxLength", 2**31), lengths.get("length", 2**31)) or lengths.get("length", 0) > lengths.get("maxLength", 2**31):
        raise ValueError("contradictory lengths")
    if {"minInclusive", "minExclusive"} <= bounds.keys() or {"maxInclusive", "maxExclusive"} <= bounds.keys():
        raise ValueError("an inclusive and an exclusive bound on one side")
    measure = F.octet_length if built.spark_type == "binary" else F.length
    checks = []
    for key, test, word in (("length", lambda n, b: n != b, "length"), ("minLength", lambda n, b: n < b, "at least length"), ("maxLength", lambda n, b: n > b, "at most length")):
        if key in lengths:
            checks.append((lambda v, t, test=test, b=lengths[key]: test(measure(v), F.lit(b)), f"value must have {word} {lengths[key]}"))
    tests = {"minimum": (lambda v, b: v < b, ">="), "minInclusive": (lambda v, b: v < b, ">="), "minExclusive": (lambda v, b: v <= b, ">"), "maximum": (lambda v, b: v > b, "<="), "maxInclusive": (lambda v, b: v > b, "<="), "maxExclusive": (lambda v, b: v >= b, "<")}
    for key in BOUNDS:
        if key in bounds:
            test, sign = tests[key]

            def outside(v: Column, t: Column, test=test, b=bounds[key]) -> Column:
                far = lambda value: reduce(or_, (test(x, y) for x, y in zip(built.order(value), built.order(built.parse(F.lit(b))), strict=True)))
                # A value that is looked at more than once is worked out once, as a lambda's variable.
                return F.exists(F.array(v), far) if base in DURATION_TYPES else far(v)

            checks.append((outside, f"value must be {sign} {bounds[key]}"))
    return replace(built, checks=tuple(checks))
