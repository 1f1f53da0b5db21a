"""Texts and what they are parsed to, as one DataFrame for each datatype."""

import datetime
import decimal
import warnings

import pytest
from pyspark.sql import functions as F

from tabweave.functions.types import REGISTRY, compile_datatype

D = decimal.Decimal
DAY = 86_400_000_000
#: datatype, format, text, value, text when written again (None: as it was).
GOOD = [
    ("any", None, "x", "x", None),
    ("string", "[a-c]+", "abc", "abc", None),
    ("string", "(?P<year>[0-9]{4})", "2020", "2020", None),
    ("anyURI", None, "HTTP://Example.ORG/A", "HTTP://Example.ORG/A", "http://example.org/A"),
    ("NMTOKEN", None, "a-b.c:ü", "a-b.c:ü", None),
    ("normalizedString", None, " a\tb\n", "a b", "a b"),
    ("base64Binary", None, "aGVsbG8gd29ybGQ=", bytearray(b"hello world"), None),
    ("binary", None, "aGVsbG8gd29ybGQ=", bytearray(b"hello world"), None),
    ("hexBinary", None, "ab", bytearray(b"\xab"), "AB"),
    ("boolean", None, "1", True, "true"),
    ("boolean", "ja|nein", "nein", False, None),
    ("date", None, "2012-12-01", datetime.date(2012, 12, 1), None),
    ("date", "d.M.yyyy", "3.4.2015", datetime.date(2015, 4, 3), None),
    ("date", "yyyyMMdd", "20150322", datetime.date(2015, 3, 22), None),
    ("dateTime", None, "2018-12-10T20:20:20", datetime.datetime(2018, 12, 10, 20, 20, 20), None),
    ("datetime", "yyyy-MM-ddTHH:mm:ss.SSS", "2018-12-10T20:20:20.25", datetime.datetime(2018, 12, 10, 20, 20, 20, 250000), "2018-12-10T20:20:20.250"),
    ("datetime", "dd/MM/yyyy HH:mm", "31/01/2020 23:59", datetime.datetime(2020, 1, 31, 23, 59), None),
    ("time", None, "23:05:22", "23:05:22", None),
    ("time", "HHmm", "2305", "23:05:00", None),
    ("duration", None, "P3Y6M4DT12H30M5S", (42, 4 * DAY + 45_005_000_000), None),
    ("dayTimeDuration", None, "-P1DT2H", (0, -(DAY + 7_200_000_000)), None),
    ("yearMonthDuration", None, "P1Y2M", (14, 0), None),
    ("decimal", None, "3.50", D("3.5"), "3.5"),
    ("decimal", {"groupChar": ".", "decimalChar": ","}, "1.234,5", D("1234.5"), "1234,5"),
    ("decimal", None, "50%", D("0.5"), "0.5"),
    ("decimal", {"pattern": "#,##0.00"}, "1,234.50", D("1234.5"), None),
    ("decimal", {"pattern": "#,##,##0.0#"}, "12,34,567.8", D("1234567.8"), None),
    ("integer", None, "5.0", D(5), "5"),
    ("integer", None, "100%", D(1), "1"),
    ("integer", None, "1,000", D(1000), "1000"),
    ("int", {"groupChar": "-"}, "1-000", D(1000), "1000"),
    ("long", None, "-9223372036854775808", -(2**63), None),
    ("short", None, "-5", -5, None),
    ("byte", None, "127", 127, None),
    ("unsignedLong", None, "18446744073709551615", D(2**64 - 1), None),
    ("unsignedInt", None, "4294967295", 2**32 - 1, None),
    ("unsignedShort", None, "65535", 65535, None),
    ("unsignedByte", None, "255", 255, None),
    ("nonNegativeInteger", None, "0", D(0), None),
    ("positiveInteger", None, "1", D(1), None),
    ("nonPositiveInteger", None, "-0", D(0), "0"),
    ("negativeInteger", None, "-1", D(-1), None),
    ("double", None, "3.5", 3.5, None),
    ("float", None, "-INF", float("-inf"), None),
    ("number", "0.0", "1.5", 1.5, None),
    ("json", None, '{"a": 1}', '{"a": 1}', None),
    ("gYear", "[0-9]{4}", "2020", "2020", None),
]
BAD = [
    ("string", "[a-c]+", "abd"),
    ("NMTOKEN", None, "a b"),
    ("base64Binary", None, "aGVsbG8gd29ybGQ"),
    ("hexBinary", None, "abc"),
    ("boolean", None, "yes"),
    ("date", None, "10/18/2010"),
    ("date", "M/d/yyyy", "10/18/2010foo"),
    ("date", None, "2012-13-01"),
    ("datetime", "yyyy-MM-dd HH:mm:ss.SSS", "2018-12-10 20:20:20.2500"),
    ("time", None, "25:00:00"),
    ("duration", None, "P"),
    ("dayTimeDuration", None, "P1Y"),
    ("decimal", None, "1e3"),
    ("decimal", None, "1,,000"),
    ("decimal", {"pattern": "#,##0.00"}, "12,34.50"),
    ("decimal", {"pattern": "000"}, "12"),
    ("decimal", {"pattern": "0.0"}, "1.25"),
    ("integer", None, "5.5"),
    ("integer", None, "50%"),
    ("long", None, "9223372036854775808"),
    ("byte", None, "128"),
    ("unsignedByte", None, "256"),
    ("unsignedLong", None, "-1"),
    ("positiveInteger", None, "0"),
    ("negativeInteger", None, "0"),
    ("nonPositiveInteger", None, "1"),
    ("double", None, "x"),
    ("json", None, "{"),
]


def _one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "x string").select(*columns).first()


@pytest.mark.parametrize("name,fmt,text,value,shown", GOOD)
def test_value_and_text(spark, name, fmt, text, value, shown):
    kind = compile_datatype(name, fmt)
    x = F.col("x")
    v, t, e = _one(spark, text, kind.parse(x).alias("v"), kind.format(kind.parse(x)).alias("t"), kind.error(x).alias("e"))
    assert (tuple(v) if isinstance(value, tuple) else v) == value
    assert t == (text if shown is None else shown)
    assert e is None


@pytest.mark.parametrize("name,fmt,text", BAD)
def test_malformed(spark, name, fmt, text):
    kind = compile_datatype(name, fmt)
    v, e = _one(spark, text, kind.parse(F.col("x")).alias("v"), kind.error(F.col("x")).alias("e"))
    assert v is None
    assert text in e


def test_registry_is_complete():
    names = "any anyAtomicType string anyURI NMTOKEN base64Binary binary hexBinary boolean datetime dateTime date dateTimeStamp time duration dayTimeDuration yearMonthDuration decimal integer int long short byte unsignedLong unsignedInt unsignedShort unsignedByte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger float number double normalizedString QName gDay gMonth gMonthDay gYear gYearMonth xml html json"
    assert set(names.split()) == set(REGISTRY)


@pytest.mark.parametrize("facets,text,fine", [({"length": 3}, "abc", True), ({"minLength": 4}, "abc", False), ({"maxLength": 2}, "abc", False)])
def test_lengths(spark, facets, text, fine):
    assert (_one(spark, text, compile_datatype("string", **facets).error(F.col("x")).alias("e")).e is None) == fine


@pytest.mark.parametrize("facets,fine", [({"minimum": "5"}, True), ({"minExclusive": "5"}, False), ({"maximum": "4"}, False), ({"maxInclusive": "5"}, True), ({"maxExclusive": "5"}, False), ({"minInclusive": "6"}, False)])
def test_bounds(spark, facets, fine):
    assert (_one(spark, "5", compile_datatype("integer", **facets).error(F.col("x")).alias("e")).e is None) == fine


@pytest.mark.parametrize("base,facets", [("string", {"minimum": "1"}), ("integer", {"length": 1}), ("string", {"minLength": 3, "maxLength": 2}), ("integer", {"minInclusive": "1", "minExclusive": "1"})])
def test_contradictory_facets(base, facets):
    with pytest.raises(ValueError):
        compile_datatype(base, **facets)


def test_unknown_names_and_formats_warn():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert compile_datatype("nothing").name == "string"
        compile_datatype("string", "[")
        compile_datatype("decimal", "abc")
        compile_datatype("date", "yyyy")
    assert len(seen) == 4
    with pytest.raises(ValueError):
        compile_datatype("dateTimeStamp", "yyyy-MM-ddTHH:mm:ss")


def test_json_schema(spark):
    kind = compile_datatype("json", {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x", "y"]}}})
    texts = ['{"a": 3}', '{"a": 1}', '{"b": "x"}', '{"a": 2, "b": "z"}', '{"a": 2, "b": "y"}', "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", kind.error(F.col("x")).isNull().alias("ok"))
    assert [r.ok for r in df.orderBy("i").collect()] == [True, False, False, False, True, False]
