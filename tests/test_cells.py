"""Cells whose form decides what they hold: offsets, long numbers, JSON documents, durations."""

import decimal
import json
import warnings

import pytest
from pyspark.sql import functions as F

from tabweave.functions.json_schema import Checker
from tabweave.functions.types import compile_datatype


def read(spark, kind, texts):
    """Per text: (parsed, complaint, written again)."""
    c = F.col("t")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", kind.parse(c).alias("v"), kind.error(c).alias("e"), kind.format(kind.parse(c)).alias("w")).orderBy("i").collect()
    return [(r.v, r.e, r.w) for r in rows]


def valid(spark, kind, texts):
    return [e is None for _, e, _ in read(spark, kind, texts)]


@pytest.mark.parametrize(
    "base, fmt, texts",
    [
        ("datetime", "d.M.yyyy HH:mm X", ["22.3.2015 22:05 +03", "22.3.2015 22:05 +0330", "22.3.2015 22:05 Z", "1.3.2015 22:05 -11"]),
        ("datetime", "d.M.yyyy HH:mm XXX", ["22.3.2015 22:05 +03:30", "22.3.2015 22:05 +00:00"]),
        ("dateTime", "yyyy-MM-ddTHH:mm:ss.SSSxx", ["2015-03-22T22:05:01.250+0100"]),
        ("dateTimeStamp", None, ["2012-12-01T12:12:12+02:00", "2012-12-01T12:12:12Z", "2012-12-01T12:12:12.5-05:00"]),
        ("date", "yyyy-MM-ddXXX", ["2012-12-01+02:00", "2012-12-01Z"]),
        ("time", "HH:mm X", ["23:05 +0430", "23:05 Z", "00:00 -01"]),
        ("time", "HH:mm:ss.SSSXX", ["23:05:01.5+0430"]),
        ("time", None, ["11:11:11", "11:11:11Z", "11:11:11+05:30"]),
        ("duration", None, ["P1Y1D", "PT2H30M"]),
        ("decimal", None, ["0.00000001", "1000000000000", "12345678901234567890.5"]),
        ("decimal", "#0", ["12345678901234567890123456789012345678"]),
        ("decimal", "#,##0.##", ["1,234.57", "123,456,789,012,345,678,901,234,567,890.25"]),
        ("integer", None, ["12345678901234567890123"]),
    ],
)
def test_round_trips(spark, base, fmt, texts):
    kind = compile_datatype(base, fmt)
    assert [(e, w) for _, e, w in read(spark, kind, texts)] == [(None, t) for t in texts]


def test_offsets_are_kept_or_refused(spark):
    (value, _, _), = read(spark, compile_datatype("dateTimeStamp"), ["2012-12-01T12:12:12+02:00"])
    assert str(value.local) == "2012-12-01 12:12:12" and value.zone == "+02:00"
    assert valid(spark, compile_datatype("dateTime"), ["2012-12-01T12:12:12", "2012-12-01T12:12:12+02:00"]) == [True, False]
    assert valid(spark, compile_datatype("date"), ["2012-12-01", "2012-12-01+02:00"]) == [True, False]
    stamps = compile_datatype("dateTimeStamp", minInclusive="2012-12-01T12:00:00Z")
    assert valid(spark, stamps, ["2012-12-01T13:00:00+02:00", "2012-12-01T10:00:00-03:00", "2012-12-01T12:00:00"]) == [False, True, False]
    times = compile_datatype("time", maxExclusive="12:00:00Z")
    assert valid(spark, times, ["12:30:00+01:00", "11:30:00-01:00"]) == [True, False]


def test_numbers_that_the_type_cannot_hold_are_refused(spark):
    found = read(spark, compile_datatype("decimal"), ["0.0000000000000000000001", "0.1000000000000000000000", "123456789012345678901.5", "00000000000000000000000012.5", "12.5%", "-25%", "20‰", "0.00000000000000001%"])
    assert [v for v, _, _ in found] == [None, decimal.Decimal("0.1"), None, decimal.Decimal("12.5"), decimal.Decimal("0.125"), decimal.Decimal("-0.25"), decimal.Decimal("0.02"), None]
    floats = ["1d", "1f", "0x1p3", "inf", " 1", "1 ", "Infinity", "nan", "", "1e", "1.5e3", "+.5", "5.", "INF", "-INF", "NaN"]
    assert valid(spark, compile_datatype("number"), floats) == [False] * 10 + [True] * 6


EXACT = ["0", "-0", "00.00", "5", "-5", "5.5", "-5.5", "-5.55", "10", "9.999", "-10", "123456789012345678901234567890123456789012345", "-123456789012345678901234567890123456789012345.1", "0." + "0" * 60 + "1", "1,000", "+7", ".5", "5."]


def test_numbers_of_any_size(spark):
    kind = compile_datatype("decimal", {"exact": True})
    found = read(spark, kind, [*EXACT, "12.5%", "-1‰", "1,,0", "", "-", "1e5", "x"])
    with decimal.localcontext(prec=200):
        want = [decimal.Decimal(t.replace(",", "")) for t in EXACT] + [decimal.Decimal("0.125"), decimal.Decimal("-0.001")]
        assert [decimal.Decimal(v) for v, _, _ in found[:20]] == want
        assert [v for v, _, _ in found[20:]] == [None] * 5 and all(w == v for v, _, w in found[:20])
        assert not any(v.startswith("-0") and set(v) <= set("-0.") or v.endswith(".") for v, _, _ in found[:20])
        order = spark.createDataFrame([(v, str(i)) for i, (v, _, _) in enumerate(found[:20])], "v string, i string")
        keys = {r.i: r.k for r in order.select("i", kind.order(F.col("v"))[0].alias("k")).collect()}
        assert [want[int(i)] for i in sorted(keys, key=keys.get)] == sorted(want)
    bounded = compile_datatype("decimal", {"exact": True}, minInclusive="-5.5", maxExclusive="1" + "0" * 50)
    assert valid(spark, bounded, ["-5.5", "-5.50001", "9" * 50, "1" + "0" * 50, "9" * 50 + ".9"]) == [True, False, True, False, True]
    shown = compile_datatype("decimal", {"pattern": "#,##0.00#", "groupChar": ".", "decimalChar": ",", "exact": True})
    assert [(v, w) for v, _, w in read(spark, shown, ["1.234.567,50", "0,125", "-7,00", "1234,5"])] == [("1234567.5", "1.234.567,50"), ("0.125", "0,125"), ("-7", "-7,00"), (None, None)]
    percent = compile_datatype("decimal", {"pattern": "#0.##%", "exact": True})
    assert [(v, w) for v, _, w in read(spark, percent, ["12.5%", "0.25%", "300%"])] == [("0.125", "12.5%"), ("0.0025", "0.25%"), ("3", "300%")]
    assert valid(spark, compile_datatype("nonNegativeInteger", {"exact": True}), ["0", "-1", "9" * 90, "5.0", "5.5", "500%"]) == [True, False, True, True, False, True]


def test_durations_have_bounds(spark):
    day = compile_datatype("duration", minInclusive="P1D", maxExclusive="P1M")
    assert valid(spark, day, ["PT1H", "PT24H", "P27D", "P28D", "P31D", "P1D", "P1M"]) == [False, True, True, False, False, True, False]
    assert valid(spark, compile_datatype("yearMonthDuration", minExclusive="P1Y"), ["P12M", "P13M"]) == [False, True]


#: schema, documents that it allows, documents that it does not.
SCHEMAS = [
    ({"type": "string", "pattern": "^a.c"}, ["abcd"], ["xabc", 5]),
    ({"pattern": "(?P<x>b)"}, ["abc", 5], ["acc"]),
    ({"type": "array", "items": {"type": "integer", "minimum": 1}}, [[], [1, 2]], [[0], ["x"], {}]),
    ({"items": [{"type": "string"}, {"type": "integer"}], "additionalItems": False}, [["a", 1], ["a"], []], [["a", 1, 2], [1]]),
    ({"prefixItems": [{"const": 1}], "items": {"type": "string"}}, [[1, "a"]], [[1, 2], [2]]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, 2], "x"], [[], [1, 1], [1, 2, 3]]),
    ({"contains": {"type": "null"}}, [[1, None]], [[1]]),
    ({"properties": {"a": {"type": "integer"}}, "additionalProperties": False, "patternProperties": {"^x": {"type": "string"}}}, [{"a": 1, "xy": "s"}, {}, 3], [{"b": 1}, {"xy": 1}, {"a": "s"}]),
    ({"additionalProperties": {"type": "boolean"}, "minProperties": 1}, [{"k": True}], [{"k": 1}, {}]),
    ({"propertyNames": {"maxLength": 2}, "required": ["ab"]}, [{"ab": 1}], [{"abc": 1, "ab": 1}, {"b": 1}]),
    ({"properties": {"a.b'c": {"const": {"x": [1, 2]}}}}, [{"a.b'c": {"x": [1, 2]}}], [{"a.b'c": {"x": [2, 1]}}]),
    ({"properties": {"a": {"properties": {"b": {"items": {"properties": {"c": {"type": "string"}}}}}}}}, [{"a": {"b": [{"c": "x"}, {}]}}], [{"a": {"b": [{"c": "x"}, {"c": 1}]}}]),
    ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["x", None], [1]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3], [6, 5]),
    ({"allOf": [{"minimum": 1}, {"not": {"const": 5}}]}, [1, 6], [0, 5]),
    ({"if": {"type": "integer"}, "then": {"maximum": 9}, "else": {"type": "string"}}, [9, "x"], [10, 1.5]),
    ({"enum": [1, "a", {"b": None}, [True]]}, [1, "a", {"b": None}, [True]], [2, "b", {"b": 1}, [False]]),
    ({"type": ["integer", "null"]}, [1, 1.0, None], [1.5, "1"]),
    ({"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1}, [0.5], [0, 1]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "abc", 1], ["a", "abcd"]),
    ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"$ref": "#/$defs/n"}}}, [{"a": 1, "b": 2}, {}], [{"a": "x"}, {"a": 1, "b": "y"}]),
    ({"definitions": {"a/b~c": {"minimum": 3}, "x": {"$anchor": "here", "maximum": 5}}, "allOf": [{"$ref": "#/definitions/a~1b~0c"}, {"$ref": "#here"}]}, [3, 5], [2, 6]),
    ({"dependentRequired": {"a": ["b", "c"]}}, [{"b": 1}, {"a": 1, "b": 1, "c": None}, 4], [{"a": 1, "b": 2}]),
    ({"dependentSchemas": {"a": {"properties": {"b": {"type": "string"}}}}, "dependencies": {"c": ["d"], "e": {"minProperties": 2}}}, [{"b": 1}, {"a": 1, "b": "x"}, {"c": 1, "d": 2}, {"e": 1, "f": 1}], [{"a": 1, "b": 1}, {"c": 1}, {"e": 1}]),
    ({"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, [[1, 2], [1, 2, 3, "x"]], [[1], [1, 2, 3, 4]]),
]

#: Schemas that no predicate can hold: documents are checked one by one.
ONE_BY_ONE = [
    ({"properties": {"next": {"$ref": "#"}, "v": {"type": "integer"}}, "required": ["v"]}, [{"v": 1}, {"v": 1, "next": {"v": 2, "next": {"v": 3}}}, 5], [{"v": 1, "next": {"v": 2, "next": {"v": "x"}}}, {"v": 1, "next": {}}]),
    ({"$defs": {"tree": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"$ref": "#/$defs/tree"}]}}}, "$ref": "#/$defs/tree"}, [[], ["a", ["b", ["c", []]]]], [[["a", [1]]], "x"]),
    ({"properties": {"a": {}}, "anyOf": [{"properties": {"b": {"type": "string"}}}, True], "unevaluatedProperties": False}, [{"a": 1}, {"a": 1, "b": "x"}], [{"c": 1}, {"b": 5}]),
    ({"prefixItems": [{"type": "integer"}], "allOf": [{"contains": {"const": "x"}}], "unevaluatedItems": {"type": "null"}}, [[1, "x"], [1, "x", None]], [[1, "x", 2], [1]]),
    ({"$ref": "#"}, [1, {}], []),
]


@pytest.mark.parametrize("schema, good, bad", SCHEMAS, ids=[json.dumps(s)[:40] for s, _, _ in SCHEMAS])
def test_json_schema(spark, schema, good, bad):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        kind = compile_datatype("json", schema)
    assert valid(spark, kind, [json.dumps(x) for x in good + bad]) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("schema, good, bad", ONE_BY_ONE, ids=[json.dumps(s)[:40] for s, _, _ in ONE_BY_ONE])
def test_json_schemas_without_a_predicate(spark, schema, good, bad):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        kind = compile_datatype("json", schema)
    assert valid(spark, kind, [json.dumps(x) for x in good + bad] + ["[1", "NaN"]) == [True] * len(good) + [False] * (len(bad) + 2)


def test_predicates_and_functions_agree():
    for schema, good, bad in SCHEMAS:
        check = Checker(schema)
        assert [check.fits(x, schema) for x in good + bad] == [True] * len(good) + [False] * len(bad), schema


def test_large_schemas_are_checked_one_by_one(spark):
    levels = {f"l{i}": {"properties": {"a": {"$ref": f"#/$defs/l{i + 1}"}, "b": {"$ref": f"#/$defs/l{i + 1}"}}} for i in range(12)}
    schema = {"$defs": levels | {"l12": {"type": "integer"}}, "$ref": "#/$defs/l0"}
    deep = good = bad = None
    for value in (1, "x"):
        deep = value
        for _ in range(12):
            deep = {"b": deep}
        good, bad = (deep, bad) if value == 1 else (good, deep)
    assert valid(spark, compile_datatype("json", schema), [json.dumps(good), json.dumps(bad)]) == [True, False]


def test_keywords_that_are_not_checked_warn(spark):
    with pytest.warns(UserWarning, match="contentMediaType"):
        kind = compile_datatype("json", {"contentMediaType": "text/plain"})
        assert valid(spark, kind, ['{"a": 1}']) == [True]
    with pytest.warns(UserWarning, match="cannot be followed"):
        assert valid(spark, compile_datatype("json", {"$ref": "http://example.org/other.json"}), ["1"]) == [True]
