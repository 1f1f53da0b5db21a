"""The engine's queries over the driver's tables, each with SQL that must give the same rows.

The tables' columns, cast to string, act as the cells of delimited files; each query compiles
a description into expressions over them.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..describe import infer_types
from ..functions.names import name_column, slug_column
from ..functions.numbers import NumberFormat, format_decimal, parse_decimal
from ..functions.types import compile_datatype
from ..functions.uritemplate import compile_template
from ..model import ForeignKey, Table, TableGroup
from ..operators import json_export, keys, relations
from ..operators.scan import Scan, scan, scan_frame, texts
from ..sources import dsv
from ..sources.dialect import Dialect
from ..staging import new_path, stage

FLAGSHIP = "typed_lineitem"


def _cells(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def _table(url: str, columns: dict, **schema: object) -> Table:
    described = [{"name": n, **({"datatype": d} if not (isinstance(d, dict) and "_" in d) else {k: v for k, v in d.items() if k != "_"})} for n, d in columns.items()]
    return TableGroup.of({"url": url, "tableSchema": {"columns": described, **schema}}).tables[0]


LINEITEM = {
    "l_orderkey": "long",
    "l_linenumber": {"base": "integer", "minimum": "1"},
    "l_quantity": "integer",
    "l_extendedprice": "double",
    "l_returnflag": {"base": "string", "format": "[ANR]"},
    "l_shipdate": {"base": "datetime", "format": "yyyy-MM-dd HH:mm:ss"},
}


def _lineitem(spark: SparkSession, sf_dir: str, **changes: object) -> Scan:
    columns = LINEITEM | changes
    cells = _cells(spark, sf_dir, "lineitem", *LINEITEM)
    return scan_frame(_table("lineitem.csv", columns), cells.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")))


def typed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _lineitem(spark, sf_dir).good
    return good.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("l_quantity"), "l_extendedprice", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"))


def typed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed result is an ordinary DataFrame: aggregate it."""
    good = _lineitem(spark, sf_dir).typed("l_returnflag", "l_quantity", "l_extendedprice")
    return good.groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count(F.lit(1)).alias("n"))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lineitem(spark, sf_dir, l_quantity={"base": "integer", "maximum": "40"}, l_returnflag={"base": "string", "format": "A|N"})
    return s.error_counts()


def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lineitem(spark, sf_dir, l_quantity={"base": "integer", "minExclusive": "5", "maxInclusive": "40"})
    return s.good.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumn("sourcenum", F.col("o_orderkey") + 1)
    t = _table("orders.csv", {"o_orderkey": "long", "o_orderpriority": {"base": "string", "maxLength": 6}})
    return scan_frame(t, cells).errors


def lenient_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("supplier.csv", {"s_suppkey": "long", "s_acctbal": {"base": "decimal", "minimum": "0"}})
    rows = scan_frame(t, _cells(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")).lenient
    return rows.select("s_suppkey", F.element_at("_raw", "s_acctbal").cast("double").alias("raw_balance"))


def nulls_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("customer.csv", {"c_custkey": "long", "c_mktsegment": {"_": 1, "null": ["BUILDING", ""]}, "c_name": {"_": 1, "default": "nobody", "null": "NA"}})
    cells = _cells(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_name").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")))
    return scan_frame(t, cells).good


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("part.csv", {"p_partkey": "long", "p_name": {"_": 1, "separator": " "}})
    rows = scan_frame(t, _cells(spark, sf_dir, "part", "p_partkey", "p_name")).good
    return rows.select("p_partkey", F.size("p_name").cast("long").alias("n_items"), F.get("p_name", F.lit(0)).alias("first_item"), F.array_join("p_name", "|").alias("items"))


def virtual_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("nation.csv", {"n_nationkey": "integer", "n_name": "string", "uri": {"_": 1, "virtual": True, "valueUrl": "http://example.org/nation/{n_nationkey}?name={n_name}"}})
    return scan_frame(t, _cells(spark, sf_dir, "nation", "n_nationkey", "n_name")).good.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "uri")


def uri_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compile_template("http://example.org{/p_brand}{?p_name,p_size}{#p_partkey}", {c: F.col(c) for c in ("p_brand", "p_name", "p_size", "p_partkey")})
    return _cells(spark, sf_dir, "part").select("p_partkey", made.alias("uri"))


def booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("boolean", "A|R")
    df = _cells(spark, sf_dir, "lineitem", "l_returnflag")
    return df.groupBy(kind.parse(F.col("l_returnflag")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_totalprice").cast("decimal(38,18)")
    return _cells(spark, sf_dir, "orders").select("o_orderkey", format_decimal(value, NumberFormat("#,##0.00")).alias("shown"))


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = NumberFormat("#,##0.00", ".", ",")
    text = format_decimal(F.col("o_totalprice").cast("decimal(38,18)"), f)
    return _cells(spark, sf_dir, "orders").select("o_orderkey", parse_decimal(text, f).cast("double").alias("price"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("date", "d.M.yyyy", minimum="1.1.1995")
    text = kind.format(F.col("o_orderdate").cast("date"))
    return _cells(spark, sf_dir, "orders").select("o_orderkey", text.alias("shown"), kind.parse(text).alias("parsed"), kind.error(text).isNull().alias("valid"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("duration")
    text = F.concat(F.lit("P1Y"), F.col("p_size").cast("string"), F.lit("DT2H"))
    value = kind.parse(text)
    return _cells(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", value["months"].alias("months"), value["micros"].alias("micros"), kind.format(value).alias("shown"))


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b64, hexed = compile_datatype("base64Binary", minLength=1), compile_datatype("hexBinary")
    name = F.col("c_name").cast("binary")
    return _cells(spark, sf_dir, "customer").select("c_custkey", b64.format(name).alias("base64"), hexed.format(hexed.parse(hexed.format(name))).alias("hex"), b64.parse(b64.format(name)).cast("string").alias("back"))


def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("json", {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 50}}})
    return _cells(spark, sf_dir, "events", "event_id", "props").select("event_id", kind.error(F.col("props")).isNull().alias("valid"))


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cells(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return spark.createDataFrame(sorted(infer_types(df).items()), "column string, datatype string")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_keys(_cells(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def primary_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("orders.csv", {"o_custkey": "long"}, primaryKey="o_custkey")
    df = _cells(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_custkey", F.col("o_orderkey").alias("rownum"), (F.col("o_orderkey") + 1).alias("sourcenum"))
    return keys.check_primary_key(t, df).select("sourcenum", "columns", "message")


def _pair(child_columns: dict, parent_columns: dict, **key: object) -> tuple[Table, Table]:
    group = TableGroup.of({"tables": [{"url": "child.csv", "tableSchema": {"columns": [{"name": n, **d} for n, d in child_columns.items()], "foreignKeys": [key]}}, {"url": "parent.csv", "tableSchema": {"columns": [{"name": n, **d} for n, d in parent_columns.items()]}}]})
    group.validate_schema()
    return group.tables[0], group.tables[1]


def _reference(columns: object, target: object) -> dict:
    return {"columnReference": columns, "reference": {"resource": "parent.csv", "columnReference": target}}


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _pair({"l_orderkey": {"datatype": "long"}}, {"o_orderkey": {"datatype": "long"}}, **_reference("l_orderkey", "o_orderkey"))
    mine = _cells(spark, sf_dir, "lineitem", "l_orderkey").withColumn("sourcenum", F.col("l_orderkey"))
    theirs = _cells(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return keys.check_foreign_key(mine, child, child.schema.foreign_keys[0], theirs, parent).groupBy("sourcenum", "message").agg(F.count(F.lit(1)).alias("n"))


def orphans_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _pair({"p_type": {"separator": " "}}, {"word": {}}, **_reference("p_type", "word"))
    parts = _cells(spark, sf_dir, "part", "p_partkey", "p_name")
    typed = parts.select(F.split("p_name", " ").alias("p_type"), F.col("p_partkey").alias("sourcenum"))
    words = _cells(spark, sf_dir, "part", "p_name", "p_brand").filter("p_brand = 'Brand#4'").select(F.explode(F.split("p_name", " ")).alias("word")).filter("word < 'm'").distinct()
    return keys.check_foreign_key(typed, child, child.schema.foreign_keys[0], words, parent).groupBy("sourcenum").agg(F.count(F.lit(1)).alias("n"))


def orphans_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _pair({"l_partkey": {}, "l_suppkey": {}}, {"a": {}, "b": {}}, **_reference(["l_partkey", "l_suppkey"], ["a", "b"]))
    items = _cells(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    mine = items.select("l_partkey", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).alias("l_suppkey"), F.col("l_partkey").alias("sourcenum"))
    theirs = items.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return keys.check_foreign_key(mine, child, child.schema.foreign_keys[0], theirs, parent).groupBy("sourcenum").agg(F.count(F.lit(1)).alias("n"))


def strict_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _pair({"c_nationkey": {}}, {"s_nationkey": {}}, **_reference("c_nationkey", "s_nationkey"))
    mine = _cells(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("c_nationkey"))
    theirs = _cells(spark, sf_dir, "supplier", "s_nationkey")
    return keys.strict_checks(mine, child, ForeignKey(["c_nationkey"], "parent.csv", None, ["s_nationkey"]), theirs, parent).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = TableGroup.of({"tables": [
        {"url": "customer.csv", "tableSchema": {"columns": [{"name": "c_custkey", "datatype": "long"}, {"name": "c_acctbal", "datatype": {"base": "decimal", "minimum": "0"}}], "primaryKey": "c_custkey"}},
        {"url": "orders.csv", "tableSchema": {"columns": [{"name": "o_orderkey", "datatype": "long"}, {"name": "o_custkey", "datatype": "long"}], "primaryKey": "o_custkey", "foreignKeys": [{"columnReference": "o_custkey", "reference": {"resource": "customer.csv", "columnReference": "c_custkey"}}]}},
    ]})
    frames = {
        "customer.csv": scan_frame(group.tables[0], _cells(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumn("rownum", F.col("c_custkey"))),
        "orders.csv": scan_frame(group.tables[1], _cells(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("rownum", F.col("o_orderkey"))),
    }
    return keys.validate(spark, group, frames).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _nations(spark: SparkSession, sf_dir: str, **schema: object) -> Scan:
    t = _table("http://example.org/nation.csv", {"n_nationkey": "integer", "n_name": {"_": 1, "titles": "name", "propertyUrl": "schema:name"}, "n_regionkey": {"_": 1, "datatype": "integer", "valueUrl": "http://example.org/region/{n_regionkey}"}}, **schema)
    cells = _cells(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return scan_frame(t, cells.withColumn("rownum", F.col("n_nationkey").cast("long") + 1).withColumn("sourcenum", F.col("n_nationkey").cast("long") + 2))


def json_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_export.json_rows(_nations(spark, sf_dir), minimal=True)


def json_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_export.json_rows(_nations(spark, sf_dir, aboutUrl="#nation-{n_nationkey}", rowTitles=["n_name"]))


def json_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("lineitem.csv", {"l_orderkey": "long", "l_linenumber": "integer", "l_returnflag": "string"})
    cells = _cells(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("rownum", F.col("l_orderkey")).withColumn("sourcenum", F.col("l_orderkey") + 1)
    return json_export.json_rows(scan_frame(t, cells), minimal=True)


def cell_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_export.triples(_nations(spark, sf_dir, aboutUrl="#nation-{n_nationkey}"))


def _listing() -> TableGroup:
    return TableGroup.of({"tables": [
        {"url": "part.csv", "tableSchema": {"columns": [{"name": "p_partkey", "datatype": "long"}, {"name": "words", "separator": " "}], "primaryKey": "p_partkey", "foreignKeys": [{"columnReference": "words", "reference": {"resource": "word.csv", "columnReference": "word"}}]}},
        {"url": "word.csv", "tableSchema": {"columns": [{"name": "word"}], "primaryKey": "word"}},
    ]})


def association_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = next(p for p in relations.plan_tables(_listing()) if p.associations)
    df = _cells(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return relations.association_rows(plan, df)["part_word"].select("part_p_partkey", "word_word", F.col("position").cast("long").alias("position"))


def written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values as the text of cells: lists joined, nulls as their token."""
    t = _table("part.csv", {"p_partkey": "long", "p_size": {"_": 1, "datatype": "integer", "null": "-"}, "p_type": {"_": 1, "separator": ";"}})
    df = _cells(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 9, F.col("p_size")).cast("decimal(38,0)").alias("p_size"), F.split("p_name", " ").alias("p_type"))
    return texts(t, df)


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cells(spark, sf_dir, "customer")
    comment = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('said "'), F.col("c_mktsegment"), F.lit('", twice'))).otherwise(F.col("c_mktsegment"))
    return df.select("c_custkey", dsv.csv_line([F.col("c_name"), comment], Dialect()).alias("line"))


def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of delimited files, written and read again by the splittable reader."""
    path, d = new_path(spark, "csv"), Dialect(comment_prefix=None, skip_blank_rows=True)
    df = _cells(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    dsv.write_dir(df, path, d)
    t = _table("customer.csv", {"c_custkey": "long", "c_name": "string", "c_mktsegment": "string"})
    return scan_frame(t, dsv.read_plain(spark, path, list(df.columns), d, one_line=True)).good


def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsv.filter_rows(_cells(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") != "F")[0]


def added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _cells(spark, sf_dir, "customer", "c_custkey", "c_name")
    return dsv.add_rows(customers, customers.select((-F.col("c_custkey")).alias("c_custkey"), F.upper("c_name").alias("c_name")))


def offset_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps keep the offset that they were written with."""
    kind = compile_datatype("datetime", "d.M.yyyy HH:mm X")
    text = F.concat(F.date_format("o_orderdate", "d.M.yyyy HH:mm"), F.lit(" +0"), (F.col("o_orderkey") % 9).cast("string"))
    value = kind.parse(text)
    return _cells(spark, sf_dir, "orders").select("o_orderkey", kind.format(value).alias("shown"), value["zone"].alias("zone"), F.date_format(value["local"], "yyyy-MM-dd HH:mm").alias("clock"))


def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits beyond the type are zeros, or the cell is refused."""
    kind = compile_datatype("decimal")
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"), F.repeat(F.lit("0"), F.lit(20)), F.when(F.col("o_orderkey") % 2 == 0, "0").otherwise("1"))
    return _cells(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", kind.format(kind.parse(text)).alias("shown"), kind.error(text).isNull().alias("valid"))


def lexical_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("number")
    endings = F.array(*[F.lit(x) for x in ("d", "e1", ".5", " ", "f", "")])
    text = F.concat(F.col("p_partkey").cast("string"), F.get(endings, (F.col("p_partkey") % 6).cast("int")))
    return _cells(spark, sf_dir, "part", "p_partkey").select("p_partkey", kind.parse(text).alias("value"))


def json_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = compile_datatype("json", {"type": "object", "additionalProperties": False, "patternProperties": {"^k$": {"type": "integer", "multipleOf": 3, "exclusiveMinimum": 10}}, "minProperties": 1})
    lists = compile_datatype("json", {"type": "array", "prefixItems": [{"type": "integer"}], "items": {"type": "string", "pattern": "^a[0-4]"}, "maxItems": 2})
    listed = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(',"a'), F.col("user_id").cast("string"), F.lit('"]'))
    return _cells(spark, sf_dir, "events").select("event_id", objects.error(F.col("props")).isNull().alias("valid_object"), lists.error(listed).isNull().alias("valid_list"))


def duration_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duration is longer than another if it is so from whatever month one counts."""
    kind = compile_datatype("duration", minInclusive="P1D", maxExclusive="P1M")
    size = F.col("p_size").cast("string")
    days, hours = F.concat(F.lit("P"), size, F.lit("D")), F.concat(F.lit("PT"), size, F.lit("H"))
    return _cells(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", kind.error(days).isNull().alias("days"), kind.error(hours).isNull().alias("hours"))


def required_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("orders.csv", {"o_orderkey": "long", "o_orderpriority": {"_": 1, "required": True, "null": ["5-LOW", ""]}})
    cells = _cells(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumn("sourcenum", F.col("o_orderkey") + 1)
    return scan_frame(t, cells).errors.select("sourcenum", "column", "message")


def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", slug_column(F.col("c_name")).alias("slug"), name_column(F.concat(F.lit("1 "), F.col("c_name"))).alias("name"))


def any_uri_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = compile_datatype("anyURI")
    return _cells(spark, sf_dir, "pages", "page_id", "url").select("page_id", kind.format(kind.parse(F.concat(F.upper(F.substring("url", 1, 20)), F.substring(F.col("url"), F.lit(21), F.length("url"))))).alias("uri"))


def group_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a row about two subjects; the one that the other refers to stands inside it."""
    t = _table("http://example.org/orders.csv", {
        "o_orderkey": {"_": 1, "datatype": "long", "aboutUrl": "http://example.org/order/{o_orderkey}"},
        "by": {"_": 1, "virtual": False, "datatype": "long", "aboutUrl": "http://example.org/order/{o_orderkey}", "propertyUrl": "schema:customer", "valueUrl": "http://example.org/customer/{by}"},
        "status": {"_": 1, "aboutUrl": "http://example.org/customer/{by}", "propertyUrl": "schema:status"},
    }, aboutUrl="http://example.org/order/{o_orderkey}")
    orders = _cells(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = orders.select("o_orderkey", F.col("o_custkey").alias("by"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("rownum"), F.col("o_orderkey").alias("sourcenum"))
    return json_export.describe_rows(scan_frame(t, rows)).select("rownum", F.array_join("describes", ",").alias("json"))


def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table("lineitem.csv", {"l_quantity": {"base": "double", "maximum": "40"}, "l_returnflag": {"base": "string", "minLength": 2}, "l_tax": {"base": "double", "minExclusive": "0"}})
    found = relations.check_values(t, _cells(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag", "l_tax"))
    return found.groupBy("kind", "columns", "message").agg(F.count(F.lit(1)).alias("n"))


def assoc_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that went to an association table, read back in order; absent ones are empty."""
    plan = next(p for p in relations.plan_tables(_listing()) if p.associations)
    df = _cells(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.split("p_name", " ")).alias("words"))
    rows = relations.with_lists(plan, df.select("p_partkey"), relations.association_rows(plan, df))
    return rows.select("p_partkey", F.array_join("words", "|").alias("words"))


def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 60 whole digits and 30 decimals, kept, compared and shown as they are."""
    kind = compile_datatype("decimal", {"groupChar": " ", "decimalChar": ",", "exact": True}, minExclusive="-" + "5" * 60 + "," + "0" * 29 + "1", maxInclusive="7" * 60)
    whole = compile_datatype("positiveInteger", {"exact": True})
    digit = (F.col("o_orderkey") % 10).cast("string")
    sign = F.when(F.col("o_orderkey") % 20 >= 10, "-").otherwise("")
    text = F.concat(sign, F.repeat(digit, F.lit(60)), F.lit(","), F.repeat(F.lit("0"), F.lit(29)), F.lit("10"))
    value = kind.parse(text)
    return _cells(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", value.alias("digits"), kind.format(value).alias("shown"), kind.error(text).isNull().alias("valid"), whole.error(F.concat(sign, F.repeat(digit, F.lit(60)))).isNull().alias("valid_whole"))


def json_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas with references: to a part that several keys share, and to themselves."""
    shared = compile_datatype("json", {"$defs": {"score": {"type": "integer", "minimum": 50}}, "type": "object", "properties": {"k": {"$ref": "#/$defs/score"}}, "required": ["k"], "dependentRequired": {"j": ["k"]}})
    chain = compile_datatype("json", {"$defs": {"link": {"type": "object", "required": ["at"], "properties": {"at": {"type": "integer", "maximum": 900}, "next": {"$ref": "#/$defs/link"}}}}, "$ref": "#/$defs/link"})
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = F.concat(F.lit('{"at":1,"next":{"at":2,"next":{"at":'), user, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"next":{"no":'), event, F.lit("}"))).otherwise(""), F.lit("}}}"))
    return _cells(spark, sf_dir, "events", "event_id", "user_id", "props").select("event_id", shared.error(F.col("props")).isNull().alias("valid_shared"), chain.error(text).isNull().alias("valid_chain"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of tables written with one commit, columns renamed, and read back with its lists."""
    group = _listing()
    p = _cells(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    words = p.select(F.explode("words").alias("word")).distinct()
    database = f"tw_{uuid.uuid4().hex}"
    frames = {"part.csv": p, "word.csv": words}
    plans = relations.write_tables(spark, group, database, frames, column=lambda t, header: f"c_{header}", context=lambda t, header: f"{t.url}#{header}")
    rows = relations.read_tables(spark, database, plans)["part.csv"]
    staged = stage(spark, rows.select("p_partkey", F.array_join("words", "|").alias("words")), "catalog")
    spark.sql(f"DROP DATABASE `{database}` CASCADE")
    return staged


def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a constraint of their table: all of them, as a table; nothing else is written."""
    group = TableGroup.of({"tables": [
        {"url": "customer.csv", "tableSchema": {"columns": [{"name": "c_custkey", "datatype": "long"}, {"name": "c_acctbal", "datatype": {"base": "double", "minimum": "0"}}, {"name": "c_mktsegment", "required": True}], "primaryKey": "c_custkey"}},
        {"url": "orders.csv", "tableSchema": {"columns": [{"name": "o_orderkey", "datatype": "long"}, {"name": "o_custkey", "datatype": "long"}], "primaryKey": "o_orderkey", "foreignKeys": [{"columnReference": "o_custkey", "reference": {"resource": "customer.csv", "columnReference": "c_custkey"}}]}},
    ]})
    c, o = _cells(spark, sf_dir, "customer"), _cells(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    frames = {
        "customer.csv": c.filter("c_custkey % 7 > 0").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.col("c_custkey").alias("rownum"), F.col("c_custkey").alias("sourcenum")),
        "orders.csv": o.withColumn("rownum", F.col("o_orderkey")).withColumn("sourcenum", F.col("o_orderkey")),
    }
    database = f"tw_{uuid.uuid4().hex}"
    try:
        relations.write_tables(spark, group, database, frames, refused="refused")
    except ValueError:
        pass  # what is wrong is in the table
    staged = stage(spark, spark.table(f"`{database}`.refused").select("kind", "url", "sourcenum", "columns"), "refused")
    spark.sql(f"DROP DATABASE `{database}` CASCADE")
    return staged


def _written_text(spark: SparkSession, lines: DataFrame) -> str:
    path = new_path(spark, "text")
    lines.write.text(path)
    return path


def dsv_comments_skip_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, blank rows, a skipped column and trimmed cells, by the parallel exact reader."""
    c = _cells(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("# note "), F.col("c_name"))).when(F.col("c_custkey") % 10 == 1, "").otherwise(F.concat_ws(",", F.lit("x"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")), F.concat(F.lit('" '), F.col("c_mktsegment"), F.lit(', ""so"" "'))))
    path = _written_text(spark, c.select(line.alias("value")))
    rows = dsv.read_cells(spark, path, Dialect(header=False, skip_blank_rows=True, skip_columns=1, trim="true"))
    comment = F.col("is_comment")
    return rows.select(comment.alias("is_comment"), F.get("cells", F.lit(0)).alias("first"), F.when(~comment, F.get("cells", F.lit(1))).alias("second"))


def dsv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed scan of files with quoted line breaks, by the parallel exact reader."""
    o = _cells(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('\n""'), F.col("o_orderpriority"), F.lit('""\n"')), F.col("o_custkey").cast("string"))
    path = _written_text(spark, o.select(line.alias("value")))
    t = TableGroup.of({"url": path, "dialect": {"header": False}, "tableSchema": {"columns": [{"name": "o_orderkey", "datatype": "long"}, {"name": "note"}, {"name": "o_custkey", "datatype": {"base": "long", "maximum": "900"}}]}}).tables[0]
    return scan(spark, t, path).good.select("o_orderkey", "note", "o_custkey")


def rewrite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row changed, or dropped, by a Python function."""
    lines = _cells(spark, sf_dir, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    rows = dsv.read_cells(spark, _written_text(spark, lines), Dialect(header=False))
    made = dsv.visit_rows(rows, lambda i, cells: [cells[0], cells[1].upper()] if int(cells[0]) % 3 else None)
    return made.select(F.get("cells", F.lit(0)).cast("long").alias("s_suppkey"), F.get("cells", F.lit(1)).alias("name"))


def primary_key_over_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat in other part files of a table, at the same place in each: rows are numbered over all parts."""
    c = _cells(spark, sf_dir, "customer", "c_nationkey", "c_custkey")
    parts = [new_path(spark, "part") for _ in range(3)]
    for k, path in enumerate(parts):
        dsv.write_dir(c.filter(F.col("c_custkey") % 3 == k).orderBy("c_custkey"), path, Dialect(comment_prefix=None))
    t = _table("customer.csv", {"c_nationkey": "integer", "c_custkey": "long"}, primaryKey="c_nationkey")
    return keys.check_primary_key(t, scan(spark, t, parts).good).groupBy("columns", "message").agg(F.count(F.lit(1)).alias("n"))


def written_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of blanks, tabs, carriage returns, line feeds, quotes and backslashes, written in parallel as one file and as a
    folder, and read again."""
    odd = F.array(*[F.lit(x) for x in ("  ", "\t", " a ", "b\r", "c\r\nd", "\n", '"', '""', "\\", 'x,"y"', "", ",", "é\u2028", "#")])
    cells = _cells(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.get(odd, (F.col("c_custkey") % 14).cast("int")).alias("odd"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"))
    d, folder = Dialect(comment_prefix=None), new_path(spark, "folder")
    file = new_path(spark, "file.csv")
    dsv.write_dir(cells, folder, d)
    dsv.write_file(cells, file, d, order=["name"])
    read = [dsv.table_rows(dsv.read_cells(spark, path, d), True).select(F.lit(form).alias("form"), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(cells.columns)]) for form, path in (("folder", folder), ("file", file))]
    return read[0].union(read[1])


def nested_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a row about five subjects, each of which stands inside the one that refers to it."""
    base = "http://example.org/"
    about = [base + x for x in ("order/{o}", "customer/{c}", "status/{s}", "priority/{p}", "day/{d}")]
    columns: dict = {"o": {"_": 1, "aboutUrl": about[0]}}
    for k, name in enumerate("cspd"):
        columns[name] = {"_": 1, "aboutUrl": about[k], "propertyUrl": f"schema:{name}", "valueUrl": about[k + 1]}
    columns["total"] = {"_": 1, "datatype": "double", "aboutUrl": about[4]}
    t = _table("http://example.org/orders.csv", columns, aboutUrl=about[0])
    o = _cells(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).alias("p"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), (F.col("o_orderkey") + 0.5).alias("total"), F.col("o_orderkey").alias("rownum"), F.col("o_orderkey").alias("sourcenum"))
    return json_export.describe_rows(scan_frame(t, rows)).select("rownum", F.array_join("describes", ",").alias("json"))


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole document of two tables, written by tasks and joined in the shared folder; its lines."""
    group = TableGroup.of({"tables": [{"url": f"http://example.org/{t}.csv", "tableSchema": {"columns": [{"name": c, "datatype": kind} for c, kind in columns]}} for t, columns in (("nation", (("n_nationkey", "integer"), ("n_name", "string"))), ("customer", (("c_custkey", "long"), ("c_name", "string"))))]})
    scans = {}
    for t, name, key in zip(group.tables, ("nation", "customer"), ("n_nationkey", "c_custkey"), strict=True):
        cells = _cells(spark, sf_dir, name, *[c.header for c in t.schema.columns])
        scans[t.url] = scan_frame(t, cells.withColumn("rownum", F.col(key).cast("long") + 1).withColumn("sourcenum", F.col(key).cast("long") + 2))
    path = new_path(spark, "document.json")
    json_export.write_json(spark, group, path, minimal=True, scans=scans)
    return spark.read.text(path).select(F.col("value").alias("line"))


def repeated_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with one property share a list; a cell that is null leaves a single value."""
    t = _table("part.csv", {"p_partkey": "long", "p_brand": {"_": 1, "propertyUrl": "schema:about"}, "p_type": {"_": 1, "propertyUrl": "schema:about", "separator": " "}, "p_size": {"_": 1, "datatype": "integer", "propertyUrl": "schema:size"}, "more": {"_": 1, "datatype": "integer", "propertyUrl": "schema:size", "null": "-"}})
    p = _cells(spark, sf_dir, "part")
    cells = p.select("p_partkey", "p_brand", F.col("p_name").alias("p_type"), "p_size", F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).otherwise("-").alias("more"), F.col("p_partkey").alias("rownum"), F.col("p_partkey").alias("sourcenum"))
    return json_export.json_rows(scan_frame(t, cells), minimal=True)


def short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped rows, short rows and a column without a description, read from a file, with the lines where rows stand."""
    s = _cells(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), "s_name").orderBy("k")
    line = F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).otherwise(F.concat_ws(",", F.col("k").cast("string"), "s_name", F.lit("x")))
    head = spark.createDataFrame([(-3, "about this,file"), (-2, ""), (-1, "key,name,extra")], "k int, value string")
    path = _written_text(spark, head.union(s.select("k", line.alias("value"))).coalesce(1).sortWithinPartitions("k").select("value"))
    t = TableGroup.of({"url": path, "dialect": {"skipRows": 2, "header": True}, "tableSchema": {"columns": [{"name": "key", "datatype": "integer"}, {"name": "name"}]}}).tables[0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of the column without a description
        rows = scan(spark, t, path).good
    return rows.select("rownum", "sourcenum", F.col("key").cast("long").alias("key"), "name", "extra")


def row_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a file as maps by its header; surplus cells go under a key of their own."""
    s = _cells(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), "s_name").orderBy("k")
    line = F.concat_ws(",", F.col("k").cast("string"), "s_name", F.when(F.col("k") % 2 == 0, F.lit("p,q")))
    head = spark.createDataFrame([(-1, "key,name")], "k int, value string")
    path = _written_text(spark, head.union(s.select("k", line.alias("value"))).coalesce(1).sortWithinPartitions("k").select("value"))
    rows = dsv.read_dsv(spark, path, as_="dicts", restkey="rest").select("row")
    return rows.select(F.col("row")["key"].cast("long").alias("key"), F.col("row")["name"].alias("name"), F.try_element_at("row", F.lit("rest")).alias("rest"))


QUERIES = {f.__name__: f for f in (typed_lineitem, typed_revenue, rejected_rows, kept_rows, error_log, lenient_cells, nulls_and_defaults, lists, virtual_columns, uri_templates, booleans, formatted_numbers, parsed_numbers, dates, durations, binaries, json_cells, inferred_types, repeated_keys, primary_key_violations, orphans, orphans_in_lists, orphans_composite, strict_references, validation_report, json_minimal, json_standard, json_lineitem, cell_triples, association_table, written_cells, csv_lines, written_and_read, filtered_rows, added_rows, offset_stamps, exact_decimals, lexical_floats, json_schemas, duration_bounds, required_cells, slug_names, any_uri_normalise, group_triples, check_violations, assoc_read, dsv_comments_skip_trim, dsv_line_breaks, rewrite_rows, primary_key_over_parts, written_exactly, nested_subjects, json_document, repeated_properties, short_rows, row_maps, json_references, catalog_tables, refused_rows, long_numbers)}

ORACLE_SQL = {
    "typed_lineitem": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice, l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem",
    "typed_revenue": "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "rejected_rows": """SELECT 'l_orderkey' AS "column", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'l_linenumber', 0 UNION ALL SELECT 'l_extendedprice', 0 UNION ALL SELECT 'l_shipdate', 0
        UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""",
    "kept_rows": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 40 GROUP BY l_returnflag",
    "error_log": """SELECT 'orders.csv' AS url, o_orderkey + 1 AS sourcenum, 'o_orderpriority' AS "column", 'value must have at most length 6' AS message FROM orders WHERE length(o_orderpriority) > 6""",
    "lenient_cells": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_acctbal END AS raw_balance FROM supplier",
    "nulls_and_defaults": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE c_name END AS c_name FROM customer",
    "lists": "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_items, string_split(p_name, ' ')[1] AS first_item, replace(p_name, ' ', '|') AS items FROM part",
    "virtual_columns": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'http://example.org/nation/' || n_nationkey || '?name=' || replace(n_name, ' ', '%20') AS uri FROM nation",
    "uri_templates": "SELECT p_partkey, 'http://example.org/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '?p_name=' || replace(replace(p_name, '#', '%23'), ' ', '%20') || '&p_size=' || p_size || '#' || p_partkey AS uri FROM part",
    "booleans": "SELECT CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS flag, count(*) AS n FROM lineitem GROUP BY 1",
    "formatted_numbers": "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS shown FROM orders",
    "parsed_numbers": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders",
    "dates": "SELECT o_orderkey, day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) AS shown, CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AS valid FROM orders",
    "durations": "SELECT p_partkey, CAST(12 AS INTEGER) AS months, (CAST(p_size AS BIGINT) * 24 + 2) * 3600000000 AS micros, 'P1Y' || p_size || 'DT2H' AS shown FROM part",
    "binaries": "SELECT c_custkey, base64(encode(c_name)) AS base64, hex(c_name) AS hex, c_name AS back FROM customer",
    "json_cells": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) >= 50, false) AS valid FROM events",
    "inferred_types": """SELECT 'o_custkey' AS "column", 'integer' AS datatype UNION ALL SELECT 'o_orderdate', 'date' UNION ALL SELECT 'o_orderkey', 'integer' UNION ALL SELECT 'o_orderpriority', 'string' UNION ALL SELECT 'o_orderstatus', 'string' UNION ALL SELECT 'o_totalprice', 'decimal'""",
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "primary_key_violations": """SELECT o_orderkey + 1 AS sourcenum, 'o_custkey' AS columns, 'duplicate key ["' || o_custkey || '"]' AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 1""",
    "orphans": """SELECT l_orderkey AS sourcenum, 'no row in parent.csv for ["' || l_orderkey || '"]' AS message, count(*) AS n
        FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2""",
    "orphans_in_lists": """SELECT p_partkey AS sourcenum, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)
        WHERE w NOT IN (SELECT x FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part WHERE p_brand = 'Brand#4') WHERE x < 'm') GROUP BY 1""",
    "orphans_composite": """SELECT l_partkey AS sourcenum, count(*) AS n FROM lineitem l WHERE l_suppkey % 5 > 0
        AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'A' AND p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey) GROUP BY 1""",
    "strict_references": """SELECT 'null reference' AS kind, count(*) AS n FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 'parent key', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)""",
    "validation_report": """SELECT 'cell' AS kind, count(*) AS n FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'primary key', count(*) - count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'foreign key', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
    "json_minimal": """SELECT CAST(n_nationkey AS BIGINT) + 1 AS rownum, '{"n_nationkey":' || n_nationkey || ',"schema:name":"' || n_name || '","n_regionkey":"http://example.org/region/' || n_regionkey || '"}' AS json FROM nation""",
    "json_standard": """SELECT CAST(n_nationkey AS BIGINT) + 1 AS rownum, '{"url":"http://example.org/nation.csv#row=' || (n_nationkey + 2) || '","rownum":' || (n_nationkey + 1) || ',"titles":"' || n_name
        || '","describes":[{"@id":"http://example.org/nation.csv#nation-' || n_nationkey || '","n_nationkey":' || n_nationkey || ',"schema:name":"' || n_name || '","n_regionkey":"http://example.org/region/' || n_regionkey || '"}]}' AS json FROM nation""",
    "json_lineitem": """SELECT l_orderkey AS rownum, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}' AS json FROM lineitem""",
    "cell_triples": """SELECT CAST(n_nationkey AS BIGINT) + 1 AS rownum, 'http://example.org/nation.csv#nation-' || n_nationkey AS about, p.property, CASE p.property WHEN 'n_nationkey' THEN CAST(n_nationkey AS VARCHAR) WHEN 'schema:name' THEN n_name ELSE 'http://example.org/region/' || n_regionkey END AS value, p.property = 'n_regionkey' AS is_url
        FROM nation, (VALUES ('n_nationkey'), ('schema:name'), ('n_regionkey')) p(property)""",
    "association_table": "SELECT p_partkey AS part_p_partkey, unnest(string_split(p_name, ' ')) AS word_word, CAST(unnest(range(len(string_split(p_name, ' ')))) AS BIGINT) AS position FROM part",
    "written_cells": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) ELSE '-' END AS p_size, replace(p_name, ' ', ';') AS p_type FROM part",
    "csv_lines": """SELECT c_custkey, c_name || ',' || CASE WHEN c_custkey % 2 = 0 THEN '"said ""' || c_mktsegment || '"", twice"' ELSE c_mktsegment END AS line FROM customer""",
    "written_and_read": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "filtered_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "added_rows": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT -c_custkey, upper(c_name) FROM customer",
    "offset_stamps": """SELECT o_orderkey, day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || strftime(o_orderdate, ' %H:%M') || ' +0' || (o_orderkey % 9) AS shown,
        '+0' || (o_orderkey % 9) || ':00' AS zone, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS clock FROM orders""",
    "exact_decimals": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '.5' END AS shown, o_orderkey % 2 = 0 AS valid FROM orders",
    "lexical_floats": "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN p_partkey * 10.0 WHEN 2 THEN p_partkey + 0.5 WHEN 5 THEN p_partkey END::DOUBLE AS value FROM part",
    "json_schemas": """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) > 10 AND CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0, false) AS valid_object,
        CAST(user_id AS VARCHAR)[1] IN ('0', '1', '2', '3', '4') AS valid_list FROM events""",
    "duration_bounds": "SELECT p_partkey, p_size BETWEEN 1 AND 27 AS days, p_size BETWEEN 24 AND 28 * 24 - 1 AS hours FROM part",
    "required_cells": """SELECT o_orderkey + 1 AS sourcenum, 'o_orderpriority' AS "column", 'required value is missing' AS message FROM orders WHERE o_orderpriority = '5-LOW'""",
    "slug_names": "SELECT c_custkey, lower(replace(c_name, '#', '')) AS slug, '_1_' || replace(c_name, '#', '_') AS name FROM customer",
    "any_uri_normalise": """SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1)) || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)', 1))
        || regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?', '') AS uri FROM (SELECT page_id, upper(url[1:20]) || url[21:] AS u FROM pages)""",
    "group_triples": """SELECT o_orderkey AS rownum, '{"@id":"http://example.org/order/' || o_orderkey || '","o_orderkey":' || o_orderkey || ',"schema:customer":{"@id":"http://example.org/customer/' || o_custkey || '","schema:status":"' || o_orderstatus || '"}}' AS json FROM orders""",
    "check_violations": """SELECT 'check' AS kind, 'l_quantity' AS columns, 'value must be <= 40' AS message, count(*) AS n FROM lineitem WHERE l_quantity > 40 HAVING count(*) > 0
        UNION ALL SELECT 'check', 'l_returnflag', 'value must have at least length 2', count(*) FROM lineitem WHERE length(l_returnflag) < 2 HAVING count(*) > 0
        UNION ALL SELECT 'check', 'l_tax', 'value must be > 0', count(*) FROM lineitem WHERE l_tax <= 0 HAVING count(*) > 0""",
    "assoc_read": "SELECT p_partkey, CASE WHEN p_size > 5 THEN replace(p_name, ' ', '|') ELSE '' END AS words FROM part",
    "dsv_comments_skip_trim": """SELECT c_custkey % 10 = 0 AS is_comment, CASE WHEN c_custkey % 10 = 0 THEN 'note ' || c_name ELSE c_name END AS first, CASE WHEN c_custkey % 10 > 1 THEN c_mktsegment || ', "so"' END AS second
        FROM customer WHERE c_custkey % 10 <> 1""",
    "dsv_line_breaks": """SELECT o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '"' || chr(10) AS note, o_custkey FROM orders WHERE o_custkey <= 900""",
    "rewrite_rows": "SELECT s_suppkey, upper(s_name) AS name FROM supplier WHERE s_suppkey % 3 > 0",
    "primary_key_over_parts": """SELECT 'c_nationkey' AS columns, 'duplicate key ["' || c_nationkey || '"]' AS message, count(*) - 1 AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1""",
    "written_exactly": """SELECT form, CAST(c_custkey AS VARCHAR) AS key, (['  ', chr(9), ' a ', 'b' || chr(13), 'c' || chr(13) || chr(10) || 'd', chr(10), '"', '""', chr(92), 'x,"y"', '', ',', 'é' || chr(8232), '#'])[c_custkey % 14 + 1] AS odd, ' ' || c_name || ' ' AS name
        FROM customer, (VALUES ('folder'), ('file')) f(form)""",
    "nested_subjects": """SELECT o_orderkey AS rownum, '{"@id":"http://example.org/order/' || o_orderkey || '","o":"' || o_orderkey || '","schema:c":{"@id":"http://example.org/customer/' || o_custkey || '","schema:s":{"@id":"http://example.org/status/' || o_orderstatus
        || '","schema:p":{"@id":"http://example.org/priority/' || o_orderpriority[1] || '","schema:d":{"@id":"http://example.org/day/' || strftime(o_orderdate, '%Y%m%d') || '","total":' || o_orderkey || '.5}}}}}' AS json FROM orders""",
    "json_document": """SELECT '[' AS line UNION ALL SELECT ']' UNION ALL SELECT CASE WHEN n_nationkey > 0 THEN ',' ELSE '' END || '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' FROM nation
        UNION ALL SELECT ',{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' FROM customer""",
    "repeated_properties": """SELECT p_partkey AS rownum, '{"p_partkey":' || p_partkey || ',"schema:about":["' || p_brand || '","' || replace(p_name, ' ', '","') || '"],"schema:size":' || CASE WHEN p_size > 9 THEN '[' || p_size || ',' || p_size || ']' ELSE p_size::VARCHAR END || '}' AS json FROM part""",
    "short_rows": """SELECT row_number() OVER (ORDER BY s_suppkey) AS rownum, row_number() OVER (ORDER BY s_suppkey) + 3 AS sourcenum, CAST(s_suppkey AS BIGINT) AS key, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'x' END AS extra FROM supplier""",
    "row_maps": "SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'p,q' END AS rest FROM supplier",
    "json_references": """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) >= 50, false) AS valid_shared, user_id <= 900 AND event_id % 2 = 1 AS valid_chain FROM events""",
    "catalog_tables": "SELECT p_partkey, replace(p_name, ' ', '|') AS words FROM part",
    "refused_rows": """SELECT 'check' AS kind, 'customer.csv' AS url, c_custkey AS sourcenum, 'c_acctbal' AS columns FROM customer WHERE c_custkey % 7 > 0 AND c_acctbal < 0
        UNION ALL SELECT 'not null', 'customer.csv', c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 10 = 0
        UNION ALL SELECT 'foreign key', 'orders.csv', o_orderkey, 'o_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0)""",
    "long_numbers": """WITH n AS (SELECT o_orderkey, o_orderkey % 10 AS d, CASE WHEN o_orderkey % 20 >= 10 THEN '-' ELSE '' END AS s FROM orders),
        t AS (SELECT *, CASE WHEN d = 0 THEN '0' ELSE repeat(CAST(d AS VARCHAR), 60) END AS w, repeat('0', 29) || '1' AS f FROM n)
        SELECT o_orderkey, s || w || '.' || f AS digits, s || w || ',' || f AS shown, CASE WHEN s = '-' THEN d < 5 ELSE d < 7 END AS valid, s = '' AND d > 0 AS valid_whole FROM t""",
}
