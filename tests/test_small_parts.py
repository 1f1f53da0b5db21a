"""Parts that stand beside the scan: lines in memory, rows one by one, numbers with units, inert properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabweave import describe
from tabweave.functions.types import compile_datatype
from tabweave.model import CONTEXT, TableGroup
from tabweave.operators.scan import scan
from tabweave.sources import dsv

SF = "/root/testdata/sf0.001"


def test_lines_in_memory(spark):
    path = dsv.put_lines(spark, ["id,note", b"1,x\r\n", '2,"a\n', 'b"'])
    t = TableGroup.of({"url": path, "tableSchema": {"columns": [{"name": "id", "datatype": "integer"}, {"name": "note"}]}}).tables[0]
    assert [(r.rownum, int(r.id), r.note) for r in scan(spark, t, path)] == [(1, 1, "x"), (2, 2, "a\nb")]
    with pytest.raises(Exception, match="not a valid integer"):
        list(scan(spark, t, dsv.put_lines(spark, ["id,note", "x,y"])))


def test_numbers_with_units(spark):
    field = {"name": "price", "type": "number", "bareNumber": False, "decimalChar": ",", "groupChar": "."}
    fields = [field, {"name": "n", "type": "integer", "bareNumber": False}]
    made = describe.from_datapackage({"resources": [{"name": "p", "path": "p.csv", "scheme": "file", "format": "csv", "schema": {"fields": fields}}]})
    columns = (made["tables"][0] if "tables" in made else made)["tableSchema"]["columns"]
    formats = [c["datatype"]["format"] for c in columns]
    assert formats[1] == {"bareNumber": False}
    rows = spark.createDataFrame([("1.234,50 €", "95%"), ("$ -7,5", "EUR 12 each"), ("none", "x")], "a string, b string")
    price, whole = compile_datatype("decimal", formats[0]), compile_datatype("integer", formats[1])
    made = rows.select(price.parse(F.col("a")).cast("double").alias("a"), whole.parse(F.col("b")).cast("int").alias("b")).collect()
    assert [tuple(r) for r in made] == [(1234.5, 95), (-7.5, 12), (None, None)]


def test_inert_properties_of_groups_are_checked():
    described = {"@context": CONTEXT, "tables": [{"url": "t.csv"}], "tableDirection": "up", "transformations": 5}
    with pytest.warns(UserWarning) as seen:
        group = TableGroup.of(described)
    assert len([w for w in seen if "tableDirection" in str(w.message) or "transformations" in str(w.message)]) == 2
    assert "tableDirection" not in group.asdict()


@pytest.mark.parametrize("name", ["typed_lineitem", "typed_revenue", "rejected_rows", "kept_rows", "json_lineitem", "json_cells", "formatted_numbers", "dates", "validation_report"])
def test_generated_methods_are_short_enough_to_be_compiled(spark, name):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = __spark_entry__.queries()[name](spark, SF)
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        assert max((found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())), default=0) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
