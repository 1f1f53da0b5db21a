"""Groups of tables in the catalog: one commit, constraints, names."""

import uuid

import pytest
from pyspark.sql import functions as F

from tabweave.model import TableGroup
from tabweave.operators import relations


@pytest.fixture
def database(spark):
    name = f"tw_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def group_of_three():
    columns = {"columns": [{"name": "id", "datatype": "integer"}, {"name": "note", "required": True}], "primaryKey": "id"}
    return TableGroup.of({"tables": [{"url": f"{x}.csv", "tableSchema": columns} for x in "abc"]})


def frames(spark, note, broken=None):
    rows = {x: spark.createDataFrame([(1, note), (2, note)], "id int, note string") for x in "abc"}
    if broken:
        rows[broken] = rows[broken].withColumn("note", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("note")))
    return {f"{x}.csv": df for x, df in rows.items()}


def notes(spark, database):
    return [{r.note for r in spark.table(f"{database}.{x}").collect()} for x in "abc"]


def test_all_tables_or_none(spark, database, monkeypatch):
    group = group_of_three()
    relations.write_tables(spark, group, database, frames(spark, "old"))
    with pytest.raises(ValueError, match="there already"):
        relations.write_tables(spark, group, database, frames(spark, "new"))
    with pytest.raises(Exception, match="lost"):
        relations.write_tables(spark, group, database, frames(spark, "new", "c"), force=True)
    assert notes(spark, database) == [{"old"}] * 3
    # The third table cannot be copied.
    plan = relations.TablePlan.ddl
    monkeypatch.setattr(relations.TablePlan, "ddl", lambda self, *a: plan(self, *a) if self.name != "c" else "CREATE TABLE nowhere.c (x int) USING parquet")
    with pytest.raises(Exception):
        relations.write_tables(spark, group, database, frames(spark, "new"), force=True)
    monkeypatch.undo()
    assert notes(spark, database) == [{"old"}] * 3
    # The third table cannot take its place.
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: pytest.fail("stop") if "RENAME TO" in q and q.endswith(".`c`") and "_tw_new_" in q else sql(self, q, *a, **k))
    with pytest.raises(BaseException, match="stop"):
        relations.write_tables(spark, group, database, frames(spark, "new"), force=True)
    monkeypatch.undo()
    assert notes(spark, database) == [{"old"}] * 3
    relations.write_tables(spark, group, database, frames(spark, "new"), force=True)
    assert notes(spark, database) == [{"new"}] * 3
    assert sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary) == ["a", "b", "c"]


def test_views_of_the_session_are_no_tables(spark, database):
    spark.range(1).createOrReplaceTempView("a")
    try:
        relations.write_tables(spark, group_of_three(), database, frames(spark, "x"))
        assert notes(spark, database) == [{"x"}] * 3
    finally:
        spark.catalog.dropTempView("a")


def test_not_null_and_refused_rows(spark, database):
    group = group_of_three()
    plans = relations.write_tables(spark, group, database, frames(spark, "x"))
    assert "`note` string NOT NULL" in plans[0].ddl()
    rows = frames(spark, "x") | {"b.csv": spark.createDataFrame([(1, "x", 4), (1, None, 9)], "id int, note string, sourcenum long")}
    with pytest.raises(ValueError, match="b.csv"):
        relations.write_tables(spark, group, database, rows, force=True, refused="refused")
    found = spark.table(f"{database}.refused").select("kind", "url", "sourcenum", "columns").collect()
    assert sorted(map(tuple, found)) == [("not null", "b.csv", 9, "note"), ("primary key", "b.csv", 9, "id")]
    assert notes(spark, database) == [{"x"}] * 3


def test_frames_are_evaluated_once(spark, database):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def note(i):
        seen.add(1)
        return str(i)

    rows = frames(spark, "x")
    rows["a.csv"] = rows["a.csv"].withColumn("note", note("id"))
    relations.write_tables(spark, group_of_three(), database, rows)
    assert seen.value == 2


def test_names_of_columns_and_contexts(spark, database):
    group = TableGroup.of({"tables": [
        {"url": "part.csv", "tableSchema": {"columns": [{"name": "key", "datatype": "integer"}, {"name": "words", "separator": " "}], "primaryKey": "key", "foreignKeys": [{"columnReference": "words", "reference": {"resource": "word.csv", "columnReference": "word"}}]}},
        {"url": "word.csv", "tableSchema": {"columns": [{"name": "word"}], "primaryKey": "word"}},
    ]})
    rows = {"part.csv": spark.createDataFrame([(1, ["b", "a"]), (2, [])], "key int, words array<string>"), "word.csv": spark.createDataFrame([("a",), ("b",)], "word string")}
    plans = relations.write_tables(spark, group, database, rows, column=lambda t, h: f"{h}_x", context=lambda t, h: f"{t.url}/{h}")
    assert spark.table(f"{database}.part").columns == ["key_x"]
    links = spark.table(f"{database}.part_word")
    assert links.columns[:2] == ["part_key_x", "word_word_x"] and {r.context for r in links.collect()} == {"part.csv/words"}
    back = relations.read_tables(spark, database, plans)["part.csv"].orderBy("key").collect()
    assert [(r.key, r.words) for r in back] == [(1, ["b", "a"]), (2, [])]
    with pytest.raises(ValueError, match="one name"):
        relations.plan_tables(group_of_three(), column=lambda t, h: "same")
