"""A quoted line break gives one row in every operator that reads a file."""

import json

import pytest

from tabweave.model import TableGroup
from tabweave.operators import json_export, keys, relations
from tabweave.operators.scan import scan


@pytest.fixture
def group(tmp_path):
    (tmp_path / "notes.csv").write_bytes(b'id,note\r\n1,"one\ntwo"\r\n2,x\r\n1,y\r\n')
    description = {
        "@context": "http://www.w3.org/ns/csvw",
        "url": "notes.csv",
        "dialect": {"skipBlankRows": True, "commentPrefix": None},
        "tableSchema": {"columns": [{"name": "id", "datatype": "integer"}, {"name": "note"}], "primaryKey": "id"},
    }
    (tmp_path / "notes.csv-metadata.json").write_text(json.dumps(description))
    return TableGroup.from_file(tmp_path / "notes.csv-metadata.json")


def test_quoted_line_break(spark, group, tmp_path):
    assert group.tables[0].effective_dialect.plain
    found = keys.validate(spark, group).collect()
    assert [(r.kind, r.sourcenum) for r in found] == [("primary key", 5)]
    rows = [(r.id, r.note) for r in scan(spark, group.tables[0], strict_header=False).good.orderBy("rownum").collect()]
    assert rows == [(1, "one\ntwo"), (2, "x"), (1, "y")]
    made = json_export.to_json(spark, group, True)
    assert [r["note"] for r in made] == ["one\ntwo", "x", "y"]
    group.tables[0].schema.primary_key = []
    relations.write_tables(spark, group, "tw_breaks", force=True)
    assert sorted(r.note for r in spark.table("tw_breaks.notes").collect()) == ["one\ntwo", "x", "y"]
    spark.sql("DROP DATABASE tw_breaks CASCADE")
