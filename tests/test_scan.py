"""Metadata, typed scan, keys, exports and files on small tables."""

import json
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from tabweave import describe, discover
from tabweave.cli import main
from tabweave.functions.uritemplate import compile_template, expand
from tabweave.model import CONTEXT, NaturalLanguage, TableGroup
from tabweave.operators import groups, json_export, keys, relations
from tabweave.operators.scan import comments, scan, write_table
from tabweave.sources import dsv
from tabweave.sources.dialect import Dialect, normal_name, slug


def put(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


def group_of(folder, description):
    path = put(folder, "metadata.json", json.dumps({"@context": CONTEXT, **description}))
    return TableGroup.from_file(path)


def cells(spark, path, **dialect):
    rows = dsv.read_cells(spark, path, Dialect.of(dialect)).orderBy("sourcenum").collect()
    return [(r.sourcenum, r.cells) for r in rows if not r.is_comment], [(r.sourcenum, r.cells[0]) for r in rows if r.is_comment]


@pytest.mark.parametrize(
    "text,dialect,rows,notes",
    [
        ("a,b\r\n1,2\r\n", {}, [(1, ["a", "b"]), (2, ["1", "2"])], []),
        ("#x\na\n", {}, [(2, ["a"])], [(1, "x")]),
        ("#x\na\n", {"commentPrefix": None}, [(1, ["#x"]), (2, ["a"])], []),
        ("1\n2\n3\n", {"skipRows": 2}, [(3, ["3"])], [(1, "1"), (2, "2")]),
        ("a\n\nb\n", {"skipBlankRows": True}, [(1, ["a"]), (3, ["b"])], []),
        ("a\n\nb\n", {}, [(1, ["a"]), (2, []), (3, ["b"])], []),
        (" a , b \n", {"trim": True}, [(1, ["a", "b"])], []),
        (" a , b \n", {"trim": "start"}, [(1, ["a ", "b "])], []),
        ("a,b,c\n", {"skipColumns": 1}, [(1, ["b", "c"])], []),
        ('"x\ny",1\n2,3\n', {}, [(2, ["x\ny", "1"]), (3, ["2", "3"])], []),
        ('"x""y"\n', {}, [(1, ['x"y'])], []),
        ('"x\\"y"\n', {"doubleQuote": False}, [(1, ['x"y'])], []),
        ("a\tb\n", {"delimiter": "\t", "quoteChar": None}, [(1, ["a", "b"])], []),
    ],
)
def test_dialects(spark, tmp_path, text, dialect, rows, notes):
    assert cells(spark, put(tmp_path, "t.csv", text), **dialect) == (rows, notes)


def test_encodings_and_zip(spark, tmp_path):
    for encoding in ("utf-16", "latin-1", "utf-8-sig"):
        path = put(tmp_path, f"{encoding}.csv", "ä,b\n", encoding)
        assert cells(spark, path, encoding=encoding)[0] == [(1, ["ä", "b"])]
    with zipfile.ZipFile(tmp_path / "z.csv.zip", "w") as z:
        z.writestr("z.csv", "a,b\n1,2\n")
    assert cells(spark, str(tmp_path / "z.csv"))[0] == [(1, ["a", "b"]), (2, ["1", "2"])]


def test_bad_dialects_warn():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        d = Dialect.of({"skipRows": -1, "delimiter": ";;", "colour": 1, "encoding": "none"})
    assert len(seen) == 4 and d == Dialect()


def test_row_forms(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a b,c\n1\n2,3,4\n")
    rows = dsv.read_dsv(spark, path, as_="dicts", restkey="more", restval="-").orderBy("rownum").collect()
    assert [r.row for r in rows] == [{"a b": "1", "c": "-"}, {"a b": "2", "c": "3", "more": "4"}]
    named = dsv.read_dsv(spark, path, as_="names").orderBy("rownum")
    assert named.columns == ["rownum", "sourcenum", "a_b", "c"]
    with pytest.raises(ValueError):
        dsv.read_dsv(spark, path, as_="both")


TREES = {
    "url": "trees.csv",
    "tableSchema": {
        "columns": [
            {"name": "GID", "required": True, "titles": "id"},
            {"name": "on_street", "separator": ";", "null": "NA", "titles": "street"},
            {"name": "n", "datatype": {"base": "integer", "maximum": "9"}, "default": "7"},
            {"name": "day", "datatype": {"base": "date", "format": "M/d/yyyy"}},
            {"name": "link", "virtual": True, "valueUrl": "#{GID}", "propertyUrl": "rdf:type"},
        ],
        "primaryKey": "GID",
        "aboutUrl": "#gid-{GID}",
    },
}
TEXT = "id,street,n,day,extra\n1,a;b,,10/18/2010,x\n2,NA,5,6/2/2010\n3,,12,6/2/2010,y\n,a,1,6/2/2010,z\n"


def trees(spark, tmp_path):
    put(tmp_path, "trees.csv", TEXT)
    return scan(spark, group_of(tmp_path, TREES).tables[0])


@pytest.mark.filterwarnings("ignore")
def test_typed_scan(spark, tmp_path):
    s = trees(spark, tmp_path)
    good = [r.asDict() for r in s.good.orderBy("rownum").collect()]
    assert [(r["GID"], r["on_street"], int(r["n"]), str(r["day"]), r["extra"], r["link"]) for r in good] == [("1", ["a", "b"], 7, "2010-10-18", "x", "#1"), ("2", None, 5, "2010-06-02", None, "#2")]
    assert sorted((r.sourcenum, r.column, r.message) for r in s.errors.collect()) == [(4, "n", "value must be <= 9"), (5, "GID", "required value is missing")]
    assert {r.GID: r._raw for r in s.lenient.collect()}["3"] == {"n": "12"}
    assert {r.column: r.n for r in s.error_counts().collect()} == {"GID": 1, "on_street": 0, "n": 1, "day": 0}
    with pytest.raises(Exception, match="trees.csv:4 n: value must be <= 9"):
        s.strict.collect()
    assert s.typed("GID").columns == ["rownum", "sourcenum", "GID"]


@pytest.mark.filterwarnings("ignore")
def test_write_and_read_again(spark, tmp_path):
    s = trees(spark, tmp_path)
    written = write_table(s.table, s.good.drop("extra", "link"), as_bytes=True).decode()
    assert written == "GID,on_street,n,day\r\n1,a;b,7,10/18/2010\r\n2,,5,6/2/2010\r\n"
    with pytest.raises(ValueError):
        write_table(s.table, s.good)


def test_missing_required_column(spark, tmp_path):
    put(tmp_path, "trees.csv", "street\na\n")
    with pytest.raises(ValueError, match="required columns are missing"):
        scan(spark, group_of(tmp_path, TREES).tables[0])


@pytest.mark.filterwarnings("ignore")
def test_json(spark, tmp_path):
    s = trees(spark, tmp_path)
    first = json.loads(json_export.json_rows(s, minimal=True).orderBy("rownum").first().json)
    assert first == {"@id": "trees.csv#gid-1", "GID": "1", "on_street": ["a", "b"], "n": 7, "day": "2010-10-18", "extra": "x", "@type": "trees.csv#1"}
    whole = json_export.to_json(spark, group_of(tmp_path, TREES))
    assert whole["tables"][0]["url"] == "trees.csv"
    assert whole["tables"][0]["row"][1]["url"] == "trees.csv#row=3" and whole["tables"][0]["row"][1]["rownum"] == 2
    facts = {(r.about, r.property, r.value) for r in json_export.triples(s).filter("rownum = 1").collect()}
    assert ("trees.csv#gid-1", "n", "7") in facts


COUNTRIES = {
    "tables": [
        {"url": "countries.csv", "tableSchema": {"columns": [{"name": "code"}, {"name": "name"}], "primaryKey": "code"}},
        {"url": "slices.csv", "tableSchema": {"columns": [{"name": "id"}, {"name": "ref", "separator": ";"}, {"name": "one", "null": ""}], "primaryKey": "id", "foreignKeys": [{"columnReference": "ref", "reference": {"resource": "countries.csv", "columnReference": "code"}}, {"columnReference": "one", "reference": {"resource": "countries.csv", "columnReference": "code"}}]}},
    ]
}


def countries(tmp_path, slices, codes="code,name\nAD,Andorra\nAF,Afghanistan\n"):
    put(tmp_path, "countries.csv", codes)
    put(tmp_path, "slices.csv", "id,ref,one\n" + slices)
    return group_of(tmp_path, COUNTRIES)


def test_keys(spark, tmp_path):
    group = countries(tmp_path, "1,AD;AF,AD\n2,,\n")
    assert keys.validate(spark, group, strict=False).isEmpty()
    assert [r.kind for r in keys.validate(spark, group).collect()] == ["null reference"]
    group = countries(tmp_path, "1,AD;XX,AD\n1,AD,YY\n", "code,name\nAD,a\nAD,b\n")
    found = {(r.kind, r.url, r.sourcenum) for r in keys.validate(spark, group).collect()}
    assert found == {("primary key", "countries.csv", 3), ("primary key", "slices.csv", 3), ("foreign key", "slices.csv", 2), ("foreign key", "slices.csv", 3), ("parent key", "countries.csv", None)}
    assert not keys.is_valid(spark, group)


@pytest.mark.parametrize("change", [{"columnReference": "none"}, {"columnReference": ["id", "one"]}, {"reference": {"resource": "none.csv", "columnReference": "code"}}])
def test_foreign_keys_that_do_not_fit(change):
    d = json.loads(json.dumps(COUNTRIES))
    d["tables"][1]["tableSchema"]["foreignKeys"][0] |= change
    with pytest.raises(ValueError):
        TableGroup.of(d).validate_schema()


def test_catalog_tables(spark, tmp_path):
    group = countries(tmp_path, "1,AF;AD,AD\n2,,\n")
    spark.sql("DROP DATABASE IF EXISTS tw_test CASCADE")
    spark.sql(f"CREATE DATABASE tw_test LOCATION '{tmp_path}/db'")
    plans = relations.write_tables(spark, group, "tw_test")
    assert [p.name for p in plans] == ["countries", "slices"] and "NOT NULL" in plans[0].ddl()
    back = {r.id: (r.ref, r.one) for r in relations.read_tables(spark, "tw_test", plans)["slices.csv"].collect()}
    assert back == {"1": (["AF", "AD"], "AD"), "2": ([], None)}
    with pytest.raises(ValueError, match="there already"):
        relations.write_tables(spark, group, "tw_test")
    with pytest.raises(ValueError, match="foreign key"):
        relations.write_tables(spark, countries(tmp_path, "1,XX,AD\n"), "tw_test", force=True)
    spark.sql("DROP DATABASE tw_test CASCADE")


def test_row_changes(spark, tmp_path):
    path = put(tmp_path, "r.csv", "a,b\n1,2\n3,4\n")
    dsv.rewrite(spark, path, lambda i, row: None if i == 1 else [x.upper() for x in row])
    assert (tmp_path / "r.csv").read_text() == "A,B\n3,4\n"
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string")
    kept, seen = dsv.filter_rows(df, lambda r: r["n"] > 1, "counted")
    assert [r.t for r in kept.collect()] == ["y"] and seen.get["removed"] == 1
    assert dsv.add_rows(df, df).count() == 4
    assert dsv.write_file(df, str(tmp_path / "w.csv"), zipped=True) == 2
    assert cells(spark, str(tmp_path / "w.csv"))[0][1][1] == ["1", "x"]


def test_discovery(spark, tmp_path, monkeypatch):
    site = {"http://x.org/t.csv": (b"a,b\n1,2\n", {"link": '<meta.json>; rel="describedby"'}), "http://x.org/meta.json": (json.dumps({"@context": CONTEXT, "url": "t.csv", "tableSchema": {"columns": [{"name": "a", "datatype": "integer"}, {"name": "b"}]}}).encode(), {})}

    def get(url):
        if url not in site:
            raise OSError(url)
        return site[url]

    monkeypatch.setattr(discover, "fetcher", get)
    group = discover.open_dataset("http://x.org/t.csv")
    assert [(int(r.a), r.b) for r in scan(spark, group.tables[0]).good.collect()] == [(1, "2")]
    put(tmp_path, "t.csv", "x,y\n1,2\n")
    assert discover.open_dataset(str(tmp_path / "t.csv")).tables[0].schema.columns == []
    put(tmp_path, "t.csv-metadata.json", json.dumps({"@context": CONTEXT, "url": "t.csv", "tableSchema": {"columns": [{"name": "x"}, {"name": "y"}]}}))
    assert len(discover.open_dataset(str(tmp_path / "t.csv")).tables[0].schema.columns) == 2


def test_describe_package_and_markdown(spark, tmp_path):
    path = put(tmp_path, "d.csv", "i,f,d,s,b\n1,1.5,2020-01-01,x,true\n2,2,2020-01-02,y,false\n")
    made = describe.describe(spark, path)
    assert [c["datatype"] for c in made["tableSchema"]["columns"]] == ["integer", "decimal", "date", "string", "boolean"]
    package = {"title": "T", "resources": [{"name": "d", "path": "d.csv", "scheme": "file", "format": "csv", "dialect": {"delimiter": "|"}, "schema": {"fields": [{"name": "y", "type": "year"}, {"name": "b", "type": "boolean", "trueValues": ["ja"], "falseValues": ["nein"]}, {"name": "s", "type": "string", "constraints": {"minLength": 2, "required": True}}], "missingValues": ["-"], "primaryKey": "y"}}]}
    group = TableGroup.of(describe.from_datapackage(package))
    columns = group.tables[0].schema.columns
    assert [c.inherit("datatype").base for c in columns] == ["gYear", "boolean", "string"]
    assert columns[1].inherit("datatype").format == "ja|nein" and columns[2].inherit("required") and columns[0].inherit("null") == ["-"]
    assert group.tables[0].effective_dialect.delimiter == "|"
    text = describe.to_markdown(group)
    assert "## " in text and "`gYear`" in text and "primary key" in text


def test_description_round_trip(tmp_path):
    group = group_of(tmp_path, COUNTRIES)
    group.to_file(tmp_path / "again.json")
    assert TableGroup.from_file(tmp_path / "again.json").asdict() == group.asdict()
    with pytest.raises(ValueError):
        TableGroup.of({"@context": "http://x.org", "url": "a.csv"})
    with pytest.raises(ValueError):
        TableGroup.of({"url": "a.csv", "tableSchema": {"columns": [{"name": "a"}, {"name": "a"}]}})
    t = NaturalLanguage.of({"en": ["a", "b"], "de": "c"})
    assert (t.first(), t.first("de")) == ("a", "c")


def test_inheritance():
    t = TableGroup.of({"url": "a.csv", "null": "-", "datatype": "integer", "default": "9", "tableSchema": {"columns": [{"name": "a"}, {"name": "b", "datatype": "string", "null": [""]}]}}).tables[0]
    a, b = t.schema.columns
    assert (a.inherit("null"), a.inherit("datatype").base, a.inherit("default")) == (["-"], "integer", "")
    assert (b.inherit("null"), b.inherit("datatype").base) == (["-"], "string")


def test_templates(spark):
    values = {"a": "x y", "b": "ü/", "c": "1"}
    for template in ("http://e.org/{a}", "{+b}", "#{a}{?b,c}", "{/a,c}", "{;a}", "{.c}", "x{&none}y{a}", "{#b,c}"):
        made = spark.createDataFrame([tuple(values.values())], list(values)).select(compile_template(template, {k: F.col(k) for k in values})).first()[0]
        assert made == expand(template, values), template


def test_names():
    assert [normal_name(x) for x in ("a-name", "1x", " ä b ")] == ["a_name", "_1x", "ä_b"]
    assert slug("Ähm, A1") == "ahma1"


@pytest.mark.filterwarnings("ignore")
def test_command_line(spark, tmp_path, capsys):
    countries(tmp_path, "1,AD;AF,AD\n")
    where = str(tmp_path / "metadata.json")
    assert main(["validate", where], spark) == 0
    assert main(["to-json", where, "--minimal"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0] == {"code": "AD", "name": "Andorra"}
    assert main(["to-markdown", where], spark) == 0
    assert main(["describe", str(tmp_path / "countries.csv")], spark) == 0
    countries(tmp_path, "1,XX,AD\n")
    assert main(["validate", where], spark) == 1
    assert main(["validate", str(tmp_path / "none.json")], spark) in (1, 2)


def test_streams(spark, tmp_path):
    from tabweave.streaming import scan_stream

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.csv", "1,x\nz,y\n")
    t = TableGroup.of({"url": "a.csv", "tableSchema": {"columns": [{"name": "n", "datatype": "integer"}, {"name": "t"}]}}).tables[0]
    stream = spark.readStream.schema("n string, t string").csv(str(tmp_path / "in"))
    q = scan_stream(t, stream).good.writeStream.format("memory").queryName("tw_stream").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [(int(r.n), r.t) for r in spark.table("tw_stream").collect()] == [(1, "x")]


def test_groups(spark, tmp_path):
    group = countries(tmp_path, "1,AF;AD,AD\n2,,\n")
    moved = groups.copy_group(group, tmp_path / "copy")
    frames = {u: s.good for u, s in groups.read_group(spark, moved).items()}
    assert groups.write_group(moved, frames, tmp_path / "again" / "metadata.json") == {"countries.csv": 2, "slices.csv": 2}
    again = groups.read_group(spark, TableGroup.from_file(tmp_path / "again" / "metadata.json"))
    for url, s in again.items():
        assert s.good.drop("sourcenum").orderBy("rownum").collect() == frames[url].drop("sourcenum").orderBy("rownum").collect()
