"""Row numbers over files, exact writers, whole documents, nested objects."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tabweave.model import CONTEXT, TableGroup
from tabweave.operators import groups, json_export, keys
from tabweave.operators.scan import scan
from tabweave.sources import dsv, split
from tabweave.sources.dialect import Dialect
from tabweave.staging import stage


def table_of(**schema):
    columns = [{"name": "id", "datatype": "integer"}, {"name": "note"}]
    return TableGroup.of({"url": "t.csv", "tableSchema": {"columns": columns, **schema}}).tables[0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("third", ["3,z\n", '3,"z\nz"\n'])
def test_rows_are_numbered_over_files_in_order(spark, tmp_path, third):
    for name, body in (("b.csv", "1,x\n2,y\n"), ("a.csv", ""), ("c.csv", "1,x\n" + third)):
        (tmp_path / name).write_text("id,note\n" + body)
    (tmp_path / "none.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("b.csv", "none.csv", "a.csv", "c.csv")]
    rows = scan(spark, table_of(), paths).good.orderBy("rownum").collect()
    assert [(r.rownum, r.sourcenum, r.id) for r in rows] == [(1, 2, 1), (2, 3, 2), (3, 2, 1), (4, 3 + third.count("\n") - 1, 3)]
    by_name = scan(spark, table_of(), str(tmp_path)).good.orderBy("rownum").collect()
    assert [r.rownum for r in by_name] == [1, 2, 3, 4] and [r.id for r in by_name] == [1, 2, 1, 3]
    found = keys.check_primary_key(table_of(primaryKey="id"), scan(spark, table_of(), paths).good).collect()
    assert [(r.sourcenum, r.message) for r in found] == [(2, 'duplicate key ["1"]')]


def test_files_of_other_encodings_are_numbered_too(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_bytes("id,note\n1,ä\n2,ö\n".encode("latin-1"))
    d = Dialect(encoding="latin-1")
    rows = dsv.table_rows(dsv.read_cells(spark, [str(tmp_path / n) for n in ("b.csv", "a.csv")], d), True).orderBy("rownum").collect()
    assert [(r.rownum, r.url[-5:], r.cells[1]) for r in rows] == [(1, "b.csv", "ä"), (2, "b.csv", "ö"), (3, "a.csv", "ä"), (4, "a.csv", "ö")]


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "iso8859-15", "koi8-r", "utf-16", "utf-16-le", "shift_jis", "utf-32"])
def test_encodings_from_any_store(spark, tmp_path, encoding, monkeypatch):
    word = {"koi8-r": "мир", "shift_jis": "日本", "latin-1": "naïve"}.get(encoding, "œuf €" if encoding != "utf-16-le" else "été")
    text = "id,note\n" + "".join(f'{i},"{word}\n{i}"\n' for i in range(40))
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode(encoding))
    monkeypatch.setattr(dsv, "open_text", lambda *a: pytest.fail("a local path was opened"))
    d = Dialect(encoding=encoding, comment_prefix=None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = dsv.table_rows(dsv.read_cells(spark, path.as_uri(), d), True)
        assert split.splittable(d) == (encoding in ("latin-1", "cp1252", "iso8859-15", "koi8-r"))
        assert rows.rdd.getNumPartitions() > 1 or not split.splittable(d)
        assert [(r.rownum, r.sourcenum, r.cells) for r in rows.orderBy("rownum").collect()] == [(i + 1, 2 * i + 3, [str(i), f"{word}\n{i}"]) for i in range(40)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bytes_that_are_no_characters_are_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a\x81b\n")
    with pytest.raises(Exception, match="no character of cp1252"):
        dsv.read_cells(spark, str(tmp_path / "t.csv"), Dialect(encoding="cp1252")).collect()


def test_rows_with_equal_numbers_count_once(spark):
    rows = [(1, 1), (1, 1), (1, 1), (2, 5), (2, 6), (None, 7), (None, 7), (4, 1)]
    df = spark.createDataFrame(rows, "id long, rownum long").withColumn("sourcenum", F.col("rownum"))
    found = sorted((r.sourcenum, r.message) for r in keys.check_primary_key(table_of(primaryKey="id"), df, ties=True).collect())
    assert found == [(1, 'duplicate key ["1"]')] * 2 + [(6, 'duplicate key ["2"]'), (7, "duplicate key [null]")]


def test_plain_files_are_read_without_python(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'\xef\xbb\xbf"id",note\r\n1,"a ""b"", c"\r\n\r\n2,\r\n,"\r\n'.replace(b',"\r\n', b',""\r\n'))
    rows = dsv.read_cells(spark, str(path))
    assert "MapInArrow" not in plan_of(rows)
    assert [(r.sourcenum, r.cells) for r in rows.orderBy("rownum").collect()] == [(1, ["id", "note"]), (2, ["1", 'a "b", c']), (3, []), (4, ["2", ""]), (5, ["", ""])]
    for odd in ('1,"a\nb"\n', "#c\n", 'a"b"\n', "a\rb\n", '"a",﻿"b"\n', '﻿1\n﻿2\n'):
        path.write_text(odd)
        read = dsv.read_cells(spark, str(path))
        with dsv.open_text(str(path), "utf-8-sig") as stream:
            want = [(n, c, x) for n, c, x in dsv.rows_of(stream, Dialect())]
        assert [(r.sourcenum, r.is_comment, r.cells) for r in read.orderBy("sourcenum").collect()] == want, odd
        assert ("MapInArrow" in plan_of(read)) == ("﻿" not in odd or odd.count("﻿") > 1 or '"' in odd)


def test_a_quick_look_does_not_decide(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split, "FIRST_LINES", 2)
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" * 50 + '"x\ny",1\n')
    rows = dsv.read_cells(spark, str(path)).orderBy("rownum").collect()
    assert len(rows) == 51 and rows[-1].cells == ["x\ny", "1"] and rows[-1].sourcenum == 52


def test_random_lines_are_read_as_by_python(spark, tmp_path):
    r = random.Random(5)
    for k in range(6):
        text = "".join(r.choice(['"', ",", "a", "b", "\n", '""', '","', "\r\n", " "]) for _ in range(120))
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode())
        try:
            with dsv.open_text(str(path), "utf-8-sig") as stream:
                want = [x for _, _, x in dsv.rows_of(stream, Dialect())]
        except Exception:
            with pytest.raises(Exception):
                dsv.read_cells(spark, str(path)).collect()
            continue
        assert [x.cells for x in dsv.read_cells(spark, str(path)).orderBy("rownum").collect()] == want, text


ODD = ["  ", "\t", " a ", "b\r", "c\r\nd", "\n", '"', '""', "\\", "\\n", 'x,"y"', "", ",", "é ", "﻿z", "'", ";"]


@pytest.mark.parametrize("d", [Dialect(comment_prefix=None), Dialect(comment_prefix=None, double_quote=False, line_terminators=("\n",)), Dialect(comment_prefix=None, quote_char="'", delimiter=";"), Dialect(comment_prefix=None, skip_initial_space=True)])
def test_what_is_written_comes_back(spark, tmp_path, d):
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in ODD for y in ODD[::3])]
    df = spark.createDataFrame(rows, "k int, x string, y string").repartition(3)
    assert dsv.write_dir(df, str(tmp_path / "folder"), d) == len(rows) == dsv.write_file(df, str(tmp_path / "file.csv"), d, order=["k"])
    want = [[str(k), x, y] for k, x, y in rows]
    for name in ("folder", "file.csv"):
        found = [r.cells for r in dsv.table_rows(dsv.read_cells(spark, str(tmp_path / name), d), True).orderBy("rownum").collect()]
        assert sorted(found) == sorted(want)
    assert found == want  # one file has the order asked for


def test_what_cannot_be_read_back_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("#x", "a\nb")], "a string, b string")
    with pytest.raises(Exception, match="read as a comment"):
        dsv.write_dir(df, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="header"):
        dsv.write_dir(df.withColumnRenamed("a", "#a"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="no quotes"):
        dsv.write_file(df.select("b"), str(tmp_path / "c"), Dialect(quote_char=None))
    with pytest.raises(ValueError, match="UTF-8"):
        dsv.write_dir(df, str(tmp_path / "d"), Dialect(encoding="latin-1"))


def test_empty_tables_keep_their_header(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b string")
    assert dsv.write_dir(none, str(tmp_path / "folder")) == 0 == dsv.write_file(none, str(tmp_path / "file.csv"))
    for name in ("folder", "file.csv"):
        assert [r.cells for r in dsv.read_cells(spark, str(tmp_path / name)).collect()] == [["a", "b"]]


def test_a_group_is_written_by_tasks(spark, tmp_path, monkeypatch):
    group = TableGroup.of({"@context": CONTEXT, "tables": [{"url": "t.csv", "tableSchema": {"columns": [{"name": "id", "datatype": "integer"}, {"name": "note"}]}}]})
    df = spark.createDataFrame([(i, f" {i}\t") for i in range(50)], "id int, note string").withColumn("rownum", F.col("id") + 1).repartition(4)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a: pytest.fail("rows came to the driver"))
    for folders in (False, True):
        where = tmp_path / str(folders) / "metadata.json"
        assert groups.write_group(group, {"t.csv": df}, where, folders=folders) == {"t.csv": 50}
        found = scan(spark, TableGroup.from_file(where).tables[0], str(where.parent / "t.csv")).good.orderBy("rownum").collect()
        assert [(r.rownum, int(r.id), r.note) for r in found] == [(i + 1, i, f" {i}\t") for i in range(50)]


@pytest.mark.parametrize("minimal", [False, True])
def test_documents_by_tasks_and_by_the_driver_are_equal(spark, tmp_path, minimal):
    for name, body in (("a.csv", "id,note\n1,x\n2,é\n"), ("b.csv", "id,note\n"), ("c.csv", 'id,note\n3,"q ""q"""\n')):
        (tmp_path / name).write_text(body)
    columns = {"columns": [{"name": "id", "datatype": "integer"}, {"name": "note"}]}
    described = {"@context": CONTEXT, "dc:title": "all", "tables": [{"url": n, "tableSchema": columns, "dc:title": n} for n in ("a.csv", "b.csv", "c.csv")]}
    (tmp_path / "metadata.json").write_text(json.dumps(described))
    group = TableGroup.from_file(tmp_path / "metadata.json")
    json_export.write_json(spark, group, str(tmp_path / "out.json"), minimal)
    assert json.loads((tmp_path / "out.json").read_text()) == json_export.to_json(spark, group, minimal)


def framed(ids, links):
    """Brute force: objects as dicts, those that one link refers to inside it unless in a circle."""
    n = len(ids)
    into = {i: [(j, k) for j, k, to in links if to == ids[i]] for i in range(1, n)}
    parent = {i: found[0][0] for i, found in into.items() if len(found) == 1}

    def nested(i):
        seen = set()
        while i in parent:
            if i in seen:
                return False
            seen.add(i)
            i = parent[i]
        return True

    def made(i):
        out = {"@id": ids[i]}
        for j, k, to in links:
            if j == i:
                inner = next((x for x in range(1, n) if ids[x] == to and parent.get(x) == i and nested(x)), None)
                out[f"p{k}"] = made(inner) if inner is not None else to
        return out

    return [made(i) for i in range(n) if i == 0 or not (i in parent and nested(i))]


@pytest.mark.parametrize("n", [2, 5, 12])
def test_objects_of_any_number_are_nested(spark, n):
    r = random.Random(n)
    rows = []
    for _ in range(40):
        ids = [f"u:{i}" for i in range(n)]
        links = [(j, k, f"u:{r.randrange(n + 2)}") for k, j in enumerate(r.randrange(n) for _ in range(n + 1))]
        rows.append((ids, links))
    rows.append(([f"u:{i}" for i in range(n)], [(i, i, f"u:{i + 1}") for i in range(n)] + [(n - 1, n, "u:no")]))
    data = [(k, *ids, *[next((to for j, x, to in links if j == s and x == e), None) for s in range(n) for e in range(n + 1)]) for k, (ids, links) in enumerate(rows)]
    names = [f"i{i}" for i in range(n)] + [f"l{s}_{e}" for s in range(n) for e in range(n + 1)]
    df = spark.createDataFrame(data, "k int, " + ", ".join(f"{c} string" for c in names))
    subjects = [json_export.Subject(F.col(f"i{s}"), [json_export.Entry(f"p{e}", json_export._quoted(F.col(f"l{s}_{e}")), url=F.col(f"l{s}_{e}")) for e in range(n + 1)]) for s in range(n)]
    made = df.select("k", json_export._framed(subjects).alias("d"))
    began = time.time()
    found = {x.k: [json.loads(t) for t in x.d] for x in made.collect()}
    took = time.time() - began
    for k, (ids, links) in enumerate(rows):
        assert found[k] == framed(ids, links), (ids, links)
    assert took < 20


@pytest.mark.parametrize("bound", ["10MB", "-1"])
def test_references_to_small_and_large_parents(spark, bound):
    group = TableGroup.of({"tables": [{"url": "c.csv", "tableSchema": {"columns": [{"name": "a"}, {"name": "b"}, {"name": "l", "separator": " "}], "foreignKeys": [{"columnReference": ["a", "b"], "reference": {"resource": "p.csv", "columnReference": ["x", "y"]}}, {"columnReference": "l", "reference": {"resource": "p.csv", "columnReference": "x"}}]}}, {"url": "p.csv", "tableSchema": {"columns": [{"name": "x"}, {"name": "y"}]}}]})
    child, parent = group.tables
    rows = [("1", "1", ["1", "9"], 1), ("1", "9", [], 2), (None, "9", None, 3), ("7", "7", [None, "2"], 4), *[("8", "8", ["1"], 10 + i) for i in range(50)]]
    mine = spark.createDataFrame(rows, "a string, b string, l array<string>, sourcenum long")
    theirs = stage(spark, spark.createDataFrame([("1", "1"), ("2", "2"), ("1", "1"), (None, "9")], "x string, y string"), "parents")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        pairs, items = (keys.check_foreign_key(mine, child, key, theirs, parent) for key in child.schema.foreign_keys)
        assert sorted(r.sourcenum for r in pairs.collect()) == [2, 4, *range(10, 60)]
        assert sorted((r.sourcenum, r.message[-5:]) for r in items.collect()) == [(1, '["9"]')]
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert ("LeftAnti" in plan) == (bound == "10MB") and ("LeftSemi" in plan) == (bound == "-1")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
