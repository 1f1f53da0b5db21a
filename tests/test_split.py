"""The parallel reader gives the same rows as Python's reader over the whole file."""

import csv
import random

import pytest

from tabweave.sources import dsv, split
from tabweave.sources.dialect import Dialect


def text(seed, d, n=400):
    r = random.Random(seed)
    words = ["a", "", "été", 'say "x"', "two\nlines", "cr\r\nlf", "x,y", "#no", " pad ", "long " * 9, '"', "''", "\n\n", "back\\slash"]
    out = []
    for i in range(n):
        if d.comment_prefix and r.random() < 0.1:
            out.append(f"{d.comment_prefix} note {i}," + ("" if d.skip_initial_space else ' "quoted'))
        elif r.random() < 0.07:
            out.append(r.choice(["", ",,", '"",""']))
        else:
            cells = [r.choice(words) for _ in range(r.randint(1, 5))]
            if d.quote_char is None:
                cells = [c.replace("\n", " ").replace("\r", "").replace(",", ";") for c in cells]
            out.append(dsv._plain_line(cells, d) if d.quote_char else ",".join(cells))
    return r.choice(["\r\n", "\n"]).join(out) + r.choice(["", "\n"])


DIALECTS = [
    Dialect(),
    Dialect(comment_prefix=None, skip_blank_rows=True),
    Dialect(skip_rows=3, trim="true", skip_columns=1),
    Dialect(double_quote=False, comment_prefix="//"),
    Dialect(quote_char=None),
    Dialect(skip_initial_space=True, skip_blank_rows=True),
    Dialect(delimiter=";", quote_char="'"),
]


@pytest.mark.parametrize("k", range(len(DIALECTS)))
def test_blocks_of_any_size(spark, tmp_path, k):
    d = DIALECTS[k]
    (tmp_path / "one.csv").write_bytes(("﻿" * (k % 2) + text(k, d)).encode())
    (tmp_path / "two.csv").write_bytes(text(k + 50, d).encode())
    for size in (90, 700, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            for name in ("one.csv", "two.csv"):
                path = str(tmp_path / name)
                with dsv.open_text(path, d.python_encoding) as stream:
                    want = list(dsv._numbered(path, stream, d))
                read = split.read_split(spark, [path], d)
                if read is None:
                    assert d.skip_rows and size == 90
                    continue
                rows, totals = read
                assert sum(totals.values()) == sum(not w[3] for w in want)
                found = [(path, r.rownum, r.sourcenum, r.is_comment, r.cells) for r in rows.orderBy("sourcenum").collect()]
                assert found == want, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_are_numbered_one_by_one(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a\n"x\n{i}"\n')
    rows = dsv.read_cells(spark, str(tmp_path))
    assert sorted((r.rownum, r.sourcenum, r.cells[0]) for r in rows.collect()) == [(1, 1, "a")] * 3 + [(2, 3, f"x\n{i}") for i in range(3)]
    assert dsv.first_cells(spark, str(tmp_path / "1.csv"), Dialect()) == ["a"]


def test_malformed_quoting_is_refused(spark, tmp_path):
    for i, bad in enumerate(['"x"y,1\n', 'a\n"open,2\n']):
        path = tmp_path / f"{i}.csv"
        path.write_text(bad)
        with pytest.raises(Exception, match="expected after|unexpected end"):
            dsv.read_cells(spark, str(path)).collect()
        with pytest.raises(csv.Error):
            list(dsv.rows_of(bad.splitlines(True), Dialect()))


def test_empty_file(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    assert dsv.read_cells(spark, str(tmp_path / "none.csv")).count() == 0
