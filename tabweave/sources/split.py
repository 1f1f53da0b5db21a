"""Exact reading of delimited files in parallel: the same rows as the data source ``dsv``.

A file is read as lines by Spark's text source, which splits it into blocks.  A first pass of
built-in expressions tells whether each line is a row by itself: quotes stand around whole cells
and close, no comment, no stray carriage return.  If so, expressions split the lines, too, and a
row's number is that of its line: what the blocks before it hold (one row a block, summed up on
the driver) and its place in its block.

Otherwise whether a line begins inside a quoted cell depends on all lines before it, so there
are two passes:

1. Each block tells, for either answer at its begin, the answer at its end, and how many rows it
   completes: one row a block, chained on the driver.
2. Each block, now that its begin is known, is parsed by Python's reader.  A row that crosses
   the end of a block comes out in parts, which are joined and parsed by themselves.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import Dialect

#: Rows that are handed to Spark at a time.
ROWS = 2_000
#: Lines of which one that is no row by itself decides how all are read.
FIRST_LINES = 500
#: Blocks with parts of rows that are named in a filter; of more, all blocks are looked through.
FEW_BLOCKS = 1_000
_BLOCKS = "url string, at long, lines long, end_out boolean, rows_out long, open_out boolean, broken_out boolean, end_in boolean, rows_in long, open_in boolean, broken_in boolean, closes boolean"
_CELLS = "url string, rownum long, sourcenum long, is_comment boolean, cells array<string>"
_PARTS = "url string, owner long, at long, rownum long, sourcenum long, part string"


def _upper_half(encoding: str) -> str | None:
    """The characters of the bytes from 0x80 on, U+FFFD for those that have none; None if the encoding
    does not have a byte for each character, with ASCII in its lower half."""
    lower = bytes(range(128))
    try:
        if lower.decode(encoding) != lower.decode("ascii"):
            return None
        upper = "".join(bytes([b]).decode(encoding, "replace") for b in range(128, 256))
        # What bytes make one by one they make together, unless the encoding joins them.
        together = bytes(range(128, 256)).decode(encoding, "replace")
    except (LookupError, UnicodeError):
        return None
    return upper if len(upper) == 128 and upper == together and upper.count("\ufffd") < 128 else None


def splittable(d: Dialect) -> bool:
    """UTF-8, and encodings of one byte a character: others have no line ends that a block could
    begin behind."""
    known = d.python_encoding == "utf-8-sig" or _upper_half(d.python_encoding)
    return bool(known) and not (d.comment_prefix and d.quote_char and d.quote_char in d.comment_prefix)


def _decoded(line: Column, encoding: str) -> Column:
    """The text of a line's bytes, which Spark hands on as they are."""
    if encoding == "utf-8-sig":
        return line
    upper, latin = _upper_half(encoding), "".join(chr(b) for b in range(128, 256))
    text = F.decode(line.cast("binary"), "ISO-8859-1")
    lost = "".join(a for a, b in zip(latin, upper, strict=True) if b == "\ufffd")
    if lost:
        text = F.when(F.translate(text, lost, "") == text, text).otherwise(F.raise_error(F.lit(f"a byte is no character of {encoding}")))
    return text if upper == latin else F.translate(text, latin, upper)


def _lines(spark: SparkSession, paths: list[str], d: Dialect) -> DataFrame:
    read = spark.read.text(paths, lineSep="\n")
    return read.select(_decoded(F.col("value"), d.python_encoding).alias("value"), F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("at"))


#: Stands for a delimiter outside of quotes while a line is split; a line that holds it is not plain.
_MARK = "\u0001"


def _native(d: Dialect) -> bool:
    """Dialects whose lines expressions can split."""
    quoted = d.quote_char is None or len(d.quote_char) == 1 and d.double_quote
    return quoted and d.trim == "false" and not d.skip_rows and not d.skip_initial_space


def _by(character: str) -> str:
    """A pattern that splits by one character; Java splits by a bare one without a regex."""
    return f"\\Q{character}\\E" if character in ".$|()[{^?*+\\" else character


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with a number that rises by one inside a block; the same whenever they are read."""
    return lines.select("value", "url", "at", F.monotonically_increasing_id().alias("line"))


def _bare(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def _between_quotes(d: Dialect, line: Column) -> Column:
    return F.split(line, _by(d.quote_char), -1)


def _strange(d: Dialect, line: Column) -> Column:
    """Is a line (without its end) not a row by itself, of cells that are quoted as a whole or not
    at all, or one that does not count?"""
    odd = line.contains("\r")
    if d.comment_prefix:
        odd = odd | line.startswith(d.comment_prefix) | (line.startswith((d.quote_char or "") + d.comment_prefix))
    if d.skip_blank_rows:
        empty = F.replace(line, F.lit(d.quote_char), F.lit("")) if d.quote_char else line
        odd = odd | (F.replace(empty, F.lit(d.delimiter), F.lit("")) == "")
    if not d.quote_char:
        return odd
    parts = _between_quotes(d, line)

    def fits(part: Column, i: Column) -> Column:
        first, last = i == 0, i == F.size(parts) - 1
        return (i % 2 == 1) | (part == "") | ((first | part.startswith(d.delimiter)) & (last | part.endswith(d.delimiter)))

    whole = (F.size(parts) % 2 == 1) & F.forall(F.transform(parts, fits), lambda x: x) & ~line.contains(_MARK)
    return odd | (line.contains(d.quote_char) & ~whole)


def _cells(d: Dialect, line: Column) -> Column:
    """The cells of a line that is not strange."""
    simple = F.split(line, _by(d.delimiter), -1)
    if d.quote_char:
        outside = F.transform(_between_quotes(d, line), lambda part, i: F.when(i % 2 == 0, F.translate(part, d.delimiter, _MARK)).otherwise(part))
        q, bare = d.quote_char, lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
        quoted = F.transform(F.split(F.array_join(outside, q), _MARK, -1), lambda c: F.when(c.startswith(q), F.replace(bare(c), F.lit(q + q), F.lit(q))).otherwise(c))
        simple = F.when(line.contains(q), quoted).otherwise(simple)
    simple = F.when(line == "", F.array().cast("array<string>")).otherwise(simple)
    return F.slice(simple, d.skip_columns + 1, F.greatest(F.size(simple) - d.skip_columns, F.lit(0))) if d.skip_columns else simple


def _plain_blocks(lines: DataFrame, d: Dialect) -> list:
    """(url, at, lines, base, odd) of each block: its first line's number, and how many lines are no
    rows by themselves; a byte order mark may stand before the first line of a file only."""
    marked = F.col("value").startswith("\ufeff") & (F.col("at") == 0)
    line = _bare(F.when(marked, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    told = _numbered_lines(lines).select("url", "at", "line", marked.alias("mark"), _strange(d, line).alias("odd"))
    counts = told.groupBy("url", "at").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("base"), F.count_if("odd").alias("odd"), F.count_if("mark").alias("marks"), F.min_by("mark", "line").alias("begin"))
    return counts.select("url", "at", "lines", "base", (F.col("odd") + F.col("marks") - F.col("begin").cast("int")).alias("odd")).collect()


def _read_plain(spark: SparkSession, lines: DataFrame, d: Dialect, blocks: list) -> DataFrame:
    """Rows of lines that are rows by themselves; both numbers are those of the lines."""
    table, url, before = [], None, 0
    for b in sorted(blocks, key=lambda b: (b.url, b.at)):
        url, before = b.url, before if b.url == url else 0
        table.append((b.url, b.at, b.base, b.lines, before))
        before += b.lines
    where = spark.createDataFrame(table, "url string, at long, base long, lines long, before long")
    placed = _numbered_lines(lines).join(F.broadcast(where), ["url", "at"])
    place = F.col("line") - F.col("base")
    # Spark numbers lines anew for each pass; files that change meanwhile must not go unnoticed.
    number = F.when((place >= 0) & (place < F.col("lines")), place + F.col("before") + 1).otherwise(F.raise_error(F.lit("a file changed while it was read")))
    begins = (F.col("at") == 0) & (place == 0) & F.col("value").startswith("\ufeff")
    line = _bare(F.when(begins, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    rows = placed.select("url", number.alias("rownum"), line.alias("line"))
    return rows.select("url", "rownum", F.col("rownum").alias("sourcenum"), F.lit(False).alias("is_comment"), _cells(d, F.col("line")).alias("cells"))


def _physical(text: str) -> Iterable[str]:
    """Lines as a file opened without translation gives them: a lone carriage return ends one."""
    return (f"{text}\n",) if "\r" not in text[:-1] else io.StringIO(f"{text}\n", newline="")


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(url, at, lines) of each run of lines of one block, as they arrive."""
    for b in batches:
        urls, at = b.column(1), b.column(2).to_numpy()
        if not b.num_rows:
            continue
        other = (at[1:] != at[:-1]) | pc.not_equal(urls[1:], urls[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
        for low, high in zip(edges, edges[1:]):
            yield urls[low].as_py(), int(at[low]), b.column(0).slice(low, high - low)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[pa.Array]]]:
    """(url, at, runs of lines) of each block of a partition, one after the other."""
    source = _chunks(batches)
    held = next(source, None)
    while held is not None:
        key = held[:2]

        def runs(key=key):
            nonlocal held
            first = key[1] == 0
            while held is not None and held[:2] == key:
                lines = held[2]
                if first and len(lines) and (lines[0].as_py() or "").startswith("\ufeff"):
                    lines = pa.concat_arrays([pa.array([lines[0].as_py()[1:]], lines.type), lines.slice(1)])
                yield lines
                held, first = next(source, None), False

        block = runs()
        yield *key, block
        for _ in block:  # what its reader has left
            pass


class Quoting:
    """Which lines end inside a quoted cell?

    If quotes stand around whole cells only, counting them tells, for many lines at a time;
    else Python's own reader answers line by line."""

    def __init__(self, d: Dialect):
        self.quote, self.options, self.delimiter = d.quote_char, d.csv_options(), d.delimiter
        self.counts = not d.quote_char or d.double_quote and not d.skip_initial_space and d.quote_char.isascii() and d.delimiter.isascii()

    def inside(self, line: str, begins_inside: bool) -> bool:
        if not self.quote or self.quote not in line and not (begins_inside and self.options["escapechar"]):
            return begins_inside
        try:
            list(csv.reader([self.quote + line if begins_inside else line], **self.options))
        except csv.Error as e:
            return "unexpected end" in str(e)
        return False

    def counted(self, lines: pa.Array, begins_inside: bool) -> np.ndarray | None:
        """For each line, does it end inside?  None if counting cannot tell."""
        if not self.counts or pc.any(pc.match_substring_regex(lines, r"\r(?s:.)")).as_py():
            return None
        if not self.quote:
            return np.zeros(len(lines), bool)
        ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        at = np.flatnonzero(data == ord(self.quote))
        if len(at):
            own = (ord(self.quote), ord(self.delimiter))
            opens = (np.arange(len(at)) + begins_inside) % 2 == 0
            line = np.searchsorted(ends, at, "right") - 1
            before, behind = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
            fine = np.where(opens, (at == ends[line]) | np.isin(before, own), (at + 1 == ends[line + 1]) | np.isin(behind, (*own, 13)))
            if not fine.all():
                return None
        return (np.searchsorted(at, ends[1:]) + begins_inside) % 2 == 1

    def ends(self, lines: pa.Array, begins_inside: bool) -> tuple[list[str], np.ndarray]:
        """The physical lines, and for each if it ends inside a cell."""
        if (known := self.counted(lines, begins_inside)) is not None:
            return [f"{x}\n" for x in lines.to_pylist()], known
        found = [x for text in lines.to_pylist() for x in _physical(text)]
        states, state = [], begins_inside
        for x in found:
            state = self.inside(x, state)
            states.append(state)
        return found, np.array(states, bool)


@dataclass
class _Guess:
    """What a block holds, if it begins inside a quoted cell or not: is its end inside one, has a row
    closed, rows completed (but the one that was open at its begin), and is a row open whose first line
    counts.  ``broken``: counting quotes cannot tell."""

    inside: bool
    begun: bool
    closes: bool = False
    rows: int = 0
    open: bool = False
    broken: bool = False

    def take(self, counts: np.ndarray, states: np.ndarray, beyond: np.ndarray) -> None:
        """Lines of which each, as the first of a row, counts or not, ends inside or not, and stands
        behind the skipped rows or not."""
        ends = np.flatnonzero(~states)
        if len(ends):
            heads = np.append(0, ends[:-1] + 1)
            full = counts[heads]
            if self.begun:
                full[0] = self.open
            self.rows += int((full & beyond[ends]).sum())
            self.closes, self.begun, self.open = True, bool(ends[-1] + 1 < len(states)), False
            if self.begun:
                self.open = bool(counts[ends[-1] + 1])
        elif not self.begun and len(states):
            self.begun, self.open = True, bool(counts[0])
        self.inside = bool(states[-1]) if len(states) else self.inside


def _counted(line: str, d: Dialect, empty: re.Pattern) -> bool:
    """Is the row that begins with this line one that counts?"""
    start = line.lstrip(" ") if d.skip_initial_space else line
    if d.comment_prefix and (start.startswith(d.comment_prefix) or d.quote_char and start.startswith(d.quote_char + d.comment_prefix)):
        return False
    return not (d.skip_blank_rows and empty.match(line))


def _count_each(lines: pa.Array, d: Dialect, empty: re.Pattern) -> np.ndarray:
    """:func:`_counted` for many lines."""
    if d.skip_blank_rows or d.skip_initial_space:
        return np.array([_counted(x, d, empty) for x in lines.to_pylist()], bool)
    counts = np.ones(len(lines), bool)
    for prefix in (d.comment_prefix, (d.quote_char or "") + d.comment_prefix) if d.comment_prefix else ():
        counts &= ~pc.starts_with(lines, prefix).to_numpy(zero_copy_only=False)
    return counts


def _empty_row(d: Dialect) -> re.Pattern:
    """A line whose cells are all empty."""
    cell = f"(?:{re.escape(d.quote_char * 2)})?" if d.quote_char else ""
    blank = " *" if d.skip_initial_space else ""
    return re.compile(rf"{blank}{cell}(?:{re.escape(d.delimiter)}{blank}{cell})*[\r\n]*\Z")


def _made(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _cells_batch(url: str, rownum: int, rows: tuple) -> pa.RecordBatch:
    """Rows of a file as they come from ``rows_of``, after ``rownum`` that are no comments."""
    numbers, comments, cells = zip(*rows)
    comments = np.array(comments, bool)
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(c) for c in cells])), pa.int32()), pa.array([c for x in cells for c in x], pa.string()))
    columns = [pa.repeat(pa.scalar(url, pa.string()), len(cells)), pa.array(rownum + np.cumsum(~comments)), pa.array(numbers, pa.int64()), pa.array(comments), listed]
    return pa.RecordBatch.from_arrays(columns, names=["url", "rownum", "sourcenum", "is_comment", "cells"])


def _summaries(d: Dialect, by_line: bool):
    """One row a block.  Unless ``by_line``, a guess under which counting quotes cannot tell is given up:
    mostly it is the wrong one, which nobody asks for."""

    def run(batches):
        quoting, empty, out = Quoting(d), _empty_row(d), []
        for url, at, runs in _blocks(batches):
            n, guesses = 0, (_Guess(False, False), _Guess(True, True))
            for lines in runs:
                physical = lines if not by_line else pa.array([x for text in lines.to_pylist() for x in _physical(text)], pa.string())
                counts = _count_each(physical, d, empty)
                beyond = (n + 1 + np.arange(len(physical)) > d.skip_rows) | (at > 0)
                n += len(physical)
                for g in guesses:
                    states = quoting.ends(lines, g.inside)[1] if by_line else None if g.broken else quoting.counted(lines, g.inside)
                    if states is None:
                        g.broken = True
                    else:
                        g.take(counts, states, beyond)
            ends = [(g.inside, g.rows, g.begun and g.open, g.broken) for g in guesses]
            out.append((url, at, n, *ends[0], *ends[1], guesses[1].closes))
        yield _made(out, _BLOCKS)

    return run


@dataclass(frozen=True)
class _Begin:
    """Where a block begins: inside a cell?  Lines and rows before it (that of the row that is
    open at its begin included, if it closes here), and the block in which that row began."""

    inside: bool
    lines: int
    rows: int
    owner: int
    #: Is the end inside a cell, and how many rows are before that open row?
    open_end: bool
    rows_end: int


def _chain(blocks: list) -> dict[tuple[str, int], _Begin] | None:
    """Where each block begins; None if that needs a guess that was given up."""
    plan: dict[tuple[str, int], _Begin] = {}
    url, inside, lines, rows, owner, counts = None, False, 0, 0, 0, False
    for b in sorted(blocks, key=lambda b: (b.url, b.at)):
        if b.url != url:
            url, inside, lines, rows, owner, counts = b.url, False, 0, 0, b.at, False
        end, made, opened, broken = (b.end_in, b.rows_in, b.open_in, b.broken_in) if inside else (b.end_out, b.rows_out, b.open_out, b.broken_out)
        if broken:
            return None
        fresh = b.closes or not inside  # no row that began earlier is open at the end
        rows += inside and b.closes and counts
        plan[(b.url, b.at)] = _Begin(inside, lines, rows, owner, end, rows + made)
        owner, counts = (b.at, opened) if fresh else (owner, counts)
        inside, lines, rows = end, lines + b.lines, rows + made
    return plan


def _parse(d: Dialect, shared):
    """The rows that begin and end in one block."""
    from .dsv import rows_of

    def run(batches):
        plan, quoting = shared.value, Quoting(d)
        for url, at, runs in _blocks(batches):
            inside, before, rownum = plan[(url, at)][:3]
            earlier, held = inside, []
            for run_of in runs:
                lines, states = quoting.ends(run_of, inside)
                inside = bool(states[-1]) if len(states) else inside
                ends = np.flatnonzero(~states)
                if earlier and len(ends):  # the row that began in another block ends
                    lines, ends, earlier, before = lines[ends[0] + 1 :], ends[1:] - ends[0] - 1, False, before + int(ends[0]) + 1
                elif earlier:
                    before += len(lines)
                    continue
                cut = int(ends[-1]) + 1 if len(ends) else 0
                whole, held = (held + lines[:cut], lines[cut:]) if cut else ([], held + lines)
                for some in batched(rows_of(whole, d, before), ROWS):
                    yield _cells_batch(url, rownum, some)
                    rownum += sum(not comment for _, comment, _ in some)
                before += len(whole)

    return run


def _cut_parts(d: Dialect, shared):
    """What a block holds of rows that began earlier or do not end in it."""

    def run(batches):
        plan, quoting, out = shared.value, Quoting(d), []
        for url, at, runs in _blocks(batches):
            if (url, at) not in plan:
                continue
            inside, n, _, owner, open_end, rows_end = plan[(url, at)]
            earlier, head, held = inside, [], []
            for run_of in runs:
                lines, states = quoting.ends(run_of, inside)
                inside = bool(states[-1]) if len(states) else inside
                ends = np.flatnonzero(~states)
                if earlier:
                    cut = int(ends[0]) + 1 if len(ends) else len(lines)
                    head, lines, ends, n, earlier = head + lines[:cut], lines[cut:], ends[1:] - cut, n + cut, not len(ends)
                if len(ends):
                    n, held, lines = n + len(held) + int(ends[-1]) + 1, [], lines[ends[-1] + 1 :]
                held += lines
            if head:
                out.append((url, owner, at, None, None, "".join(head)))
            if held and open_end:
                out.append((url, at, at, rows_end, n, "".join(held)))
        yield _made(out, _PARTS)

    return run


def _parse_joined(d: Dialect):
    from .dsv import rows_of

    def run(batches):
        for b in batches:
            out = []
            for url, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rownum, before = parts[0]["rownum"], parts[0]["sourcenum"]
                for number, comment, cells in rows_of(io.StringIO("".join(p["part"] for p in parts), newline=""), d, before):
                    rownum += not comment
                    out.append((url, rownum, number, comment, cells))
            yield _made(out, _CELLS)

    return run


def _read_blocks(spark: SparkSession, lines: DataFrame, d: Dialect) -> tuple[DataFrame, dict[str, int]] | None:
    blocks = lines.mapInArrow(_summaries(d, False), _BLOCKS).collect()
    plan = _chain(blocks)
    if plan is None:
        blocks = lines.mapInArrow(_summaries(d, True), _BLOCKS).collect()
        plan = _chain(blocks)
    if d.skip_rows and any(b.at == 0 and b.lines < d.skip_rows and sum(x.url == b.url for x in blocks) > 1 for b in blocks):
        return None
    fields = lambda x: (x.inside, x.lines, x.rows, x.owner, x.open_end, x.rows_end)
    shared = spark.sparkContext.broadcast({k: fields(x) for k, x in plan.items()})
    rows = lines.mapInArrow(_parse(d, shared), _CELLS)
    totals: dict[str, int] = {}
    for (url, _), x in plan.items():
        totals[url] = max(totals.get(url, 0), x.rows_end)
    crossed = {k: fields(x) for k, x in plan.items() if x.inside or x.open_end}
    if not crossed:
        return rows, totals
    some = lines
    if len(crossed) <= FEW_BLOCKS:
        some = lines.filter(F.concat_ws("@", "at", "url").isin([f"{at}@{url}" for url, at in crossed]))
    parts = some.mapInArrow(_cut_parts(d, spark.sparkContext.broadcast(crossed)), _PARTS)
    joined = parts.groupBy("url", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "rownum", "sourcenum", "part"))).alias("parts"))
    return rows.union(joined.select("url", "parts").mapInArrow(_parse_joined(d), _CELLS)), totals


def read_split(spark: SparkSession, paths: list[str], d: Dialect) -> tuple[DataFrame, dict[str, int]] | None:
    """(cells, rows of each file that has any) of files, or folders of them, that Spark reads; None if
    a file's skipped rows do not all stand in its first block.  Rows are numbered in each file."""
    lines = _lines(spark, paths, d)
    # A look at the first lines saves the pass over all of them where it cannot help.
    if _native(d) and lines.select("value").limit(FIRST_LINES).filter(_strange(d, _bare(F.regexp_replace("value", "^\ufeff", "")))).isEmpty():
        blocks = _plain_blocks(lines, d)
        if not any(b.odd for b in blocks):
            totals: dict[str, int] = {}
            for b in blocks:
                totals[b.url] = totals.get(b.url, 0) + b.lines
            return _read_plain(spark, lines, d, blocks), totals
    return _read_blocks(spark, lines, d)
