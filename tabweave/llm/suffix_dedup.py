"""Removal of repeated 200-byte strings by a sparse suffix array.

A byte goes if a string of ``WINDOW`` bytes covers it that also starts anywhere else, in the
same text or another.  Sorting the suffixes of every byte would move each text 200 times;
here only a sparse set of suffixes is sorted, chosen so that nothing is missed:

1. Every window selects its leading token: the least fingerprint among the ``TOKEN``-byte
   strings inside it.  The choice depends on the window's bytes alone, so equal windows
   select equal tokens.  Consecutive windows that select the same position form a segment,
   about one for 85 bytes.
2. Segments are range-partitioned by sampled splitters of (token fingerprint, 128-bit
   fingerprint of all the segment's bytes), so a token shared by a third of all texts spreads
   over many partitions; each bucket sorts locally and compares neighbours, and the ends of
   buckets are compared across boundaries.  A token met once has no repeated window; equal
   segments are repeated as a whole.
3. What is left are segments at the ends of repeated passages.  Their bytes are fetched, with
   those of one segment of each kind of equal ones that has the same token.  They are
   range-partitioned by token, and in each bucket the suffixes at all their windows are sorted by
   a multikey quicksort of their bytes; neighbours that agree in ``WINDOW`` bytes are repeated.
   A token with very many such segments would not fit into a task.  There the same is done by
   counting, which no task has to do alone: for slices of ``SLICE`` windows (repeated as a
   whole, or without a repeat of the bytes that all its windows share), and for the single
   windows of the slices that this does not decide.
4. The repeated windows of a text become intervals, and its text is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, per_process, slices, small_batches, stage, text_of, unstage

WINDOW, TOKEN = 200, 48
#: Windows of a text that are worked on at a time; bounds memory for very long texts.
BLOCK = 1 << 16
#: A token with more segments to compare than this is split into slices of windows.
HOT_SEGMENTS = 256
SLICE = 8
#: Segments whose windows are sorted at a time.
SORT_ROWS = 4096

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M32, _M29 = np.uint64(32), np.uint64(29)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _M32)) * _MULTIPLIER
    return h ^ (h >> _M29)


class Roller:
    """Polynomial fingerprints modulo 2**64 of substrings, from prefix sums."""

    def __init__(self, base: int, seed: int, longest: int):
        inverse = pow(base, -1, 1 << 64)
        self.power, self.unpower = (self._powers(b, longest) for b in (base, inverse))
        self.value = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return _mix((sums[start + length] - sums[start]) * self.unpower[start])


def rollers() -> tuple[Roller, Roller]:
    """Built once for each worker process."""
    return per_process("rollers", lambda: tuple(Roller(b, k, BLOCK + 2 * WINDOW) for k, b in enumerate(_BASES)))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values: of a block's tail and the next one's head."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def segments(text: bytes):
    """Yield arrays (first window, number of windows, the token's place in the first window,
    token, two fingerprints of the whole) of a text's segments."""
    whole = np.frombuffer(text, np.uint8)
    (roll, second), n_windows, w = rollers(), len(text) - WINDOW + 1, WINDOW - TOKEN + 1
    for at in range(0, n_windows, BLOCK):
        data = whole[at : min(len(whole), at + BLOCK + WINDOW - 1)]
        sums = roll.sums(data)
        token = roll.spans(sums, np.arange(len(data) - TOKEN + 1), TOKEN)
        # The position in the low bits makes the last of equal minima the least.
        place = np.uint64((1 << 17) - 1) - np.arange(len(token), dtype=np.uint64)
        least = _sliding_min((token & ~np.uint64((1 << 17) - 1)) | place, w)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.append(first, len(least)))
        selected = ((1 << 17) - 1) - (least[first] & np.uint64((1 << 17) - 1)).astype(np.int64)
        yield first + at, count, selected - first, token[selected], roll.spans(sums, first, count + (WINDOW - 1)), second.spans(second.sums(data), first, count + (WINDOW - 1))


def _key_columns(key: Column, text: Column) -> dict[str, Column]:
    """The bytes of a text and the 128 bits that name it: rows named alike have one key, and equal texts."""
    parts = (key.isNull(), key.cast("long"), F.octet_length(text), text)
    return {"_tw_k": F.xxhash64(*parts), "_tw_c": F.xxhash64(F.lit(1), *parts), "_tw_data": text.cast("binary")}


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(*[c.alias(n[4:]) for n, c in _key_columns(F.col(key), text_of()).items()])


_SEGMENT = "k long, c long, first int, n short, at short, token long, whole long, whole2 long"
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]


def _segment_rows(batches):
    for b in (part for whole in batches for part in slices(whole, "data")):
        out = [[] for _ in _NAMES]
        for k, c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for first, count, place, *prints in segments(data) if len(data) >= WINDOW else ():
                own = (np.full(len(first), k, np.int64), np.full(len(first), c, np.int64), first.astype(np.int32), count.astype(np.int16), place.astype(np.int16))
                for x, y in zip(out, (*own, *(p.view(np.int64) for p in prints)), strict=True):
                    x.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=_NAMES)


def _compare_neighbours(batches):
    """In a bucket sorted by (token, whole, whole2): which rows share them with a neighbour?

    Keeps rows that share the token, and the bucket's first and last row, whose other
    neighbour is in another bucket.
    """
    pid, before = TaskContext.get().partitionId(), None

    def emit(rows: pa.RecordBatch, left, right, first: bool, last: bool):
        n = rows.num_rows
        token, whole, whole2 = (rows.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
        t, w = np.zeros(n, bool), np.zeros(n, bool)
        same_t = token[1:] == token[:-1]
        same_w = same_t & (whole[1:] == whole[:-1]) & (whole2[1:] == whole2[:-1])
        t[1:] |= same_t
        t[:-1] |= same_t
        w[1:] |= same_w
        w[:-1] |= same_w
        for other, i in ((left, 0), (right, n - 1)):
            if other is not None and other[0] == token[i]:
                t[i] = True
                w[i] |= other[1:] == (whole[i], whole2[i])
        edge = np.zeros(n, np.int8)
        edge[0] |= 1 * first
        edge[-1] |= 2 * last
        keep = pa.array(t | (edge > 0))
        made = pa.RecordBatch.from_arrays([*rows.columns, pa.array(t), pa.array(w), pa.array(edge), pa.array(np.full(n, pid, np.int32))], names=[*rows.schema.names, "met", "equal", "edge", "pid"])
        return made.filter(keep), (token[-1], whole[-1], whole2[-1])

    held, left, first = None, None, True
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            right = tuple(b.column(i)[0].as_py() for i in (5, 6, 7))
            made, left = emit(held, left, right, first, False)
            first = False
            yield made
        held = b
    if held is not None:
        yield emit(held, left, None, first, True)[0]


def repeated_segments(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """Segments whose token is met elsewhere; ``equal`` if the whole segment is."""
    # Staged, as the splitters are sampled from it before it is dealt out.
    found = stage(spark, keyed.select("k", "c", "data").mapInArrow(*lean(_segment_rows, _SEGMENT)), "segments")
    order = ["token", "whole", "whole2", "k", "first"]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    met = stage(spark, dealt.mapInArrow(*lean(_compare_neighbours, f"{_SEGMENT}, met boolean, equal boolean, edge byte, pid int")), "met")
    unstage(spark, found)
    # Across the boundaries of buckets: two rows a bucket.
    ends = met.filter("edge > 0").select("pid", "edge", "token", "whole", "whole2").orderBy("pid", "edge").collect()
    fixes: dict[tuple[int, int], list[bool]] = {}
    rows = sorted({(e.pid, bit, e.token, e.whole, e.whole2) for e in ends for bit in (1, 2) if e.edge & bit})
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] != b[0] and a[2] == b[2]:
            for r in (a, b):
                fix = fixes.setdefault(r[:2], [True, False])
                fix[1] |= a[3:] == b[3:]
    table = spark.createDataFrame([(p, bit, *fix) for (p, bit), fix in fixes.items()], "pid int, bit int, fix_met boolean, fix_equal boolean")
    fixed = (met["pid"] == table["pid"]) & (met["edge"].bitwiseAND(table["bit"]) > 0)
    now = [(met[x] | F.coalesce(f"fix_{x}", F.lit(False))).alias(x) for x in ("met", "equal")]
    edges = met.filter("edge > 0").join(F.broadcast(table), fixed, "left").select(*[met[c] for c in _NAMES], *now)
    edges = edges.groupBy(*_NAMES).agg(F.max("met").alias("met"), F.max("equal").alias("equal"))
    inner = met.filter("edge = 0").select(*_NAMES, "met", "equal")
    return inner.union(edges).filter("met").drop("met")


def _context_rows(batches):
    """The bytes of a text's left-over segments."""
    for b in batches:
        for part in slices(b, "data"):
            out = []
            for k, c, data, parts in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                for p in parts:
                    out.append((p["token"], p["hot"], k, c, p["first"], p["at"], data[p["first"] : p["first"] + p["n"] + WINDOW - 1]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["token", "hot", "k", "c", "first", "at", "data"])


class Prints:
    """Two fingerprints of any substring of a few strings."""

    def __init__(self, data: list[bytes]):
        width = max(map(len, data), default=0)
        grid = np.zeros((len(data), width), np.uint8)
        for i, x in enumerate(data):
            grid[i, : len(x)] = np.frombuffer(x, np.uint8)
        self.sums = []
        for roll in rollers():
            sums = np.zeros((len(data), width + 1), np.uint64)
            np.cumsum(roll.value[grid] * roll.power[:width], axis=1, out=sums[:, 1:])
            self.sums.append(sums)

    def of(self, row: np.ndarray, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_mix((s[row, start + length] - s[row, start]) * r.unpower[start]) for s, r in zip(self.sums, rollers(), strict=True))


def _windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of each string: the string's number and the window's."""
    n = np.array([len(x) - WINDOW + 1 for x in data], np.int64)
    return np.repeat(np.arange(len(data)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def window_prints(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each string: the string's number, the window's, two fingerprints."""
    row, at = _windows(data)
    return row, at, *Prints(data).of(row, at, WINDOW)


def equal_suffixes(flat: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which suffixes of ``flat`` agree in ``WINDOW`` bytes with another one of their group?

    A multikey quicksort whose characters are eight bytes wide: suffixes are sorted by a
    character and split where it differs, and only ties go on to the next one.  What is still
    tied after ``WINDOW`` bytes is equal.
    """
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    words = np.zeros(len(flat) + 1, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(words)]
    tied, part = np.arange(len(start)), group
    for depth in range(0, WINDOW, 8):
        word = words[start[tied] + depth]
        order = np.lexsort((word, part))
        tied, part, word = tied[order], part[order], word[order]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (word[1:] != word[:-1])))[: len(tied)]
        alone = new & np.append(new[1:], True)[: len(tied)]
        part = np.cumsum(new)[~alone]
        tied = tied[~alone]
        if not len(tied):
            break
    hit = np.zeros(len(start), bool)
    hit[tied] = True
    return hit


def _slices(batches):
    """Cut segments into slices by their windows' distance to the token: rows of the slice's
    fingerprints and those of its core, the bytes that all windows of a full slice share."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            b = whole.slice(start, 512)
            k, c, first, place = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("k", "c", "first", "at"))
            data = b.column(b.schema.get_field_index("data")).to_pylist()
            rows, begin, count, core = [], [], [], []
            for i, x in enumerate(data):
                far, near = int(place[i]), int(place[i]) - (len(x) - WINDOW)
                for q in range(near // SLICE, far // SLICE + 1):
                    high, low = min(far, q * SLICE + SLICE - 1), max(near, q * SLICE)
                    rows.append(i)
                    begin.append(far - high)
                    count.append(high - low + 1)
                    core.append(far - q * SLICE)
            rows, begin, count, core = (np.array(x, np.int64) for x in (rows, begin, count, core))
            prints = Prints(data)
            made = [*prints.of(rows, begin, count + (WINDOW - 1)), *prints.of(rows, core, np.full(len(rows), WINDOW - SLICE + 1))]
            texts = [data[i][p : p + n + WINDOW - 1] for i, p, n in zip(rows.tolist(), begin.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in made), pa.array(k[rows]), pa.array(c[rows]), pa.array((first[rows] + begin).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(texts, pa.binary())], names=["w1", "w2", "c1", "c2", "k", "c", "first", "n", "data"])


def _runs(k: np.ndarray, c: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Maximal runs of repeated windows, as (k, c, first window, number of windows)."""
    row, at = row[hit], at[hit]
    begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.empty(0, int)
    count = np.diff(np.append(begin, len(row)))
    own = row[begin]
    return pa.RecordBatch.from_arrays([pa.array(k[own].astype(np.int64)), pa.array(c[own].astype(np.int64)), pa.array((first[own] + at[begin]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["k", "c", "first", "n"])


def _sort_windows(batches):
    """Rows sorted by token: sort the suffixes at the windows of each token."""

    def done(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        token, k, c, first, place = (t.column(n).to_numpy() for n in ("token", "k", "c", "first", "at"))
        data = t.column("data").to_pylist()
        row, at = _windows(data)
        lengths = np.array([len(x) for x in data], np.int64)
        start = (np.cumsum(lengths) - lengths)[row] + at
        # Equal windows have their token at the same place.
        kind = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
        hit = equal_suffixes(np.frombuffer(b"".join(data), np.uint8), start, kind[row] * WINDOW + place[row] - at)
        return _runs(k, c, first, row, at, hit)

    held: list[pa.RecordBatch] = []
    n = 0
    for whole in batches:
        for start in range(0, whole.num_rows, SORT_ROWS):
            b = whole.slice(start, SORT_ROWS)
            if n >= SORT_ROWS:
                # Cut before the token that is still open.
                token = b.column(0).to_numpy(zero_copy_only=False)
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                cut = int(np.searchsorted(token, last, side="right"))
                if cut < b.num_rows:
                    yield done([*held, b.slice(0, cut)] if cut else held)
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
    if held:
        yield done(held)


def _explode_windows(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            b = whole.slice(start, 512)
            k, c, first = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("k", "c", "first"))
            row, at, one, two = window_prints(b.column(b.schema.get_field_index("data")).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(k[row]), pa.array(c[row]), pa.array((first[row] + at).astype(np.int32))], names=["one", "two", "k", "c", "first"])


def _split_segments(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """(k, c, first, n): repeated windows of the segments of hot tokens, by counting alone."""
    here = F.struct("k", "c", "first")
    slices = stage(spark, segments.mapInArrow(*lean(_slices, "w1 long, w2 long, c1 long, c2 long, k long, c long, first int, n int, data binary")), "slices")
    wholes = stage(spark, slices.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.min(here).alias("kind")).filter("m > 1"), "wholes")
    marked = stage(spark, slices.join(wholes, ["w1", "w2"], "left"), "marked")
    equal = marked.filter("m > 1").select("k", "c", "first", "n")
    # Undecided: slices met once, together with one of each kind of equal ones.
    kinds = marked.filter(F.col("m").isNull() | (here == F.col("kind"))).select("c1", "c2", "k", "c", "first", "data", F.col("m").isNull().cast("int").alias("open"))
    cores = stage(spark, kinds.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open")).filter("n > 1 and open > 0").select("c1", "c2"), "cores")
    windows = stage(spark, kinds.join(cores, ["c1", "c2"], "left_semi").mapInArrow(*lean(_explode_windows, "one long, two long, k long, c long, first int")), "windows")
    twice = stage(spark, windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("one", "two"), "twice")
    return equal.union(windows.join(twice, ["one", "two"], "left_semi").select("k", "c", "first", F.lit(1).alias("n")))


def repeated_windows(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, c, first, n): runs of windows that start at byte ``first`` and also stand elsewhere."""
    small_batches(spark)
    keyed = _keyed(docs, key)
    met = stage(spark, repeated_segments(spark, keyed), "repeated")
    left = met.filter("not equal")
    # A left-over window may also stand inside an equal segment: one of each kind takes part.
    kind = F.min(F.struct("k", "c", "first", "n", "at")).alias("p")
    kinds = met.filter("equal").groupBy("token", "whole", "whole2").agg(kind).select("token", "p.*", F.lit(0).alias("open"))
    some = left.select("token", "k", "c", "first", "n", "at", F.lit(1).alias("open")).union(kinds)
    tokens = some.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("open").alias("open")).filter("open > 0 and m > 1")
    tokens = stage(spark, tokens.select("token", (F.col("m") > HOT_SEGMENTS).alias("hot")), "tokens")
    parts = some.drop("open").join(tokens, "token").groupBy("k", "c").agg(F.collect_set(F.struct("first", "n", "at", "token", "hot")).alias("parts"))
    fetched = keyed.select("k", "c", "data").join(parts.hint("shuffle_hash"), ["k", "c"]).select("k", "c", "data", "parts").mapInArrow(*lean(_context_rows, "token long, hot boolean, k long, c long, first int, at short, data binary"))
    fetched = stage(spark, fetched, "contexts")
    runs = "k long, c long, first int, n int"
    cold = fetched.filter("not hot").repartitionByRange("token").sortWithinPartitions("token").select("token", "k", "c", "first", "at", "data").mapInArrow(*lean(_sort_windows, runs))
    split = _split_segments(spark, fetched.filter("hot").select("k", "c", "first", "at", "data"))
    equal = met.filter("equal").select("k", "c", "first", F.col("n").cast("int").alias("n"))
    return equal.union(cold).union(split)


def cut_bytes(data: bytes, runs) -> tuple[bytes, int]:
    """What remains of a text without the bytes that its repeated windows cover, and in how
    many runs they were removed."""
    change = np.zeros(len(data) + 1, np.int32)
    for first, n in runs:
        change[first] += 1
        change[min(len(data), first + n + WINDOW - 1)] -= 1
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def remove_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """Replace ``text`` by ``kept`` (its remaining bytes), ``n_bytes`` and ``n_spans``.

    ``kept`` is binary, or with ``as_text`` a string, without what is left of characters that
    a cut has split.

    A null text is empty; a text shorter than the window keeps everything.  Repeated rows,
    rows with one key and different texts and null keys are texts of their own, so a text
    that stands twice is removed from both.  An empty table gives an empty table; other
    columns pass through (names that begin with ``_tw_`` are reserved, columns named like a
    result are replaced).  A text is held in one task with about 30 bytes for each of its own.
    """
    added = ("kept", "n_bytes", "n_spans")
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in added]
    runs = repeated_windows(spark, docs.select(F.col(key), F.col(text).alias("text")), key)
    gathered = runs.groupBy("k", "c").agg(F.collect_set(F.struct("first", "n")).alias("_tw_runs")).withColumnsRenamed({"k": "_tw_k", "c": "_tw_c"})
    whole = docs.select(*[f.name for f in rest], *[c.alias(n) for n, c in _key_columns(F.col(key), text_of(text)).items()])
    joined = whole.join(gathered.hint("shuffle_hash"), ["_tw_k", "_tw_c"], "left").select(*[f.name for f in rest], "_tw_data", "_tw_runs")

    def cut(batches):
        for b in batches:
            for part in slices(b, "_tw_data"):
                data, runs = (part.column(i).to_pylist() for i in (len(rest), len(rest) + 1))
                made = [cut_bytes(d, [(r["first"], r["n"]) for r in rs]) if rs else (d, 0) for d, rs in zip(data, runs, strict=True)]
                kept = [x.decode("utf-8", "ignore") if as_text else x for x, _ in made]
                columns = [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array([len(d) for d in data], pa.int64()), pa.array([n for _, n in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *columns], names=[*part.schema.names[: len(rest)], *added])

    kinds = (T.StringType() if as_text else T.BinaryType(), T.LongType(), T.LongType())
    return joined.mapInArrow(*lean(cut, T.StructType([*rest, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    cut = remove_repeats(spark, docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
