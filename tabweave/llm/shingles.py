"""Near copies of texts by SimHash and an exact set-similarity join of their word shingles.

Two texts are near copies if the sets of their word shingles have a Jaccard similarity of at
least ``share``.  Balls around fingerprints find the nearest of them, but cannot find all: sets at
0.8 differ in about ten of 64 SimHash bits.  What they do not reach comes from prefixes:

1. Texts with equal sets form a class, named by 128 bits of the set; one of each takes part.  Classes
   whose fingerprints are linked by ball hashing (:mod:`simhash`) are compared.
2. All shingles have one order, the rarest first by a sketch of counts (any order is exact; this
   one keeps common passages out of the prefixes).  Of n shingles, the first n - ceil(share * n) + 1
   are emitted; two near sets always share one of them.
3. Sets that share one stand in its bucket.  Each is compared with the bucket's hub, the set with
   the fewest shingles of its own, which joins most of a large group of near copies (the hub is
   the least changed of them) by as many comparisons as it has members.
4. What is left are pairs of a bucket that are not joined yet: buckets with one group drop out,
   of the others each set outside the largest group meets the sets of other groups, if the
   bounds on size and position allow it: two sets that need an overlap of o share a shingle
   among the first n - o + 1 of each, and what a set shares with no other is no overlap.  Sketches
   of the sets (:func:`sketch`) bound their difference from below, and a pair is left to an earlier
   bucket that both are known to share: without them, a set that shares a passage with all of a
   group would cost a row for each of its members and each shingle.
5. Links between classes are followed to the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simhash
from .common import lean, slices, small_batches, stage, text_of
from .graph import components

#: Words of a shingle; the least similarity as a fraction, so that it is compared in integers.
WIDTH, SHARE = 5, (4, 5)
#: Counters of the sketch, and how many of the largest are used.
BUCKETS, COMMON = 1 << 20, 50_000
#: A task tells only counts above this, and above four times its mean.
TOLD = 2
#: Sets of a shingle that one task takes, by the sketch; a commoner one is dealt to several.
HOT = 1 << 12
#: Sets that a task remembers, to emit copies once; entries it hands over at a time.
SEEN, ENTRIES = 1 << 14, 1 << 15
#: Bits of the map of wanted texts that goes to all tasks: 16 for each, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Bits of a set's sketch; the shared shingles before its own that an entry knows.
SKETCH, EARLIER = 512, 4

_M32, _M29, _BASE = np.uint64(32), np.uint64(29), np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles; a shorter text is one shingle, an empty one has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * _BASE + each[k : k + n]
        out = (out ^ (out >> _M32)) * _MULTIPLIER
        out ^= out >> _M29
    return np.unique(out)


def set_name(found: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(found.tobytes()), np.int64).tolist())


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def sketch(found: np.ndarray) -> list[int]:
    """For each of ``SKETCH`` buckets, by other bits of the hashes, the parity of its count.

    A shingle that only one of two sets has turns one bit, so the sketches of two sets differ in
    at most as many bits as the sets in shingles."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def row_names(key: str, text: str) -> dict[str, F.Column]:
    """128 bits of a row's key and text."""
    parts = (F.col(key).isNull(), F.col(key), F.octet_length(text_of(text)), text_of(text))
    return {"_tw_1": F.xxhash64(*parts), "_tw_2": F.xxhash64(F.lit(1), *parts)}


def _named_sets(width: int):
    """Each row with the name, size, sketch and fingerprint of its set; then the task's large counters (n = -1)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
    names = ["id", "_tw_1", "_tw_2", "h1", "h2", "n", "bits", "fp"]

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for t in b.column(3).to_pylist():
                found = shingle_set(t, width)
                np.add.at(counts, _buckets(found), 1)
                fp = np.uint64(simhash.majority(found)).view(np.int64)
                rows.append((*set_name(found), len(found), sketch(found), fp))
            made = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds[3:], strict=True)] if rows else [pa.array([], k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=names)
        told = np.flatnonzero(counts > TOLD + 4 * counts.mean())
        none = np.zeros(len(told), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((none, none, none, told, counts[told], np.full(len(told), -1), [[]] * len(told), none), kinds, strict=True)], names=names)

    return run


def _prefixes(width: int, share: tuple[int, int], common: np.ndarray, often: np.ndarray):
    """(shingle, salt, set, size << 32 | place) for the prefix of each set; a shingle in about
    ``HOT`` sets or more is dealt out by the set's salt, of others the salt is -1."""
    names = ["s", "salt", "h1", "h2", "at"]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    def run(batches):
        weight, seen, out, held = np.zeros(BUCKETS, np.int64), set(), [[] for _ in names], 0
        weight[common] = often
        for b in (part for whole in batches for part in slices(whole, "text")):
            for t in b.column(0).to_pylist():
                found = shingle_set(t, width)
                name, n = set_name(found), len(found)
                if not n or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                p = n - -(-share[0] * n // share[1]) + 1
                w = weight[_buckets(found)]
                order = np.argsort(w, kind="stable")[:p]
                first, salts = found[order], w[order] // HOT
                salt = np.where(salts > 0, (name[0] & 0x7FFFFFFF) % (salts + 1), -1)
                for x, y in zip(out, (first.view(np.int64), salt.astype(np.int32), np.full(p, name[0]), np.full(p, name[1]), (n << 32) + np.arange(p)), strict=True):
                    x.append(y)
                held += p
                if held >= ENTRIES:
                    yield batch(out)
                    out, held = [[] for _ in names], 0
        if held:
            yield batch(out)

    return run


_ENTRY = "s long, salt int, h1 long, h2 long, at long"
_SHARED = "s long, h1 long, h2 long, n long, i long"


def _shared(batches):
    """Of rows sorted by (shingle, salt, set): each set of a shingle once, where the shingle has
    another one (or is common enough to be dealt out)."""

    def emit(rows: list[np.ndarray], before, after):
        s, salt, h1, h2, at = rows
        follows = np.append(before is not None and before == (s[0], salt[0]), (s[1:] == s[:-1]) & (salt[1:] == salt[:-1]))
        leads = np.append(follows[1:], after is not None and after == (s[-1], salt[-1]))
        keep = follows | leads | (salt >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, h1, h2, at >> 32, at & 0xFFFFFFFF)], names=[x.split()[0] for x in _SHARED.split(", ")])

    held, before, last = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in (0, 2, 3)], axis=0)
        new[0] = last != tuple(rows[k][0] for k in (0, 2, 3))
        last = tuple(rows[k][-1] for k in (0, 2, 3))
        if not new.any():
            continue
        rows = [x[new] for x in rows]
        if held is not None:
            yield emit(held, before, (rows[0][0], rows[1][0]))
            before = (held[0][-1], held[1][-1])
        held = rows
    if held is not None:
        yield emit(held, before, None)


def _wanted_sets(width: int, bits: int, field: np.ndarray):
    """Sets of the rows that the map of wanted texts lets through."""

    def run(batches):
        for whole in batches:
            place = (whole.column(0).to_numpy(zero_copy_only=False) & (bits - 1)).astype(np.int64)
            whole = whole.filter(pa.array((field[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for b in slices(whole, "text"):
                made = [shingle_set(t, width).tobytes() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(made, pa.binary())], names=["_tw_1", "_tw_2", "found"])

    return run


def _fetch_sets(spark: SparkSession, rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(h1, h2, c, found): the whole sets of all classes in ``pairs``.

    Texts are not shuffled for it: a map of their names, of a bounded size, lets only wanted
    ones (and a few others) through, and the join by name sorts these others out.
    """
    names = pairs.select("h1", "h2").union(pairs.select("p1", "p2")).distinct()
    wanted = stage(spark, classes.join(names, ["h1", "h2"]).select("h1", "h2", "c", "best._tw_1", "best._tw_2"), "wanted")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    place = F.col("_tw_1").bitwiseAND(F.lit(bits - 1))
    mask = F.expr(f"bit_or(shiftleft(1L, cast(_tw_1 & {63}L as int)))")
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(mask.alias("mask")).toArrow()
    field = np.zeros(bits >> 6, np.uint64)
    field[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    sets = rows.select("_tw_1", "_tw_2", "text").mapInArrow(*lean(_wanted_sets(width, bits, field), "_tw_1 long, _tw_2 long, found binary"))
    sets = sets.join(wanted, ["_tw_1", "_tw_2"]).dropDuplicates(["_tw_1", "_tw_2"])
    return stage(spark, sets.select("h1", "h2", "c", "found"), "candidate-sets")


def _compared(share: tuple[int, int]):
    """(a, b): pairs that really are as similar as asked."""

    def run(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both * share[1] >= share[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _verified(spark: SparkSession, rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between classes: the pairs (h1, h2, p1, p2) that are near."""
    pairs = stage(spark, pairs.select("h1", "h2", "p1", "p2"), "candidates")
    sets = _fetch_sets(spark, rows, classes, pairs, width)
    x = sets.toDF("h1", "h2", "a", "afound")
    y = sets.toDF("p1", "p2", "b", "bfound")
    whole = pairs.join(x, ["h1", "h2"]).join(y, ["p1", "p2"]).select("a", "b", "afound", "bfound")
    return stage(spark, whole.mapInArrow(*lean(_compared(share), "a long, b long")), "near-links")


def _needed(share: tuple[int, int]) -> F.Column:
    """The overlap of two sets of n and pn shingles that are as near as asked."""
    up, down = share
    return F.ceil((F.col("n") + F.col("pn")) * up / (up + down))


def _may_reach(share: tuple[int, int]) -> F.Column:
    """Do the sizes, less the shingles of their own that sets are known to have, allow it?"""
    return F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu")) >= _needed(share)


_SET = ("h1", "h2", "n", "u")


def _theirs(df: DataFrame, *more: str) -> list[F.Column]:
    names = {"h1": "p1", "h2": "p2"}
    return [F.col(x).alias(names.get(x, f"p{x}")) for x in (*_SET, *more)]


def _distinct(pairs: DataFrame) -> DataFrame:
    """Pairs (h1, h2, p1, p2), the smaller set first, each once."""
    turned = F.struct("h1", "h2") > F.struct("p1", "p2")
    one, other = F.struct("h1", "h2"), F.struct(F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    pairs = pairs.select(F.when(turned, other).otherwise(one).alias("a"), F.when(turned, one).otherwise(other).alias("b"))
    return pairs.select("a.h1", "a.h2", F.col("b.h1").alias("p1"), F.col("b.h2").alias("p2")).distinct()


def _in_balls(spark: SparkSession, classes: DataFrame, share: tuple[int, int], radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs of classes that SimHash links: fingerprints that are equal (each class and the first) or
    within ``radius`` bits (as ball hashing chains them), less those that sizes or sketches refute."""
    some = classes.filter("n > 0")
    firsts = stage(spark, some.groupBy("fp").agg(F.min("c").alias("id")), "fingerprints")
    equal = some.join(firsts, "fp").filter("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b"))
    links = equal.union(simhash.link_classes(firsts, radius).select("a", "b"))
    one, other = (some.select("c", "h1", "h2", "n", "bits").toDF(*names) for names in (("a", "h1", "h2", "n", "bits"), ("b", "p1", "p2", "pn", "pbits")))
    near = links.join(one, "a").join(other, "b").filter((F.least("n", "pn") >= _needed(share)) & _little_apart(share))
    return near.select("h1", "h2", "p1", "p2")


def _with_hubs(shared: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of each set and the hub of each of its buckets."""
    hubs = shared.groupBy("s").agg(F.max(F.struct((-F.col("u")).alias("few"), *_SET)).alias("hub")).select("s", "hub.*")
    pairs = shared.join(hubs.select("s", *_theirs(hubs)), "s")
    return _distinct(pairs.filter(((F.col("h1") != F.col("p1")) | (F.col("h2") != F.col("p2"))) & _may_reach(share)))


def _little_apart(share: tuple[int, int]) -> F.Column:
    """Do the sketches differ in no more bits than near sets may differ in shingles?"""
    turned = [F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("pbits", F.lit(k)))) for k in range(SKETCH // 64)]
    return sum(turned[1:], turned[0]) <= F.col("n") + F.col("pn") - 2 * _needed(share)


def _meetings(shared: DataFrame, groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of sets that may be near and are in different ``groups`` (h1, h2, bits, g), each at
    least once.

    Of each shingle the largest group is only met by the others, so a bucket costs as many
    rows as its sets outside of that group have partners within the bounds.  A pair that is
    known to share an earlier shingle meets there, within the same bounds."""
    placed = shared.join(groups, ["h1", "h2"])
    sizes = placed.groupBy("s", "g").agg(F.count(F.lit(1)).alias("m"))
    major = sizes.groupBy("s").agg(F.max(F.struct("m", "g")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    placed = placed.join(major.select("s", F.col("top.g").alias("major")), "s")
    one = placed.filter("g <> major")
    other = placed.select("s", *_theirs(placed, "i", "g", "bits", "before"), (F.col("g") == F.col("major")).alias("most"))
    apart = (F.col("g") != F.col("pg")) & (F.col("most") | (F.col("g") < F.col("pg")))
    early = (F.col("i") <= F.col("n") - _needed(share)) & (F.col("pi") <= F.col("pn") - _needed(share))
    first = ~F.arrays_overlap("before", "pbefore")
    return one.join(other, "s").filter(apart & _may_reach(share) & early & _little_apart(share) & first)


def _across(shared: DataFrame, groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs of :func:`_meetings`, each once."""
    return _distinct(_meetings(shared, groups, share))


def _classes_and_shared(spark: SparkSession, docs: DataFrame, key: str, text: str, width: int, share: tuple[int, int]):
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), *[c.alias(n) for n, c in row_names(key, text).items()], text_of(text).alias("text"))
    marked = stage(spark, rows.mapInArrow(*lean(_named_sets(width), "id long, _tw_1 long, _tw_2 long, h1 long, h2 long, n int, bits array<long>, fp long")), "shingle-sets")
    counters = marked.filter("n < 0").groupBy("h1").agg(F.sum("h2").alias("m")).orderBy(F.desc("m"), "h1").limit(COMMON).collect()
    common, often = (np.array([r[i] for r in counters], np.int64) for i in (0, 1))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_tw_1", "_tw_2")).alias("best")
    classes = marked.filter("n >= 0").groupBy("h1", "h2").agg(F.max("n").alias("n"), best, F.any_value("bits").alias("bits"), F.any_value("fp").alias("fp"))
    classes = stage(spark, classes.select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "n", "best", "bits", "fp"), "shingle-classes")
    entries = rows.select("text").mapInArrow(*lean(_prefixes(width, share, common, often), _ENTRY))
    dealt = entries.repartition("s", "salt").sortWithinPartitions("s", "salt", "h1", "h2")
    shared = stage(spark, dealt.mapInArrow(*lean(_shared, _SHARED)), "shared-shingles")
    up, down = share
    of_set = Window.partitionBy("h1", "h2")
    own = F.col("n") - F.ceil(F.col("n") * up / down) + 1 - F.count(F.lit(1)).over(of_set)
    before = F.array_compact(F.array(*[F.lag("s", k).over(of_set.orderBy("i")) for k in range(1, EARLIER + 1)]))
    shared = shared.select("s", "h1", "h2", "n", own.alias("u"), "i", before.alias("before"))
    return rows, classes, stage(spark, shared, "placed-shingles")


def near_classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """Classes (c, h1, h2, n, best: the smallest row, bits: the sketch, fp: the fingerprint) of equal sets, and all links (a, b) of near ones."""
    rows, classes, shared = _classes_and_shared(spark, docs, key, text, width, share)
    pairs = _across(shared, classes.select("h1", "h2", "bits", F.col("c").alias("g")), share)
    return classes, _verified(spark, rows, classes, pairs, width, share)


def near_groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Classes as in :func:`near_classes` with ``g``, the smallest class linked to each.

    Near copies are joined by their fingerprints and around hubs first, and only then are pairs of
    different groups compared: all links count, but a group costs no comparison for each pair.
    """
    rows, classes, shared = _classes_and_shared(spark, docs, key, text, width, share)
    first = _distinct(_in_balls(spark, classes, share).union(_with_hubs(shared, share)))
    links = _verified(spark, rows, classes, first, width, share)

    def grouped(links: DataFrame) -> DataFrame:
        found = components(spark, links)
        return stage(spark, classes.join(found, classes["c"] == found["node"], "left").select(*classes.columns, F.coalesce("component", "c").alias("g")), "groups")

    groups = grouped(links)
    pairs = _across(shared, groups.select("h1", "h2", "bits", "g"), share)
    return grouped(links.union(_verified(spark, rows, classes, pairs, width, share)))


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Of each group of near copies, the row with the smallest key (nulls last).

    Rows are named by key and text: rows that share a key, or have none, and hold different
    texts are judged one by one; of rows equal in both, one stays.  Null and empty texts are
    copies of each other; an empty table gives an empty table; other columns pass through
    (``_tw_1`` and ``_tw_2`` are reserved).
    """
    groups = near_groups(spark, docs, key, text, width, share)
    stays = stage(spark, groups.groupBy("g").agg(F.min("best").alias("best")).select("best._tw_1", "best._tw_2"), "stays")
    names = row_names(key, text)
    return docs.select("*", *[c.alias(n) for n, c in names.items()]).join(stays, list(names)).dropDuplicates(list(names)).select(*docs.columns)
