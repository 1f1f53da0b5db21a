"""URL filters by a Bloom filter cascade.

The keys of a URL are its host's suffixes at label boundaries joined to its path's prefixes.
Level 0 encodes the listed keys; among all keys of the corpus it also accepts some that are
not listed, and those are encoded by level 1; of the listed keys level 1 accepts some, which
level 2 encodes, and so on until a level accepts nothing wrong.  A key of the corpus is listed
if the first level that rejects it is an odd one: exact for the whole key universe, and no
join is needed to apply it.

A cascade is sent to all tasks.  Where it would outgrow ``MAX_FILTER_BYTES``, the keys are cut
into slices by their hash, each with a cascade of its own, and one pass over the URLs for each
slice decides the keys of that slice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, lean, stage, unstage

#: Bytes of the bit arrays that are sent to all tasks at a time.
MAX_FILTER_BYTES = 1 << 26
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, rule: str) -> Rule:
    host, slash, path = rule.partition("/")
    return Rule(host, slash + path, verdict)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without ``://``."""
    url = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys that a rule could equal, the longest first; of equally long ones the longer host."""
    parts = F.split(host, r"\.")
    whole = lambda numbers: F.array(*[F.lit(n) for n in numbers]).cast("array<int>")
    suffixes = F.transform(F.filter(whole(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(whole(lengths), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    # Functions over both arrays: the plan has the same size whatever the rules' depths and lengths.
    pair = lambda s, p: F.struct(F.negative(F.length(s) + F.length(p)).alias("a"), F.negative(F.length(s)).alias("b"), F.concat(s, p).alias("key"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: pair(s, p))))
    return F.transform(F.sort_array(keys), lambda x: x["key"])


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, probes: int) -> list[np.ndarray]:
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    a = (a ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    a, b = a ^ (a >> np.uint64(32)), b * np.uint64(2 * level + 1) | np.uint64(1)
    return [((a + np.uint64(k) * b) >> np.uint64(11)) % np.uint64(bits) for k in range(probes)]


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    words: bytes

    def accepts(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        field, ok = np.frombuffer(self.words, np.uint8), np.ones(len(h1), bool)
        for at in _positions(h1, h2, level, self.bits, self.probes):
            at = at.astype(np.int64)
            ok &= (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        listed, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for k, level in enumerate(self.levels):
            passed = np.zeros(len(h1), bool)
            where = np.flatnonzero(open_)
            passed[where] = level.accepts(h1[where], h2[where], k)
            listed |= open_ & ~passed & (k % 2 == 1)
            open_ &= passed
        # What the last level accepts is what it encodes.
        return listed | (open_ if len(self.levels) % 2 else np.zeros(len(h1), bool))


def _encode(spark: SparkSession, keys: DataFrame, n: int, level: int, rate: float) -> Level:
    """Bits of a level: each task sets its own, words of 64 bits are merged by OR."""
    bits = max(64, math.ceil(max(n, 1) * -math.log(rate) / math.log(2) ** 2))
    probes = max(1, round(-math.log2(rate)))
    def words(batches):
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.unique(np.concatenate(_positions(h1, h2, level, bits, probes))) if len(h1) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    merged = keys.select("h1", "h2").mapInArrow(*lean(words, "word long, mask long")).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    field = np.zeros(-(-bits // 64), np.uint64)
    field[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return Level(bits, probes, field.tobytes())


def _accepted(keys: DataFrame, level: Level, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            i = {n: j for j, n in enumerate(b.schema.names)}
            ok = level.accepts(b.column(i["h1"]).to_numpy(zero_copy_only=False), b.column(i["h2"]).to_numpy(zero_copy_only=False), k)
            yield b.filter(pa.array(ok))

    return keys.mapInArrow(*lean(run, keys.schema))


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))


def _rate(n_listed: int, n_others: int) -> float:
    """Level 0 lets about as many unlisted keys pass as are listed."""
    return min(0.5, max(1e-9, math.sqrt(0.5) * max(n_listed, 1) / max(n_others, 1)))


def slices_for(n_listed: int, n_others: int) -> int:
    """How many cascades it takes to keep each within ``MAX_FILTER_BYTES``."""
    # Level 0, and the levels of rate 1/2 after it, which halve from level to level.
    bits = max(n_listed, 1) * (-math.log2(_rate(n_listed, n_others)) + 6) / math.log(2)
    return max(1, math.ceil(bits / 8 / MAX_FILTER_BYTES))


def _split(listed: DataFrame, universe: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame, int, int]:
    listed = stage(spark, _hashed(listed.distinct()), "listed")
    others = stage(spark, _hashed(universe.distinct()).join(listed.select("key"), "key", "left_anti"), "others")
    return listed, others, listed.count(), others.count()


def _cascade(spark: SparkSession, listed: DataFrame, others: DataFrame) -> Cascade:
    n = listed.count()
    levels, inside, outside, made = [], listed, others, []
    rate = _rate(n, others.count())
    while n:
        k = len(levels)
        if k == MAX_LEVELS:
            raise ValueError("two keys have the same 128 bits of hash: no cascade tells them apart")
        levels.append(_encode(spark, inside, n, k, rate if k == 0 else 0.5))
        made.append(stage(spark, _accepted(outside, levels[-1], k), "wrong"))
        inside, outside, n = made[-1], inside, made[-1].count()
    for df in made:
        unstage(spark, df)
    return Cascade(tuple(levels))


def build(spark: SparkSession, listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for the distinct keys ``listed`` over the distinct keys ``universe``.

    Both have one column ``key``.  Level 0's rate is chosen so that it lets about as many
    unlisted keys pass as are listed, the others' is 1/2, so all levels together need a few
    bits for each listed key and each doubling of the universe.
    """
    listed, others, _, _ = _split(listed, universe, spark)
    made = _cascade(spark, listed, others)
    for df in (listed, others):
        unstage(spark, df)
    return made


def first_listed(rows: DataFrame, keys: str, cascade: Cascade, marks: Cascade, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Set ``_tw_rule``, the place (from 0) of the first of the row's ``keys`` that is listed (-1
    without one), and ``_tw_marked``: does ``marks``, whose universe is what ``cascade`` lists,
    list that key?  ``keys`` is an array of strings, ``part`` the slice of keys that the
    cascades decide; what other slices have found before counts too."""
    rows = rows.withColumn("_tw_h1", F.transform(keys, lambda k: F.xxhash64(k, F.lit(1)))).withColumn("_tw_h2", F.transform(keys, lambda k: F.xxhash64(k, F.lit(2))))
    number, of = part

    def run(batches):
        for b in batches:
            i = {n: j for j, n in enumerate(b.schema.names)}
            sizes = np.diff(b.column(i["_tw_h1"]).offsets.to_numpy())
            h1, h2 = (b.column(i[x]).flatten().to_numpy(zero_copy_only=False) for x in ("_tw_h1", "_tw_h2"))
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(cascade.contains(h1, h2) & (h1 % of == number))[::-1]
            first = np.full(len(sizes), -1, np.int64)
            first[row[hit]] = hit - begin[row[hit]]
            marked, where = np.zeros(len(sizes), bool), np.flatnonzero(first >= 0)
            at = begin[where] + first[where]
            marked[where] = marks.contains(h1[at], h2[at])
            before, was = (b.column(i[x]).to_numpy(zero_copy_only=False) for x in ("_tw_rule", "_tw_marked"))
            old = (before >= 0) & ((first < 0) | (before < first))
            first, marked = np.where(old, before, first), np.where(old, was, marked).astype(bool)
            keep = [j for n, j in i.items() if n not in ("_tw_h1", "_tw_h2", "_tw_rule", "_tw_marked")]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in keep), pa.array(first.astype(np.int32)), pa.array(marked)], names=[*(b.schema.names[j] for j in keep), "_tw_rule", "_tw_marked"])

    fields = [f for f in rows.schema.fields if f.name not in ("_tw_h1", "_tw_h2", "_tw_rule", "_tw_marked")]
    return rows.mapInArrow(*lean(run, T.StructType([*fields, T.StructField("_tw_rule", T.IntegerType()), T.StructField("_tw_marked", T.BooleanType())])))


def rules_frame(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """(host, path, verdict) of the rules; two verdicts for one key are an error."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("key")).distinct()
    twice = rules.groupBy("key").agg(F.count_distinct("verdict").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"two verdicts for {twice.key}")
    return rules


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", unlisted: str = "allow") -> DataFrame:
    """Judge each URL: adds ``host``, ``path``, ``rule`` and ``verdict`` (replacing such columns).

    ``rules`` is a list, or a DataFrame (host, path, verdict: allow or block).  A rule fits its
    host and all subdomains if the path starts with the rule's; the longest (in characters of
    host and path, then of host) wins, so of rules that tie in length the one with the longer
    host.  A URL that no rule fits gets ``unlisted``.  Two cascades decide: one of all rules
    over the corpus, one of those that allow over the rules.

    A null URL or one without ``://`` has an empty host and path.  A URL may be as long as a
    row allows: its keys are those at the rules' lengths, however many labels it has.
    Repeated rows are judged alike; an empty table gives an empty table, an empty list of rules
    leaves all unlisted.  Other columns pass through (``_tw_keys``, ``_tw_rule``, ``_tw_marked``, ``_tw_h1``
    and ``_tw_h2`` are reserved).
    """
    rules = stage(spark, rules_frame(spark, rules), "rules")
    labels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(url)
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not labels:
        return split.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(unlisted))
    keyed = split.withColumn("_tw_keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    listed, others, n_listed, n_others = _split(rules.select("key"), keyed.select(F.explode("_tw_keys").alias("key")), spark)
    allowing = _hashed(rules.filter("verdict = 'allow'").select("key"))
    others_of_rules = _hashed(rules.filter("verdict <> 'allow'").select("key"))
    judged, of = keyed.withColumns({"_tw_rule": F.lit(-1), "_tw_marked": F.lit(False)}), slices_for(n_listed, n_others)
    for number in range(of):
        mine = F.pmod("h1", F.lit(of)) == number
        both = _cascade(spark, listed.filter(mine), others.filter(mine))
        marks = _cascade(spark, allowing.filter(mine), others_of_rules.filter(mine))
        judged = first_listed(judged, "_tw_keys", both, marks, (number, of))
        if number + 1 < of:  # one cascade in memory at a time
            judged = stage(spark, judged, "judged")
    for df in (listed, others):
        unstage(spark, df)
    rule = F.when(F.col("_tw_rule") >= 0, F.get("_tw_keys", F.col("_tw_rule")))
    verdict = F.when(F.col("_tw_rule") < 0, F.lit(unlisted)).when(F.col("_tw_marked"), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
