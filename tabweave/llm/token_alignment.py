"""Alignment of two tokenizers over the bytes that both cut.

Each text is encoded by both; byte offsets where a token of either ends (cumulated lengths) cut it
into groups.  Every pair of tokens that shares a group is a link.  How many documents hold an id
pair linked is counted corpus-wide:

1. A task encodes its documents in blocks and keeps, of each, one row: the digests of its documents,
   their pairs (packed), and the distinct pairs of the block with the documents that hold them.
2. Pairs are added up in two shuffles, first by pair and salt, then by pair.
3. The counts go back to the blocks by pair, and each block sums them up for its documents.

So what moves is one row for each distinct pair of a block, however often its documents hold it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, per_process, slices, small_batches, stage, text_of

#: Bytes of text that are encoded at a time, and of a block (or one text).
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: Links that are unfolded at a time.
LINKS = 1 << 21
#: Ways in which a pair's blocks are dealt in the first step of the count.
SALTS = 16
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for
    themselves, the others, in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Tokenizers:
    """Files of a byte-level vocabulary (JSON), with its pre-token pattern, and of a piece model."""

    byte_level: bytes
    pattern: str
    pieces: bytes

    def token_bytes(self) -> dict[bytes, int]:
        """Ids of the byte-level tokens by their bytes, special ones left out.

        Ids are in the order of merges, so they serve as ranks."""
        described, letters = json.loads(self.byte_level), byte_letters()
        special = {t["content"] for t in described.get("added_tokens", ())}
        return {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}


@dataclass
class _Side:
    """Encoder of whole texts, and of each id its bytes, their number, and its digits as they are
    shown before another of its group, before the other side, and at a group's end."""

    encode: object
    bytes_of: list[bytes]
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def shown(self) -> np.ndarray:
        made = np.empty(3 * len(self.bytes_of), object)
        made[:] = [b"%d%b" % (i, end) for i in range(len(self.bytes_of)) for end in (b",", b"|", b";")]
        return made


class Pair:
    """Both encoders, made once a process."""

    def __init__(self, t: Tokenizers):
        import sentencepiece
        import tiktoken

        ranks = t.token_bytes()
        by_id = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            by_id[i] = token
        byte_level = tiktoken.Encoding("a", pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={})
        model = sentencepiece.SentencePieceProcessor(model_proto=t.pieces)
        pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))]
        self.a = _Side(lambda texts: [byte_level.encode_ordinary(f" {x}") for x in texts], by_id)
        self.b = _Side(lambda texts: model.encode(texts, num_threads=1), pieces)
        self.shown = np.concatenate([self.a.shown(), self.b.shown()])
        self.shown_b = 3 * len(by_id)


def _encoded(side: _Side, texts: list[str], wanted: list[bytes]) -> tuple[list[list[int]], list[bool]]:
    ids = side.encode(texts)
    token = side.bytes_of.__getitem__
    return ids, [b"".join(map(token, x)) == w for x, w in zip(ids, wanted, strict=True)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))), np.array([len(x) for x in ids], np.int64)


def _entries(group: np.ndarray, ids: np.ndarray, wide: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): the tokens of each group, equal ones of a wide group as one."""
    many = wide[group]
    keys, times = np.unique(group[many] * n_ids + ids[many], return_counts=True)
    group = np.concatenate([group[~many], keys // n_ids])
    ids, times = np.concatenate([ids[~many], keys % n_ids]), np.concatenate([np.ones(int((~many).sum()), np.int64), times])
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], times[order]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


@dataclass
class Aligned:
    """What alignment tells of some documents: counts of each, digests, and the links as
    (document, pair, times), sorted; a pair is a's id times the number of b's ids plus b's."""

    counts: np.ndarray
    digests: list[str]
    docs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def align_texts(pair: Pair, texts: list[str]) -> Aligned:
    """Align the tokens of each text; texts that are empty or do not come back have no tokens."""
    n_docs, n_a_ids, n_b_ids = len(texts), len(pair.a.bytes_of), len(pair.b.bytes_of)
    wanted = [b" " + t.encode() for t in texts]
    (ids_a, ok_a), (ids_b, ok_b) = _encoded(pair.a, texts, wanted), _encoded(pair.b, texts, wanted)
    good = [bool(t) and a and b for t, a, b in zip(texts, ok_a, ok_b, strict=True)]
    (a, per_a), (b, per_b) = (_flat([x if g else [] for x, g in zip(ids, good, strict=True)]) for ids in (ids_a, ids_b))
    # The documents stand one behind the other: where one ends, a token of either side ends.
    ends_a, ends_b = np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    doc_of_a = np.repeat(np.arange(n_docs), per_a)
    first_a = np.cumsum(in_a) - in_a
    doc = doc_of_a[first_a] if len(cuts) else np.zeros(0, np.int64)
    counts = np.zeros((4, n_docs), np.int64)
    counts[0], counts[1], counts[2] = per_a, per_b, np.bincount(doc, minlength=n_docs)
    np.add.at(counts[3], doc, in_a * in_b)
    # Digests: a token of a stands behind the tokens of all groups before its own, one of b also
    # behind the a tokens of its group; what follows a token depends on whether it is the last one.
    shown = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 3 * a + last_a
    shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = pair.shown_b + 3 * b + 2 * last_b
    ends = np.cumsum(per_a + per_b)
    digests = []
    for end, n in zip(ends.tolist(), (per_a + per_b).tolist(), strict=True):
        digests.append(hashlib.sha256(b"".join(pair.shown[shown[end - n : end]].tolist())[:-1]).hexdigest() if n else "")
    # Links: each entry of a meets all entries of b in its group.
    wide = (in_a > 1) & (in_b > 1)
    ga, ia, ta = _entries(group_a, a, wide, n_a_ids)
    gb, ib, tb = _entries(group_b, b, wide, n_b_ids)
    some_b = np.bincount(gb, minlength=len(cuts))
    first_b, partners = np.cumsum(some_b) - some_b, some_b[ga]
    unfolded, keys, times = np.cumsum(partners), [], []
    at, size = 0, n_a_ids * n_b_ids
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(unfolded, (unfolded[at - 1] if at else 0) + LINKS, "right")))
        n = partners[at:to]
        k = np.repeat(np.arange(at, to), n)
        place = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first_b[ga[k]]
        found, held = _summed(doc[ga[k]] * size + ia[k] * n_b_ids + ib[place], ta[k] * tb[place])
        keys.append(found)
        times.append(held)
        at = to
    found, held = _summed(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0]) if keys else (np.zeros(0, np.int64),) * 2
    return Aligned(counts, digests, found // size, found % size, held)


def _bytes_of(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, in few bytes."""
    import zstandard

    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _numbers_of(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.dtype(data[:1].decode())).astype(np.int64)


def _blocks(shared, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_process(name, lambda: Pair(Tokenizers(*shared.value)))
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, Aligned]] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made, size
            ids, parts = pa.concat_arrays([i for i, _ in held]), [x for _, x in held]
            before = np.cumsum([0] + [len(x.digests) for x in parts])
            docs = np.concatenate([x.docs + n for x, n in zip(parts, before[:-1], strict=True)])
            pairs, place, holders = np.unique(np.concatenate([x.pairs for x in parts]), return_inverse=True, return_counts=True)
            # Frequent pairs get small places, and the places of a document ascend.
            order = np.argsort(-holders, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place, times = rank[place], np.concatenate([x.times for x in parts])
            sorted_ = np.lexsort((place, docs))
            docs, place, times = docs[sorted_], place[sorted_], times[sorted_]
            step = np.diff(place, prepend=0)
            starts = np.flatnonzero(np.diff(docs, prepend=-1))
            step[starts] = place[starts]
            counts = np.concatenate([x.counts for x in parts], axis=1)
            fields = [ids, *[pa.array(c) for c in counts], pa.array([d for x in parts for d in x.digests])]
            told = pa.StructArray.from_arrays(fields, names=["id", *_COUNTS, "groups_sha256"])
            listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), listed(told), *[pa.array([_bytes_of(x)], pa.binary()) for x in (np.bincount(docs, minlength=len(ids)), step, times)], listed(pa.array(pairs[order])), listed(pa.array(holders[order]))],
                names=["block", "docs", "held", "steps", "times", "pairs", "holders"],
            )
            held.clear()
            made, size = made + 1, 0
            return out

        for b in batches:
            for s in slices(b, "text", SLICE_BYTES):
                if s.num_rows:
                    held.append((s.column(0), align_texts(pair, s.column(1).to_pylist())))
                    size += s.column(1).nbytes
                    if size >= BLOCK_BYTES:
                        yield block()
        if held:
            yield block()

    return run


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document of a block, from the counts of the block's pairs: links whose count is the
    highest of their a id, and counts summed over links."""
    for b in batches:
        column = lambda name, b=b: b.column(b.schema.get_field_index(name))
        for i in range(b.num_rows):
            docs = column("docs").slice(i, 1).flatten()
            held, step, times = (_numbers_of(column(c)[i].as_py()) for c in ("held", "steps", "times"))
            told = column("told")[i].values
            n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if told is not None and len(told):
                where = told.field("place").to_numpy()
                n, best = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
                n[where], best[where] = told.field("n").to_numpy(), told.field("best").to_numpy(zero_copy_only=False)
            ends = np.cumsum(held)
            run = np.cumsum(step)
            # The first step of a document is its place, so what was summed up before it goes.
            firsts = (ends - held)[held > 0]
            place = run - np.repeat(run[firsts] - step[firsts], held[held > 0])
            sums = []
            for v in (best, n):
                up = np.append(0, np.cumsum(times * v[place]))
                sums.append(up[ends] - up[ends - held])
            yield pa.RecordBatch.from_arrays([*docs.flatten(), *[pa.array(s) for s in sums]], names=["id", *_COUNTS, "groups_sha256", "n_best", "count_sum"])


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and is that the highest of its a id?"""
    seen = blocks.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", "p.pairs", "p.holders")
    salted = seen.groupBy("pairs", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("holders").alias("n"))
    counts = salted.groupBy("pairs").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pairs") / n_b).cast("long"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select(F.col("pairs").alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"))


def align(spark: SparkSession, docs: DataFrame, tokenizers: Tokenizers, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    ``space + text`` is encoded by the byte-level vocabulary (a) and the text by the piece model
    (b), which adds the space; strings of special tokens are plain text.  A null or empty text,
    and one that either side does not give back byte by byte, has no tokens: zeros and an empty
    digest.  Repeated rows count one by one; a null id is an id like others; an empty table gives
    an empty one.  No other column is read.  A text of any length is encoded whole, by one task."""
    small_batches(spark)
    kind = docs.schema[id].dataType
    long = T.LongType()
    told = T.StructType([T.StructField("id", kind), *[T.StructField(c, long) for c in _COUNTS], T.StructField("groups_sha256", T.StringType())])
    packed = [T.StructField(c, T.BinaryType()) for c in ("held", "steps", "times")]
    schema = T.StructType([T.StructField("block", long), T.StructField("docs", T.ArrayType(told)), *packed, T.StructField("pairs", T.ArrayType(long)), T.StructField("holders", T.ArrayType(long))])
    n_b = _n_pieces(tokenizers)
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    name = f"aligner {hashlib.sha256(tokenizers.byte_level + tokenizers.pieces + tokenizers.pattern.encode()).hexdigest()}"
    blocks = stage(spark, rows.mapInArrow(*lean(_blocks(spark.sparkContext.broadcast((tokenizers.byte_level, tokenizers.pattern, tokenizers.pieces)), name), schema)), "aligned")
    counts = stage(spark, pair_counts(blocks, n_b), "pairs")
    seen = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = seen.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    joined = blocks.select("block", "docs", "held", "steps", "times").join(known, "block", "left").drop("block")
    out = T.StructType([*told.fields, T.StructField("n_best", long), T.StructField("count_sum", long)])
    made = joined.mapInArrow(*lean(_sums, out))
    return made.select(F.col("id").alias(id), *_COUNTS, "n_best", "count_sum", "groups_sha256")


def _n_pieces(tokenizers: Tokenizers) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=tokenizers.pieces).get_piece_size()
