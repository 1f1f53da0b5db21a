"""Ranked lexical search: WAND over document shards, whose heaps are merged.

1. One pass over the documents keeps, of each, the number of its terms and how often it holds
   terms of the queries (the forward lists); document counts of terms and lengths are summed up.
2. Each shard (what one task reads, in blocks of bounded size) turns its lists round and knows the
   largest impact of each term.  For each query, documents are visited in blocks: terms whose
   largest impacts together stay below the heap's threshold cannot make a pivot, so their lists
   are skipped; a document is a pivot if the largest impacts of the terms it may hold together
   reach the threshold, and only pivots are scored, term by term, until they fall behind.
3. The heaps of all shards are merged by rank, in two steps.

Scores are whole numbers, so the result does not depend on shards or their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, small_batches, stage, text_of, unstage

#: Bytes of query text that are searched in one pass over the forward lists.
QUERY_BYTES = 8 << 20
#: Postings that a task holds at a time.
SHARD_POSTINGS = 1 << 21
#: Documents of the first block that a query visits, and of the largest.
FIRST_BLOCK, LAST_BLOCK = 1 << 9, 1 << 15
#: Ways in which the heaps of a query are dealt before they are merged.
SALTS = 16
#: ASCII letters in lower case, digits and all bytes of other characters; the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: maximal runs of ASCII letters and digits and of any other
    characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def _query_blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(item ids, terms of each) of blocks of the queries, ``QUERY_BYTES`` of text at most (or one)."""
    ids, found, size = [], [], 0
    for row in items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        terms = sorted(set(terms_of(row.t)))
        size += sum(map(len, terms))
        if found and size > QUERY_BYTES:
            yield ids, found
            ids, found, size = [], [], sum(map(len, terms))
        ids.append(row.i)
        found.append(terms)
    if found:
        yield ids, found


def _forward(vocabulary):
    """Number of terms of each document, and terms of the queries with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for b in batches:
            texts = b.column(1)
            lengths, docs, terms = np.zeros(b.num_rows, np.int64), [], []
            for i in range(b.num_rows):
                words = terms_of(texts[i].as_py())
                lengths[i] = len(words)
                known = np.fromiter((k for w in words if (k := number(w)) is not None), np.int64)
                docs.append(np.full(len(known), i, np.int64))
                terms.append(known)
            doc, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, terms))
            pairs, counts = np.unique(doc << 32 | term, return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) << 32).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, counts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), *lists], names=["id", "n", "terms", "counts"])

    return run


def term_weights(n_docs: int, df: dict[int, int], n_terms: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_terms)], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score; whole numbers, division rounds down."""
    scaled = np.array([50 * int(x) * n_docs // total for x in n], np.int64) if len(n) and 50 * n_docs * int(n.max()) >= 2**63 else 50 * n * n_docs // max(total, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + scaled)))


class Shard:
    """Postings of some documents, turned round: of each term its documents in order, what it
    adds to each, and the most that it adds to any."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, added: np.ndarray, n_docs: int):
        self.n_docs = n_docs
        some = added > 0
        order = np.argsort(terms[some], kind="stable")
        self.docs, self.added = docs[some][order], added[some][order]
        self.terms, first = np.unique(terms[some][order], return_index=True)
        self.starts = np.append(first, len(self.docs))
        self.most = np.maximum.reduceat(self.added, first) if len(first) else np.zeros(0, np.int64)

    def lists(self, terms: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(largest impact, documents, impacts) of each term that stands here, smallest first."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (np.append(self.terms, -1)[at] == terms)]
        at = at[np.argsort(self.most[at], kind="stable")]
        return [(int(self.most[k]), self.docs[self.starts[k] : self.starts[k + 1]], self.added[self.starts[k] : self.starts[k + 1]]) for k in at]


class Heap:
    """The k best documents so far: highest scores first, equal ones by ascending id (null last)."""

    def __init__(self, k: int, kind: pa.DataType):
        self.k, self.table = k, pa.table({"score": pa.array([], pa.int64()), "id": pa.array([], kind)})

    @property
    def threshold(self) -> int:
        """Scores below it cannot enter; equal ones may, by their id."""
        return self.table["score"][self.k - 1].as_py() if self.table.num_rows == self.k else 1

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        both = pa.concat_tables([self.table, pa.table({"score": pa.array(scores, pa.int64()), "id": ids})])
        best = pc.sort_indices(both, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")
        self.table = both.take(best[: self.k]).combine_chunks()


def wand(shard: Shard, terms: np.ndarray, ids: pa.Array, heap: Heap) -> int:
    """Bring what a shard has for a query into its heap; returns how many documents were scored."""
    lists, low, width, scored = shard.lists(terms), 0, FIRST_BLOCK, 0
    within = np.cumsum([m for m, _, _ in lists], dtype=np.int64)
    while low < shard.n_docs and lists:
        high, threshold = min(low + width, shard.n_docs), heap.threshold
        skipped = int(np.searchsorted(within, threshold))  # with these terms alone no document is a pivot
        if skipped == len(lists):
            return scored
        rest = int(within[skipped - 1]) if skipped else 0
        bound, score = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
        for most, docs, added in lists[skipped:]:
            part = slice(*np.searchsorted(docs, (low, high)))
            bound[docs[part] - low] += most
            score[docs[part] - low] += added[part]
        pivots = np.flatnonzero((bound > 0) & (bound + rest >= threshold))
        scored += len(pivots)
        total = score[pivots]
        pivots += low
        for most, docs, added in reversed(lists[:skipped]):
            alive = total + rest >= threshold
            pivots, total = pivots[alive], total[alive]
            if not len(pivots):
                break
            at = np.minimum(np.searchsorted(docs, pivots), len(docs) - 1)
            total = total + np.where(docs[at] == pivots, added[at], 0)
            rest -= most
        kept = total >= threshold
        if kept.any():
            heap.add(total[kept], ids.take(pa.array(pivots[kept])))
        low, width = high, min(2 * width, LAST_BLOCK)
    return scored


def _search(shared, k: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, total = shared.value
        heaps = [Heap(k, kind) for _ in queries]
        held: list[pa.RecordBatch] = []

        def visit() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, n = table["id"].combine_chunks(), table["n"].to_numpy()
            listed = table["terms"].combine_chunks()
            docs = np.repeat(np.arange(table.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            terms, tf = (x.flatten().to_numpy().astype(np.int64) for x in (listed, table["counts"].combine_chunks()))
            shard = Shard(docs, terms, impacts(weights[terms], tf, n[docs], n_docs, total), table.num_rows)
            for terms_of_query, heap in zip(queries, heaps, strict=True):
                wand(shard, terms_of_query, ids, heap)

        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(b.schema.get_field_index("terms")).flatten())
            if size >= SHARD_POSTINGS:
                visit()
                size = 0
        visit()
        for place, heap in enumerate(heaps):
            if heap.table.num_rows:
                t = heap.table
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, place, np.int32)), t["id"].combine_chunks(), t["score"].combine_chunks()], names=["query", "id", "score"])

    return run


def _best(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each query; heaps are merged within salts first, so that no task has to
    take in the heaps of all shards of a query."""
    rank = lambda *groups: F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    dealt = heaps.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    some = dealt.withColumn("rank", rank("query", "salt")).filter(F.col("rank") <= k).drop("rank", "salt")
    return some.withColumn("rank", rank("query")).filter(F.col("rank") <= k)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``item``, rank int, ``id``, score long): of each item the ``k`` documents with the
    highest scores above 0, equal scores by ascending id (a null id last).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), N the documents with terms and df
    those that hold it; a document's score adds, for each term of the item once, the weight
    times (10^9 tf) div (1000 tf + 20 m), where m = 50 + (50 n N) div L, n is the document's
    terms and L those of all.  Documents and items with a null or empty text have no terms and
    appear in no result; repeated documents and items count and are ranked one by one; without
    documents or items the result is empty.  Columns but the four named are not read.

    Queries are held by the driver in blocks of ``QUERY_BYTES``, with one pass over the documents
    for each; a heap holds ``k`` documents of a query in each task."""
    small_batches(spark)
    kind = docs.schema[id].dataType
    out_schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    forward_schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts")]])
    made = None
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    for names, wanted in _query_blocks(items, item, item_text):
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in wanted for t in terms}))}
        forward = stage(spark, rows.mapInArrow(*lean(_forward(spark.sparkContext.broadcast(vocabulary)), forward_schema)), "forward")
        n_docs, total = forward.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        queries = [np.array([vocabulary[t] for t in terms], np.int64) for terms in wanted]
        shared = spark.sparkContext.broadcast((queries, term_weights(n_docs, df, len(vocabulary)), n_docs, total))
        shards = forward.filter(F.size("terms") > 0)
        heaps = stage(spark, shards.mapInArrow(*lean(_search(shared, k, _arrow_kind(forward)), out_schema)), "heaps")
        unstage(spark, forward)
        found = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", items.schema[item].dataType)]))
        best = _best(heaps, k).join(F.broadcast(found), "query").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
        made = best if made is None else made.unionByName(best)
    if made is None:
        made = spark.createDataFrame([], T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id, kind), T.StructField("score", T.LongType())]))
    return made


def _arrow_kind(forward: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(forward.schema["id"].dataType)
