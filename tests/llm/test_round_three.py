"""Alignment, search and the classifier against plain versions of what they compute."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import compression_classifier, lexical_search, queries, token_alignment

SF = "/root/testdata/sf0.001"
WORDS = "the of and stone river light over under green slow quick paper wolf".split()


# Token alignment.


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by their own libraries: (bytes of a's ids, encode a, bytes of b's ids, encode b)."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    return lambda i: bytes(letters[c] for c in a.id_to_token(i)), lambda t: a.encode(f" {t}", add_special_tokens=False).ids, bytes_b, b.encode


def groups_of(text, plain):
    bytes_a, encode_a, bytes_b, encode_b = plain
    if not text:
        return []
    sides = []
    for ids, token in ((encode_a(text), bytes_a), (encode_b(text), bytes_b)):
        if b"".join(map(token, ids)) != b" " + text.encode():
            return []
        ends, at = [], 0
        for i in ids:
            at += len(token(i))
            ends.append((at, i))
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    return [tuple([i for e, i in side if low < e <= high] for side in sides) for low, high in zip([0, *cuts], cuts)]


def expected_alignment(texts, plain):
    found = [groups_of(t, plain) for t in texts]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in found]
    held = Counter(p for each in links for p in set(each))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for groups, each in zip(found, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(each), sum(held[p] == most[p[0]] for p in each), sum(held[p] for p in each), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


def aligned(spark, rows, schema="doc_id long, text string"):
    made = token_alignment.align(spark, spark.createDataFrame(rows, schema), queries.tokenizers())
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(((r.doc_id, *(r[c] for c in names)) for r in made.collect()), key=repr)


def test_alignment_matches_a_plain_version(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    odd = ["", None, "a", " ", "  two  blanks ", "<|endoftext|> and <s>", "▁ is no blank", "日本語のテキスト 🙂🙃 naïve", "aaaa" * 500, "\x00\x01\r\n\t", "é" * 300 + "x"]
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(20_000, docs[0].text)] * 2
    want = expected_alignment([t for _, t in rows], plain)
    assert aligned(spark, rows) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_alignment_does_not_depend_on_blocks(spark, plain, monkeypatch):
    rows = [(i, " ".join(WORDS[(i * k) % 13] for k in range(40))) for i in range(30)]
    want = aligned(spark, rows)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 300)
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 700)
    monkeypatch.setattr(token_alignment, "LINKS", 7)
    assert aligned(spark, rows) == want == sorted(((i, *w) for (i, _), w in zip(rows, expected_alignment([t for _, t in rows], plain))), key=repr)


def test_alignment_of_wide_groups_and_edges(spark):
    pair = token_alignment.Pair(queries.tokenizers())
    # Tokens without a common cut: one group of all; equal ids are unfolded once.
    pair.a.encode, pair.b.encode = (lambda texts: [[0] * 200_001 for _ in texts]), (lambda texts: [[0] + [1] * 200_000 for _ in texts])
    pair.a.bytes_of, pair.a.lengths = [b"xx"], np.array([2])
    pair.b.bytes_of, pair.b.lengths = [b"x", b"xx"], np.array([1, 2])
    text = "x" * 400_002
    pair.a.bytes_of[0] = b"xx"
    found = token_alignment.align_texts(pair, [text])
    assert found.counts[:, 0].tolist()[:2] == [0, 0]  # the bytes differ: no tokens
    assert token_alignment.align_texts(pair, []).digests == []
    assert aligned(spark, []) == []
    extra = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, pairs string, block int")
    assert token_alignment.align(spark, extra, queries.tokenizers()).count() == 1
    assert aligned(spark, [(None, "one two"), (None, None)])[0][0] is None


# Lexical search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected_search(docs, items, k=50):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in terms if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            scores += [(-s, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(spark, docs, items, k=50):
    made = lexical_search.search(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in made.collect())


def test_search_matches_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(3)
    weights = 1 / np.arange(1, 14)
    docs = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 60), p=weights / weights.sum()))) for i in range(900)]
    docs += [(5000 + i, docs[7][1] + " Wolf") for i in range(120)] + [(6000, None), (6001, ""), (6002, "!!"), (6003, "naïve ÉTÉ Wolf")]
    items = [(1, "the wolf under the paper"), (2, "QUICK green, slow"), (3, None), (4, "absent"), (5, "naïve"), (6, " ".join(WORDS))]
    want = expected_search(docs, items)
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 500)
    monkeypatch.setattr(lexical_search, "FIRST_BLOCK", 8)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 20)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, 3) == expected_search(docs, items, 3)


def test_pivots_are_a_part_of_the_documents():
    """A document that only frequent terms name is not scored once the heap is full of better ones."""
    import pyarrow as pa

    n = 20_000
    docs, terms = np.concatenate([np.arange(n), np.arange(0, n, 100)]), np.concatenate([np.zeros(n, np.int64), np.ones(n // 100, np.int64)])
    order = np.argsort(docs, kind="stable")
    shard = lexical_search.Shard(docs[order], terms[order], np.where(terms[order] == 1, 1000, 5), n)
    heap = lexical_search.Heap(50, pa.int64())
    scored = lexical_search.wand(shard, np.array([0, 1]), pa.array(range(n)), heap)
    assert scored < n // 2 and heap.table["score"].to_pylist() == [1005] * 50 and heap.table["id"].to_pylist() == list(range(0, 5000, 100))


def test_search_edges(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], [])
    assert searched(spark, [(1, "a b")] * 3 + [(2, "c")] * 9, [(1, "a"), (1, "a")])[:2] == [(1, 1, 1, expected_search([(1, "a b")] * 3 + [(2, "c")] * 9, [(1, "a")])[0][3])] * 2
    docs = spark.createDataFrame([(None, "wolf", 1), (4, "wolf", 2), (9, "stone", 3), (10, "stone", 3), (11, "river", 3)], "doc_id long, text string, score int")
    found = lexical_search.search(spark, docs, spark.createDataFrame([(1, "wolf")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [4, None]


def test_search_on_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    made = queries.op12_lexical_search(spark, SF).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in made) == expected_search(docs, items)


# Quality classifier.


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    made = queries.op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in made) / len(made)
    good, bad = [r.score for r in made if r.quality == 1], [r.score for r in made if r.quality == 0]
    above = sum(g > b for g in good for b in bad) / len(good) / len(bad)
    kept = sum(r.predicted for r in made if r.quality == 1) / len(good)
    assert right >= 0.97 and above >= 0.99 and kept >= 0.99
    # Calibrated: scores add up to about the good rows.
    assert abs(sum(good) + sum(bad) - len(good)) < 0.05 * len(made)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in made)


def labelled(spark, n=600):
    good, bad = " ".join(WORDS), "%%% ### &&& $$$ !! "
    rows = [(i, f"{good[i % 40:]} {i} {good}" * 6 if i % 3 else f"{bad * (5 + i % 7)} {i} {bad}" * 4) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_nothing_is_learnt_from_held_out_rows(spark):
    docs, labels = labelled(spark)
    want = compression_classifier.fit(spark, docs, labels)
    assert want.good and want.bad and want.slope > 0
    turned = labels.withColumn("quality", F.when(compression_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_classifier.fit(spark, docs.repartition(5), turned) == want


def test_classifier_edges(spark):
    docs, labels = labelled(spark)
    more = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (None, "stone river"), (9003, "wolf " * 200_000), (3, "again")], docs.schema)).withColumn("score", F.lit("x")).withColumn("_tw_x", F.lit(1))
    rows = compression_classifier.classify(spark, more, labels).collect()
    assert len(rows) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[9001].score == by[9002].score and by[1].predicted == 1 and by[0].predicted == 0
    one_class = compression_classifier.classify(spark, docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(one_class) == 1 and one_class[0].score > 0.5
    nothing = compression_classifier.classify(spark, docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in nothing] == [0.5]
    assert compression_classifier.classify(spark, docs.limit(0), labels.limit(0)).count() == 0
