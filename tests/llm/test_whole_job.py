"""What a review found missing: each test failed before its finding was settled."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tabweave.llm import quality, shingles


def words(seed, n):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, 10**6, n)]


def jaccard(a, b, width=5):
    a, b = ({tuple(t.lower().split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def near_texts():
    out = []
    for g in range(12):
        base = words(g, 60 + 17 * g)
        for k in range(5):
            r, new = np.random.default_rng(1000 * g + k), list(base)
            for i in r.integers(0, len(new), k):
                new[i] = f"x{r.integers(0, 10**6)}"
            out.append(" ".join(new))
    return [*out, out[0].upper(), "a b", "A  b", "a c"]


def test_near_links_are_those_of_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes, links = shingles.near_classes(spark, docs)
    name = {r.c: (r.h1, r.h2) for r in classes.collect()}
    found = {frozenset((name[r.a], name[r.b])) for r in links.collect()}
    names = [shingles.set_name(shingles.shingle_set(t)) for t in texts]
    want = {frozenset((m, n)) for (m, s), (n, t) in itertools.combinations(zip(names, texts, strict=True), 2) if m != n and jaccard(s, t) >= 0.8}
    assert want and found == want


def test_pipeline_drops_near_copies(spark):
    base = words(1, 200)
    near, far = [*base], [*base]
    near[100:103] = "x", "y", "z"
    far[::20] = ["q"] * 10
    texts = [" ".join(w) for w in (base, near, far)]
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_rows_that_share_a_key_are_judged_one_by_one(spark):
    one, two, three = (" ".join(words(i, 40)) for i in (1, 2, 3))
    rows = [(7, one), (7, two), (7, two), (42, three), (None, None), (None, two), (3, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {(3, one), (7, two), (42, three), (None, None)}


def test_pipeline_rejects_menus_and_texts_without_running_prose(spark):
    prose = ["the" if i % 6 == 0 else w for i, w in enumerate(words(4, 300))]
    texts = {
        "prose": ("en", " ".join(prose)),
        "menu": ("en", " ".join(f"item{i} |" for i in range(60))),
        "list": ("en", "the " + " ".join(words(5, 300))),
        "other": ("fi", " ".join(words(6, 300))),
        "none": (None, " ".join(words(7, 300))),
    }
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in texts.items()], "doc_id string, lang string, text string")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert kept == {"prose", "other"}


def test_windows_repeat_by_their_words_not_their_hashes(spark):
    m = "m" * 24
    one, two = f"jN_7Q,:;{m}iB2xjIm5{m}", f"faAyDV;i{m}?(kuX1;b{m}"
    hashes = spark.createDataFrame([(one, two)], "a string, b string").select(F.xxhash64("a") == F.xxhash64("b")).first()
    assert one != two and hashes[0]
    rest, fill = " ".join(words(8, 7)), " ".join(words(9, 20))
    texts = [f"{one} {rest} {fill} {two} {rest}", f"{one} {rest} {fill} {one} {rest}", f"{one} {rest} {two} {rest} {fill} {one} {rest} {two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect()}
    assert found == {0: (0, False), 1: (16, True), 2: (18, True)}


def test_an_ellipsis_ends_its_line(spark):
    ends = ["", " ", "\t\r", "\u2028", "\u2029", "\u0085", " \u2028"]
    lines = [f"w{i} w{i}a w{i}b" for i in range(12)]
    texts = ["\n".join(x + dots + end for x in lines) for end in ends for dots in ("...", "\u2026")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.quality_rules(docs).collect() if r.failed_rules) == [0, 1, 2, 3, 4, 5]
