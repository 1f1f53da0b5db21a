"""Faults that were found in operators, each with what has to hold now."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import chat, embedding_dedup, license_scan, mixing, quality, sharding, simhash, url_cascade


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_balls_of_any_radius(spark, radius):
    r = random.Random(radius)
    values = {0, -1}
    for _ in range(12):
        base = r.getrandbits(64) - (1 << 63)
        for _ in range(6):
            turned = base
            for bit in r.sample(range(64), r.randint(0, 5)):
                turned ^= -(1 << 63) if bit == 63 else 1 << bit
            values.add(turned)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    found = {(x.a, x.b) for x in simhash.link_classes(spark.createDataFrame(rows, "id long, fp long"), radius).collect()}
    near = {(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert found <= near

    def groups(links):
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in sorted(links):
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(rows))]

    assert groups(found) == groups(near)


def test_the_url_plan_does_not_grow_with_the_rules(spark):
    def nodes(lengths):
        keys = url_cascade.candidate_keys(F.col("host"), F.col("path"), [1, 2, 3, 4, 5], lengths)
        return spark.createDataFrame([("a.b.c", "/x/y")], "host string, path string").select(keys.alias("k"))

    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(nodes(list(range(60)))) < 3 * size(nodes([1]))
    assert nodes([0, 2, 9]).first().k == ["a.b.c/x", "a.b.c", "b.c/x", "b.c", "c/x", "c"]


def test_unknown_parts_are_kept(spark):
    parts = [{"type": "video", "text": "a clip", "ref": "v1"}, {"type": None, "text": "x"}, {"type": "visit", "text": None, "ref": "r2"}]
    rows = spark.createDataFrame([(1, 0, "user", [{**dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages")), **p} for p in parts])], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    made = chat.format_conversations(rows).first()
    assert [(a.kind, a.ref, a.tokens) for a in made.attachments] == [("video", "v1", 1), ("visit", "r2", 1)]
    assert made.formatted == "### user: <|other:0|>a clipx<|other:1|></turn>\n"
    assert chat.parse_turns(made.formatted) == [("user", "a clipx")]


def test_names_do_not_clash(spark):
    names = ("_source", "_null", "_hash", "_rank", "_pid", "_local", "_first", "_keys", "_rule", "_h1", "_marked", "_measures", "_repeats")
    docs = spark.createDataFrame([(i, f"one two {'x ' * i}", f"s{i % 2}", "http://example.com/en/a") for i in range(9)], "doc_id long, text string, source string, url string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for made in (mixing.mix_sources(spark, docs, mixing.word_count()), quality.quality_rules(docs), url_cascade.filter_urls(spark, docs, [url_cascade.parse_rule("block", "example.com/en/")])):
        rows = made.collect()
        assert len(rows) == 9 and all(r[n] == n for r in rows for n in names)
    assert sharding.shard_documents(spark, docs).count() == 9


def test_license_parts_are_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n\n".join(t for _, t in license_scan.TEMPLATES[i : i + 1]) or "nothing") for i in range(len(license_scan.TEMPLATES) + 1)], "doc_id long, text string")
    want = sorted(map(tuple, license_scan.scan_licenses(spark, docs).collect()))
    monkeypatch.setattr(license_scan, "MAX_TEMPLATE_BYTES", 1)
    made = license_scan.scan_licenses(spark, docs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, made.collect())) == want
    index = license_scan.TemplateIndex(license_scan.TEMPLATES[:1], license_scan.word_frequencies(docs, license_scan.TEMPLATES), 0.9)
    assert set(index.order) == set(license_scan.words_of(license_scan.TEMPLATES[0][1]))


def test_vectors_by_pivots_are_bounded():
    rng = np.random.default_rng(0)
    at = rng.standard_normal((embedding_dedup.MAX_PIVOTS, 16))
    pivots = embedding_dedup.Pivots({"p": (np.arange(len(at)), at / np.linalg.norm(at, axis=1, keepdims=True))}, 0.93)
    x = rng.standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    step = pivots.rows_at_once("p")
    found = [pivots.visits("p", x[k : k + step], None)[0] for k in range(0, len(x), step)]
    assert sum(map(len, found)) > 0 and step * 5 * 8 * len(at) <= embedding_dedup.MATRIX_BYTES
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10
    assert embedding_dedup._most(4096) * 8 * 4096 <= embedding_dedup.CHUNK_BYTES and embedding_dedup._most(64) == embedding_dedup.MOST_CHUNK
