"""Each training-data operator against a brute-force version on a small fixture, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import bpe, chat, embedding_dedup, license_scan, mixing, quality, sharding, simhash, suffix_dedup, url_cascade
from tabweave.llm.common import rank_within
from tabweave.llm.graph import components
from tabweave.llm.queries import QUERIES, vocabulary

WORDS = "the of and to in that is was he for it with as his on be at by i this had not are but from".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(0, 50)) for i in r.integers(0, len(WORDS), n))


TEXTS = [prose(1, 300), prose(1, 300), prose(2, 30) + " " + prose(1, 120), prose(3, 40), None, "", " \n", "x", "The same line\nThe same line\n" + prose(4, 60), prose(5, 20000), "é" * 300 + prose(6, 90), "$$$ ### %%% " * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", "keep", i) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, size long")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def joined(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_quality(docs):
    found = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words_of(t)
        seen, again, spots = set(), 0, collections.defaultdict(list)
        for line in (t or "").split("\n"):
            if words_of(line):
                again += line in seen
                seen.add(line)
        for k in range(len(w) - 7):
            spots[tuple(w[k : k + 8])].append(k)
        covered = {k + j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(8)}
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), again, len(covered)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert found[3].kept and not found[4].kept and not found[11].kept
    assert found[3].lang == "en" and quality.quality_rules(docs.limit(0)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard_documents(spark, docs, 4).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.doc_id: r.size for r in rows}[4] == 1
    assert sharding.shard_documents(spark, docs.limit(0), 4).count() == 0


def test_ranks_of_hot_groups(spark):
    df = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    found = collections.defaultdict(list)
    for r in rank_within(spark, df, ["g"], ["o"]).collect():
        found[r.g].append((r.rank, r.o))
    for rows in found.values():
        rows.sort()
        assert [k for k, _ in rows] == list(range(len(rows))) and [o for _, o in rows] == sorted(o for _, o in rows)


def test_mixing(spark, docs):
    rows = mixing.mix_sources(spark, docs.drop("size"), mixing.word_count()).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r["size"] for r in rows)
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert set(target) == {"s0", "s1", "s2", None}
    again = mixing.mix_sources(spark, docs.drop("size"), mixing.word_count()).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix_sources(spark, docs.limit(0).drop("size"), mixing.word_count()).count() == 0


def test_budget_fit():
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(r.integers(1, 400, 60))
        counts = r.integers(1, 30, len(lengths))
        budget = int(r.integers(0, (lengths * counts).sum()))
        take = mixing.fit_budget(lengths, counts, budget, 1 << 10)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == budget


def test_simhash(spark, docs):
    from xxhash import xxh64_intdigest

    def brute(text):
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: brute(t) for i, t in enumerate(TEXTS)}
    near = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = joined(near, prints)
    found = simhash.digests(spark, docs).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert simhash.digests(spark, docs.limit(0)).count() == 0


def test_balls_find_every_pair(spark):
    base = 0x8123456789ABCDEF
    values = [base, base ^ 1 << 63, base ^ 3, base ^ 7, base ^ (1 << 40 | 1 << 63), base ^ 0xFF00]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    links = [(r.a, r.b) for r in simhash.link_classes(spark.createDataFrame(rows, "id long, fp long")).collect()]
    near = [(a, b) for a in range(6) for b in range(6) if (values[a] ^ values[b]).bit_count() <= 2]
    assert joined(links, range(6)) == joined(near, range(6))


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(200)]
    nodes = {n for e in links for n in e}
    want = {n: c for n, c in joined(links, nodes).items() if n != c}
    found = components(spark, spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r.node: r.component for r in found.collect()} == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 8))
    vectors = [(c + r.normal(size=8) * s).tolist() for c in centres for s in (0, 0.05, 0.1, 0.2, 0.4)]
    vectors += [vectors[0], vectors[0], [0.0] * 8, [float("nan")] + [1.0] * 7, None, [1.0, None] + [0.0] * 6, [1.0, 2.0], [2e30 * x for x in vectors[0]]]
    rows = [(i, v, None if i == 7 else i % 2) for i, v in enumerate(vectors)]
    rows += [(500 + i, (centres[0] + r.normal(size=8) * 0.02).tolist(), 1) for i in range(700)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in x for b in x if a != b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93]
    count, groups = collections.Counter(a for a, _ in links), joined(links, [i for i, _, _ in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for per in (20, 256):
        found = embedding_dedup.near_vectors(spark, df, per_pivot=per).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (count[i], groups[i], groups[i] == i) for i, _, _ in rows}
    assert embedding_dedup.near_vectors(spark, df.limit(0)).count() == 0


def test_urls(spark):
    rules = [url_cascade.parse_rule(v, k) for v, k in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/1?a#b", "http://a.example.com/en/", "http://example.com/en", "http://xexample.com/en/", "http://com", "http://com/", "ftp://q.net/es/x", "http://net?x/es/", "http://a.net/fr/#", "a://b://c.com/d", "http://a..com/en/"]
    urls += [f"http://h{i}.example.{t}/{p}/{i}" for i in range(300) for t, p in (("com", "en"), ("net", "es"), ("org", "fr"))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("old"))
    for r in url_cascade.filter_urls(spark, df, rules).collect():
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.key, best.verdict if best else "allow"), r.url
    assert url_cascade.filter_urls(spark, df.limit(0), rules).count() == 0


def test_bpe(spark, docs):
    import tiktoken

    ranks, pattern = vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    odd = ["x" * 3000, "a  b'r" + "e" * 40 + " \n\n  'll" * 200, " " * 2000 + "z", "'re" * 900 + "  \t", "x'", "don't " * 300, "日本語 12٣  " * 100, "\u0558\u058b 1" * 90]
    for n, cut, overlap in ((len(TEXTS), 32_768, 512), (4, 97, 11)):
        texts = TEXTS[:n] + odd
        df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
        tokens = bpe.decode(bpe.encode(spark, df.select("doc_id", "text"), ranks, pattern, chunk_chars=cut, overlap=overlap), ranks).collect()
        assert {r.doc_id: r.ids for r in tokens} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
        assert {r.doc_id: bytes(r.decoded) for r in tokens} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.digests(spark, docs.limit(0), ranks, pattern).count() == 0


def test_chat(spark):
    hard = ["\\", "###", "####", "##", "<|image:0|>", "</turn>", "</turn>\n", "<</turn>\n", "a: b", "\\### Assistant: </turn> ok", "", None, "<", "|", "\\\\###\\<|"]
    rows = [(1, i, ("user", "assistant", "a:b\\", None)[i % 4], t) for i, t in enumerate(hard)] + [(2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(spark, df).collect()}
    for conv in (1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in sorted(rows, key=lambda x: x[1]) if c == conv]
        said = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
        assert (found[conv].n_turns, found[conv].turns_sha256, found[conv].loss_chars, found[conv].loss_sha256) == want
    assert found[-7].n_turns == 2


def test_chat_parts():
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    made = chat.format_turns([("user", [part("text", text="see #"), part("text", text="##"), part("image", ref="a.png", width=28, height=15), part("document", ref="b.pdf", pages=2)]), ("assistant", [part("audio", ref="c.wav", seconds=1.0), part("text", text="ok")])])
    assert [(a["kind"], a["ref"], a["number"], a["tokens"]) for a in made["attachments"]] == [("image", "a.png", 0, 4), ("document", "b.pdf", 1, 1024), ("audio", "c.wav", 2, 25)]
    assert chat.parse_turns(made["formatted"]) == [("user", "see ###"), ("assistant", "ok")]
    assert [made["formatted"][x["start"] : x["end"]] for x in made["loss"]] == ["ok"]


def test_licenses(spark):
    texts = TEXTS + ["CC-BY cc by by\nAll rights\nreserved.", "x\nReleased under the  MIT License.\ny", "This work is licensed under the GNU General Public License, version 3.", "licensed under the apache license version 2.0 " + prose(9, 50)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark, df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            places = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        blocks = [set(license_scan.words_of(b)) for b in license_scan.blocks_of(t or "")]
        for label, text in license_scan.TEMPLATES:
            ref = set(license_scan.words_of(text))
            share = max((len(b & ref) / len(ref) for b in blocks), default=0)
            if share >= 0.9:
                labels.add(label)
        assert r.labels == ",".join(sorted(labels))
    assert license_scan.scan_licenses(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 256])
def test_suffixes(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    long = prose(7, 1200)
    texts = TEXTS + ["ab" * 300, "y" * 200, "z" * 201, "q" + long[100:420] + "r" + long[1000:1300], long[300:620] + long[1050:1251], long[3000:3100] * 4, "k" + long[4000:4200], long[4000:4200]]
    texts += [prose(100 + i, 20) + long[1500 : 1690 + 5 * i] + prose(300 + i, 15) for i in range(40)]
    rows = list(enumerate(texts)) + [(0, TEXTS[0])]
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.digests(spark, df).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert suffix_dedup.digests(spark, df.limit(0)).count() == 0


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([prose(k // 2, 80) for k in range(24)] + ["too short", "$$ ## %% && " * 30])]
    start = spark.createDataFrame([*rows, (None, prose(50, 80), "en", "s0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    frame = start
    counts = []
    for _, step in corpus_pipeline.STAGES:
        frame = step(spark, frame, "")
        counts.append(frame.count())
        assert set(start.columns) <= set(frame.columns)
    assert counts[0] == 25 and counts[1] == 13 and counts[2] == 13
    last = frame.collect()
    assert all(r.n_tokens == len(r.ids) > 0 for r in last)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, start.limit(0), "").count() == 0
