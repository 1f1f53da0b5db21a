"""Operators at the borders of their bounds, and rows that share a key."""

import collections
import re
import zlib

import numpy as np

from pyspark.sql import functions as F

from tabweave.llm import embedding_dedup, license_scan, mixing, sharding, shingles, suffix_dedup, url_cascade


def test_rows_that_share_a_vec_id(spark):
    rows = [(1, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [1.0, 0.01], 7), (3, [0.01, 1.0], 7), (3, [0.01, 1.0], 7), (None, [1.0, 0.0], 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    found = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark, df).collect())
    assert found == {(1, 1, 1, True): 1, (1, 2, 1, True): 1, (2, 1, 1, False): 1, (3, 2, 1, False): 2, (None, 0, None, False): 1}


def test_labels_without_pivots_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_CHUNK", 64)
    monkeypatch.setattr(embedding_dedup, "LEAST_CHUNK", 16)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=3).tolist(), i % 2) for i in range(600)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.arange(600)[:, None] % 2 == np.arange(600)[None, :] % 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for per_pivot in (600, 300, 10):  # one pivot at most, so one label has none; then more
        found = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark, df, per_pivot=per_pivot).collect()}
        assert found == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}


def test_pivots_are_halved_where_they_do_not_prune():
    r = np.random.default_rng(4)
    blind = [("a", v.tolist()) for v in r.normal(size=(1200, 64))]
    assert sum(len(c) for c, _ in embedding_dedup.choose_pivots(blind[:400], blind[400:], 0.93).values()) <= 25
    centres = r.normal(size=(40, 64))
    clear = [("a", (centres[i % 40] + r.normal(size=64) * 0.01).tolist()) for i in range(1000)]
    assert sum(len(c) for c, _ in embedding_dedup.choose_pivots(clear[:40], clear[40:], 0.93).values()) == 40


def test_url_rules_beyond_one_cascade(spark, monkeypatch):
    rules = [url_cascade.Rule(f"h{i}.org", f"/p{i % 7}/", "allow" if i % 3 else "block") for i in range(400)]
    rules += [url_cascade.Rule("org", "/p1/", "block"), url_cascade.Rule("rg", "", "allow"), url_cascade.Rule("h5.org", "", "allow")]
    urls = [f"http://a.h{i}.org/p{i % 5}/{'x' * (i % 50)}" for i in range(1500)] + ["http://" + "a." * 3000 + "h5.org/" + "y" * 50_000, None, "http://h5.org", "http://rg/q", "http://x.org/p1/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def judged(given):
        return {r.page_id: (r.rule, r.verdict) for r in url_cascade.filter_urls(spark, pages, given).drop("url").collect()}

    whole = judged(rules)
    for i, u in enumerate(urls):
        host, _, path = (u or "").partition("://")[2].partition("/")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and ("/" + path if "/" in (u or "")[8:] else "").startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
        assert whole[i] == ((best.key, best.verdict) if best else (None, "allow")), u
    monkeypatch.setattr(url_cascade, "MAX_FILTER_BYTES", 200)
    assert url_cascade.slices_for(403, 5000) > 2
    assert judged(spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")) == whole
    assert url_cascade.filter_urls(spark, pages, []).filter("rule is null and verdict = 'allow'").count() == len(urls)


def plain_words(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def plain_share(text, template):
    """Containment of a template in a text's best block, written without the operator's code."""
    cut = lambda t: [p for p in re.split(r"\n[^\S\n]*\n", t) if p.strip()]
    paragraphs, n = cut(text), len(cut(template))
    blocks = text.split("\n") + [" ".join(paragraphs[i : i + n]) for i in range(max(1, len(paragraphs) - n + 1))]
    want = plain_words(template)
    return max(len(plain_words(b) & want) / len(want) for b in blocks)


def test_license_templates_of_several_paragraphs(spark, monkeypatch):
    full = {label: text for label, text in license_scan.TEMPLATES}  # the last text of each label
    notices = [text for _, text in license_scan.TEMPLATES]
    texts = notices + ["Intro.\n\n" + full["bsd"] + "\n\nOutro", full["zlib"].replace(" ", "\n", 30), full["isc"].upper(), full["unlicense"].split("\n\n")[0], "", "words " * 3000 + full["lgpl"]]
    texts += ["\n\n".join(t.split("\n\n")[:-1]) for t in notices]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*texts, None])], "doc_id long, text string, labels string")

    def scanned():
        return {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan_licenses(spark, df, phrases=()).collect()}

    found = scanned()
    for i, t in enumerate([*texts, ""]):
        shares = [(label, plain_share(t, text)) for label, text in license_scan.TEMPLATES]
        want = {label: s for label, s in shares if s >= 0.9}
        assert found[i] == (",".join(sorted(want)), round(max((s for _, s in shares if s >= 0.9), default=0), 9)), t
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[i][0].split(",")
    monkeypatch.setattr(license_scan, "MAX_TEMPLATE_BYTES", 2000)
    assert len(license_scan.template_parts(license_scan.TEMPLATES)) > 3 and scanned() == found


def test_groups_of_near_copies_are_those_of_brute_force(spark):
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in r.integers(0, 10**6, 150)]
    texts = []
    for k in range(60):  # one group whose members are near to its centre, and often not to each other
        new = list(base)
        for i in r.integers(0, 150, k % 6):
            new[i] = f"x{k}{i}"
        texts.append(" ".join(new))
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join([f"y{k}{i}" for i in range(5 + k % 9)] + passage + [f"z{k}{i}" for i in range(k % 7)]) for k in range(40)]
    texts += [" ".join(base[: 150 - k]) for k in range(0, 60, 7)] + [texts[3], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [frozenset(tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else frozenset() for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {root(i) for i in range(len(texts))}
    assert {r.doc_id for r in shingles.keep_one(spark, docs).collect()} == want and len(want) == 62


def test_shards_hold_every_source_in_its_share(spark):
    rows = [(i, None if i % 50 == 0 else "big" if i % 3 else f"s{i % 5}", f"text {i % 40} é", "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, shard string").repartition(7)
    found = sharding.shard_documents(spark, docs).collect()
    text = {i: t for i, _, t, _ in rows}
    assert {r.law for r in found} == {"rows"} and sorted(r.doc_id for r in found) == list(range(3000))
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 1 for r in found)
    counts = collections.Counter(r.shard for r in found)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    for source, n in collections.Counter(r.source for r in found).items():
        per = collections.Counter(r.shard for r in found if r.source == source)
        assert all(abs(per[s] - n / 16) <= 2 for s in range(16)), source
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = sharding.interleaved_shards(spark, docs, "source", ["doc_id"], 4)
    assert again.columns.count("shard") == 1 and {r.shard for r in again.select("shard").collect()} == {0, 1, 2, 3}


def plain_targets(sizes):
    """Targets of the mix, written without the operator's code."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = {n: weight[n] for n in names if n not in fixed}
        now = {n: rest * w / sum(free.values()) for n, w in free.items()}
        over = {n: 3.0 * sizes[n] for n in now if now[n] > 3 * sizes[n] * (1 + 1e-12)}
        if not over:
            return fixed | now
        fixed |= over


def test_mix_meets_its_targets(spark):
    r = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else ("a", "a", "b", "c", "d", "ü")[int(r.integers(0, 6))] if i % 9 else "tiny", " ".join(["w"] * int(r.integers(0, 90)))) for i in range(1500)]
    rows += [(9000, "empty", None), (9001, "empty", "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix_documents(spark, docs).collect()
    words = {i: len((t or "").split()) for i, _, t in rows}
    sizes = collections.Counter()
    for i, s, _ in rows:
        sizes[s] += words[i]
    target, taken = plain_targets(sizes), collections.Counter()
    assert len(found) == len(rows)
    for x in found:
        assert x["size"] == words[x.doc_id] and x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 * max(1, target[x.source])
        assert 0 <= x.taken <= 3 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0)
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert {(x.doc_id, x.taken) for x in mixing.mix_documents(spark, docs.repartition(3)).collect()} == {(x.doc_id, x.taken) for x in found}


def test_budgets_are_fitted_on_both_sides_of_the_greedy_border():
    lengths, counts = np.array([1, 7, 50, 300]), np.array([400, 300, 200, 100])
    for fit_words in (1, 40, 1000, 1 << 20):
        for budget in (0, 1, 999, 20_000, int((lengths * counts).sum()) - 1):
            take = mixing.fit_budget(lengths, counts, budget, fit_words)
            assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() == budget


def test_suffixes_on_both_sides_of_the_hot_border(spark, monkeypatch):
    r = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 7))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(12)) + passage[k : 215 + 2 * k] + " ".join(word() for _ in range(12)) for k in range(24)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])] + list(enumerate(texts[4:]))
    seen = collections.Counter(t.encode()[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    want = collections.Counter()
    for i, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone.update(range(p, p + 200))
        want[(i, len(b), len(gone), bytes(x for k, x in enumerate(b) if k not in gone))] += 1
    docs = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, n_spans string")
    results = []
    for border in (1, 23, 24, 25, 26, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", border)
        found = suffix_dedup.remove_repeats(spark, docs.drop("n_spans") if border == 1 else docs).collect()
        results.append(collections.Counter((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), bytes(x.kept)) for x in found))
    assert all(x == want for x in results)


def test_equal_suffixes_are_those_of_a_sorted_list():
    r = np.random.default_rng(7)
    flat = np.tile(r.integers(0, 2, 90, dtype=np.uint8), 30) ^ (r.random(2700) < 0.004).astype(np.uint8)
    start = r.permutation(2500)[:1500]
    group = r.integers(0, 3, 1500)
    keys = [(g, flat[s : s + 200].tobytes()) for s, g in zip(start, group, strict=True)]
    count = collections.Counter(keys)
    assert suffix_dedup.equal_suffixes(flat, start, group).tolist() == [count[k] > 1 for k in keys] and max(count.values()) > 1
