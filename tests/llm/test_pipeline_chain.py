"""The pipeline as a chain: each stage on all that the one before kept, against a plain version."""

import collections
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabweave import staging
from tabweave.llm import bpe, mixing
from tabweave.llm.queries import vocabulary

STOP = "the of and to in that is was he for it with as his on be".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(11)

    def prose(seed, n):
        g = np.random.default_rng(seed)
        return " ".join(STOP[g.integers(0, len(STOP))] if i % 3 == 0 else f"w{g.integers(0, 10**5)}" for i in range(n))

    passage = prose(99, 60)
    texts = [prose(i, 80 + 5 * i) for i in range(24)]
    texts += [f"{prose(200 + i, 40)} {passage} {prose(300 + i, 40)}" for i in range(4)]  # one passage in four texts
    near = texts[2].split()
    near[50] = "changed"
    texts += [texts[0], texts[0], " ".join(near)]  # copies and a near copy
    texts += ["$$$ ### %%% " * 40, "same line\n" * 50, "too short", "", None]  # rejected
    order = r.permutation(len(texts))
    rows = [(int(i), texts[i], "en", None if i % 7 == 0 else f"s{i % 3}", len(texts[i] or ""), "extra") for i in order]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_repeats(texts):
    data = [(t or "").encode() for t in texts]
    held = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if held[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_every_stage_on_what_the_one_before_kept(spark, corpus):
    steps = dict(corpus_pipeline.STAGES)
    names = list(steps)
    rows, docs = corpus.collect(), corpus
    # Quality rules: the five rejected texts go, no other.
    docs = staging.stage(spark, steps[names[0]](spark, docs, ""), "one")
    kept = {r.doc_id: r for r in rows if len(words_of(r.text)) >= 20 and not r.text.startswith(("$$$", "same"))}
    assert {r.doc_id for r in docs.collect()} == set(kept) and len(kept) == len(rows) - 5 and docs.columns == corpus.columns
    # Near-dedup: of each group linked by a Jaccard similarity of 0.8 the smallest id.
    docs = staging.stage(spark, steps[names[1]](spark, docs, ""), "two")
    parent = {i: i for i in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            s, t = shingles(kept[a].text), shingles(kept[b].text)
            if a < b and 5 * len(s & t) >= 4 * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = {i: r for i, r in kept.items() if root(i) == i}
    assert {r.doc_id for r in docs.collect()} == set(kept) and len(kept) == 28
    # Suffix-array dedup: the shared passage goes, wherever it stands.
    docs = staging.stage(spark, steps[names[2]](spark, docs, ""), "three")
    ids = sorted(kept)
    cut = dict(zip(ids, without_repeats([kept[i].text for i in ids]), strict=True))
    found = {r.doc_id: r.text for r in docs.collect()}
    assert found == cut and sum(len(kept[i].text) > len(cut[i]) for i in ids) == 4
    # Mixing: each source comes as near to its target as some of its documents allow; documents stand as
    # often as the mix takes them.
    before = docs
    docs = staging.stage(spark, steps[names[3]](spark, docs, ""), "four")
    told = mixing.mix_sources(spark, before, mixing.word_count()).collect()
    copies = collections.Counter(r.doc_id for r in docs.collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in told if r.copies})
    taken, targets, sizes = collections.Counter(), {}, collections.defaultdict(list)
    for r in told:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        sizes[r.source].append(r.size)
        assert r.size == len(words_of(cut[r.doc_id])) and r.taken <= 3 * r.size + r.size
    for s, t in targets.items():
        rest = round(t - t // sum(sizes[s]) * sum(sizes[s]))
        sums = {0}
        for n in sizes[s]:
            sums |= {x + n for x in sums if x + n <= rest}
        assert 0 <= t - taken[s] <= rest - max(sums) + 0.05 * t + 1, s
    # Byte-level BPE: the library's ids, and the text again.
    ranks, pattern = vocabulary()
    encoder = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=bpe.token_table(ranks), special_tokens={})
    for r in steps[names[4]](spark, docs, "").collect():
        assert list(r.ids) == encoder.encode_ordinary(cut[r.doc_id]) and r.text == cut[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_is_the_chain_and_frees_what_it_stages(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging.shared_dir(spark))
    there = lambda: {f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    before = there() if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else set()
    made = corpus_pipeline.run(spark, str(tmp_path))
    left = there() - before
    assert [name.split("-")[1] for name in left] == ["mixing"]  # what the last stage reads
    docs = corpus
    for _, step in corpus_pipeline.STAGES:
        docs = staging.stage(spark, step(spark, docs, ""), "step")
    key = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert key(made) == key(docs) and made.agg(F.count("*")).first()[0] > 20
