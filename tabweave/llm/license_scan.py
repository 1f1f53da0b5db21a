"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or as many consecutive paragraphs as a template has.  It matches a template
when it holds at least ``threshold`` of the template's distinct words.  Words of the templates
are ordered by how many blocks of the corpus hold them, the rarest first; a template's prefix
is as many of its rarest words as leave fewer than the needed overlap outside, so every match
shares a prefix word.  From the first shared prefix word on, the words still to come bound the
overlap (positional filter), and a block with fewer distinct words than needed is skipped
(length filter).  Templates are sent to all tasks, so no text is shuffled; where they outgrow
``MAX_TEMPLATE_BYTES`` they are sent in several parts, each in a pass of its own over the texts,
whose result is written before the next begins, so that one part is in memory at a time.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, small_batches, stage, text_of, unstage
from .license_texts import TEMPLATES

#: Phrases whose places are counted, and their labels; fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Bytes of templates that are sent to all tasks at a time.
MAX_TEMPLATE_BYTES = 1 << 20

#: Bytes that belong to no word; those from 0x80 on are parts of letters outside ASCII.
_BREAKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in bytes(range(256)).lower())
_BLOCK_END = re.compile(r"\n[^\S\n]*\n")


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and characters outside ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def phrase_places(words: list[bytes], phrases: list[bytes]) -> dict[int, list[int]]:
    """Word indexes at which each phrase stands; phrases are words joined by one space."""
    line, found = b" " + b" ".join(words) + b" ", {}
    for k, phrase in enumerate(phrases):
        needle, at, word, seen = b" " + phrase + b" ", line.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            found.setdefault(k, []).append(word)
            at = line.find(needle, at + 1)
    return found


def paragraphs_of(text: str) -> list[str]:
    return [p for p in _BLOCK_END.split(text) if p.strip()]


def blocks_of(text: str, spans: tuple[int, ...] = (1,)) -> list[str]:
    """Each line, and each run of so many paragraphs (ended by empty lines) as ``spans`` says,
    or of all if there are fewer; runs of one line are lines already."""
    out = text.split("\n")
    paragraphs = paragraphs_of(text)
    for n in sorted({min(s, len(paragraphs)) for s in spans} - {0}):
        out += [run for run in ("\n\n".join(paragraphs[i : i + n]) for i in range(len(paragraphs) - n + 1)) if "\n" in run]
    return out


def spans_of(templates) -> tuple[int, ...]:
    return tuple(sorted({1, *(len(paragraphs_of(text)) for _, text in templates)}))


def _vocabulary(templates) -> set[bytes]:
    return {w for _, text in templates for w in words_of(text)}


def word_frequencies(docs: DataFrame, templates, text: str = "text") -> dict[bytes, int]:
    """Blocks that hold each template word; each task counts, so a row a task and word moves."""
    vocabulary, spans = sorted(_vocabulary(templates)), spans_of(templates)

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()
        for b in (part for whole in batches for part in slices(whole, "t")):
            for t in b.column(0).to_pylist():
                whole = set(words_of(t)).intersection(vocabulary)
                if whole:
                    for block in blocks_of(t, spans):
                        counts.update(whole.intersection(words_of(block)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_of(text).alias("t")).mapInArrow(*lean(run, "word binary, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {bytes(r.word): r.n for r in counted}


class TemplateIndex:
    """Prefixes of the templates, over words in the global order."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        order = {w: i for i, w in enumerate(sorted(_vocabulary(templates), key=lambda w: (frequency[w], w)))}
        self.order, self.prefix = order, {}
        self.templates = []
        for label, text in templates:
            words = sorted({order[w] for w in words_of(text)})
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, words, set(words), need))
            for place, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, place))

    def best(self, words: list[bytes]) -> dict[str, float]:
        """Containment of each matching label's best template in a block."""
        mine = sorted({self.order[w] for w in set(words) if w in self.order})
        found: dict[str, float] = {}
        tried: set[int] = set()
        for at, w in enumerate(mine):
            for k, place in self.prefix.get(w, ()):
                label, theirs, as_set, need = self.templates[k]
                if k in tried or len(mine) < need:
                    continue
                tried.add(k)
                # w is the first common word: only words from here on can be shared.
                if min(len(mine) - at, len(theirs) - place) < need:
                    continue
                share = sum(x in as_set for x in mine[at:])
                if share >= need:
                    found[label] = max(found.get(label, 0.0), share / len(theirs))
        return found


def template_parts(templates) -> list[list]:
    """The templates cut into parts of at most ``MAX_TEMPLATE_BYTES`` (or one template)."""
    parts, held = [[]], 0
    for t in templates:
        if parts[-1] and held + len(t[1].encode()) > MAX_TEMPLATE_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(t)
        held += len(t[1].encode())
    return parts


def _matches(index: TemplateIndex, spans: tuple[int, ...], text: str, words: list[bytes]) -> dict[str, float]:
    """The best containment of each label that a block of the text matches."""
    found: dict[str, float] = {}
    if any(index.order.get(w) in index.prefix for w in set(words).intersection(index.order)):
        for block in blocks_of(text, spans):
            for label, share in index.best(words_of(block)).items():
                found[label] = max(found.get(label, 0.0), share)
    return found


_FOUND = T.MapType(T.StringType(), T.DoubleType())


def _scan_part(index: TemplateIndex, spans: tuple[int, ...]):
    """Adds what a part of the templates matches to ``_tw_found``."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "_tw_text")):
            texts, before = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("_tw_text", "_tw_found"))
            made = []
            for t, old in zip(texts, before, strict=True):
                found = dict(old)
                for label, share in _matches(index, spans, t, words_of(t)).items():
                    found[label] = max(found.get(label, 0.0), share)
                made.append(list(found.items()))
            columns = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_tw_found"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.map_(pa.string(), pa.float64()))], names=[*(n for n in b.schema.names if n != "_tw_found"), "_tw_found"])

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9) -> DataFrame:
    """Replace ``text`` by ``n_words``, ``n_base`` (places of all phrases), ``first_word``,
    ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``labels`` joins the phrases' labels and those of matching templates; ``score`` is 1 with
    a phrase, else the best containment, else 0.  A null text is empty and has no label;
    templates that tie add one label each; repeated rows are scanned one by one; an empty table
    gives an empty table; other columns pass through (columns named like a result are replaced,
    ``_tw_text`` and ``_tw_found`` are reserved).  A text is held in one task with its words and
    one block, nothing else.
    """
    small_batches(spark)
    needles, names = [b" ".join(words_of(p)) for p, _ in phrases], [label for _, label in phrases]
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
    types = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in kinds]
    frequency = word_frequencies(docs, templates, text)
    parts = [(TemplateIndex(p, frequency, threshold), spans_of(p)) for p in template_parts(templates)]
    none = F.create_map().cast(_FOUND)
    rows = docs.select(*[f.name for f in rest], text_of(text).alias("_tw_text"), none.alias("_tw_found"))
    for part in parts[:-1]:
        earlier, rows = rows, stage(spark, rows.mapInArrow(*lean(_scan_part(*part), rows.schema)), "licenses")
        unstage(spark, earlier)
    last = parts[-1]

    def scan(t: str, before: list) -> tuple:
        words = words_of(t)
        places = phrase_places(words, needles)
        base = {names[k] for k in places}
        every = [w for found in places.values() for w in found]
        found = dict(before)
        for label, share in _matches(*last, t, words).items():
            found[label] = max(found.get(label, 0.0), share)
        score = 1.0 if base else max(found.values(), default=0.0)
        return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "_tw_text")):
            made = [scan(t, old) for t, old in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(list(c), kind) for c, kind in zip(columns, kinds.values(), strict=True))], names=[*b.schema.names[:-2], *kinds])

    return rows.mapInArrow(*lean(run, T.StructType([*rest, *[T.StructField(n, types[kind]) for n, kind in kinds.items()]])))
