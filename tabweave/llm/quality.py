"""Quality rules: a threshold table compiled into one Spark projection.

No user function runs: words, lines and windows are arrays that Spark's higher-order
functions walk inside the row, so nothing is shuffled and nothing depends on other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, text_of

WINDOW = 8

#: Function words of four languages; fixed values.
STOP_WORDS = {
    "en": "the be to of and that have with is was in for on as at by it or an are this from not you they",
    "de": "der die das und ist nicht ein eine zu den mit von im auf sich dem des für als auch es an er sie wie",
    "fr": "le la les de des et est un une du dans que qui pour pas au en ce sur il elle par se ne avec à",
    "es": "el la los las de del y en un una que es por con para no se al lo su como más o pero",
}

#: (measure, lowest, highest): a text outside is rejected.  ``None`` leaves a side open.
#: Each is so wide that prose of any language passes; they are there for tables of numbers,
#: symbol soup, binary debris and pages of ellipses.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 40.0),
    ("symbols_per_word", None, 0.5),
    ("dup_line_share", None, 0.7),
    ("ellipsis_line_share", None, 0.9),
    ("long_text_without_stop_words", None, 0.0),
)

#: Rules beside :data:`THRESHOLDS` for the ratios as they are named.  A symbol that stands alone
#: is no word it could be measured by: in 'a | b | c' there are two symbols to three words.
#: Of running text in a language of :data:`STOP_WORDS` (or none stated), at least a twentieth is
#: function words; texts in other languages, or of under ``STOP_WORD_TEXT`` words, are not judged by it.
RATIOS: tuple[tuple[str, float | None, float | None], ...] = (
    ("symbols_per_plain_word", None, 0.5),
    ("stop_word_share", 0.05, None),
)

#: A text with this many words and no function word of any language is no running text.
STOP_WORD_TEXT = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row.

    A lambda variable, unlike a column of an inner projection, is never inlined again where
    the optimizer merges projections; inlined into a loop, the split of a text would be
    repeated for every word of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_hashes(words: Column) -> Column:
    """XXH64 over the eight words of each window."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(hashes)


def repeated_window_words(words: Column, hashes: Column) -> Column:
    """Words that lie in windows found twice or more, the first included.

    Hashes only tell which windows may repeat; their words decide.  Only texts in which a hash
    repeats pay for the words and the sorts; O(n log n) for n words, whatever repeats.
    """

    def repeats(p: Column, by: str) -> Column:
        return F.transform(F.filter(p, lambda x, k: (x[by] == F.get(p, k + 1)[by]) | (x[by] == F.get(p, k - 1)[by])), lambda x: x["i"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    window = lambda w, i: F.array(*[F.get(w, i + k) for k in range(WINDOW)])
    spelled = let(words, lambda w: F.transform(let(pairs, lambda p: repeats(p, "h")), lambda i: F.struct(window(w, i).alias("g"), i.alias("i"))))
    starts = let(F.sort_array(spelled), lambda p: F.sort_array(repeats(p, "g")))
    covered = let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, gap: total + gap))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measures(text: Column, ratios: bool = False) -> Column:
    """One struct with all counts of a text and its window hashes; evaluated once for each row.

    ``ratios`` adds what :data:`RATIOS` need."""
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long").alias("n_ellipsis_lines"),
        ),
    )
    stop_words = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    is_stop_word = lambda x: ascii_lower(F.regexp_replace(x, r"[.,;:!?]+$", "")).isin(stop_words)
    more = lambda w: [
        F.when(F.size(w) >= STOP_WORD_TEXT, F.size(F.filter(w, is_stop_word)).cast("long")).alias("n_stop_words"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"^[#*$%&|<>]+$"))).cast("long").alias("n_plain_words"),
    ]
    words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            window_hashes(w).alias("hashes"),
            F.when(F.size(w) >= STOP_WORD_TEXT, F.exists(w, is_stop_word)).otherwise(F.lit(True)).alias("has_stop_word"),
            *(more(w) if ratios else []),
        ),
    )
    # The random field keeps a filter on what is derived from the counts (``kept``) above the
    # projection that makes them: pushed below it, they would be worked out once a reference.
    return F.struct(F.rand(0).alias("held"), words.alias("w"), lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, text: str = "text", thresholds: tuple = THRESHOLDS, min_words: int = 20, max_repeat_percent: int = 30, lang: str | None = None) -> DataFrame:
    """Judge each text; all columns stay, and the counts, ``base_failed``, ``failed_rules``
    and ``kept`` are added (replacing columns of these names).

    A null or empty text has no words and fails the base rule.  Repeated rows are judged
    alike, an empty table gives an empty table, and the rows of a very long text cost memory
    in proportion to that text only.  Names that begin with ``_tw_`` are reserved.  With ``lang``,
    the column of the language, the share of stop words is not judged where it is none of
    :data:`STOP_WORDS`.
    """
    m = "_tw_measures"
    ratios = bool({name for name, _, _ in thresholds} & {name for name, _, _ in RATIOS})
    out = docs.withColumn(m, measures(text_of(text), ratios))
    w, lines = F.col(f"{m}.w"), F.col(f"{m}.l")
    values: dict[str, Column] = {
        "mean_word_chars": F.when(w["n_words"] > 0, w["word_chars"] / w["n_words"]).otherwise(F.lit(None).cast("double")),
        "symbols_per_word": _share(F.col(f"{m}.n_symbols"), w["n_words"]),
        "dup_line_share": _share(lines["n_dup_lines"], lines["n_lines"]),
        "ellipsis_line_share": _share(lines["n_ellipsis_lines"], lines["n_lines"]),
        "long_text_without_stop_words": F.when(w["has_stop_word"], F.lit(0.0)).otherwise(F.lit(1.0)),
    }
    if ratios:
        known = F.coalesce(F.col(lang).isin(*STOP_WORDS), F.lit(True)) if lang else F.lit(True)
        values |= {
            "symbols_per_plain_word": F.when(w["n_plain_words"] > 0, F.col(f"{m}.n_symbols") / w["n_plain_words"]).otherwise(F.col(f"{m}.n_symbols").cast("double")),
            "stop_word_share": F.when(known & w["n_stop_words"].isNotNull(), w["n_stop_words"] / w["n_words"]),
        }
    failures = []
    for name, low, high in thresholds:
        outside = F.lit(False)
        outside = outside | (values[name] < low) if low is not None else outside
        outside = outside | (values[name] > high) if high is not None else outside
        failures.append(F.when(outside, F.lit(name)))
    # A projection of its own: Spark merges it with neither neighbour, as both sides are read twice.
    r = "_tw_repeats"
    out = out.withColumn(r, repeated_window_words(words_of(text_of(text)), w["hashes"]))
    base_failed = (w["n_words"] < min_words) | (100 * F.col(r) > max_repeat_percent * w["n_words"])
    failed = F.array_compact(F.array(*failures))
    added = {
        "n_words": w["n_words"],
        "word_chars": w["word_chars"],
        "n_symbols": F.col(f"{m}.n_symbols"),
        "n_dup_lines": lines["n_dup_lines"],
        "n_repeat_words": F.col(r),
        "base_failed": base_failed,
        "failed_rules": failed,
        "kept": ~base_failed & (F.size(failed) == 0),
    }
    return out.select(*[c for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
