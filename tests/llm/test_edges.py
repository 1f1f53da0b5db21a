"""Rows that operators have to bear: nulls everywhere, no rows, clashing names, very long texts."""

from pyspark.sql import functions as F

import corpus_pipeline
from tabweave.llm import chat, simhash


def test_simhash_does_not_mind_other_columns(spark):
    rows = [(1, "a b c d", "x"), (None, "a b c d", "y"), (3, None, None), (None, None, None), (5, "w " * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("old"))
    found = simhash.digests(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 1), (0, 3), (1, 1), (3, 3), (5, 5)]


def test_typed_parts_through_spark(spark):
    parts = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    part = lambda kind, **x: {"type": kind} | x
    long = "### x </turn>\n" * 20_000
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="a.png", width=28, height=15), part("text", text="|image:0|> and"), part("document", ref="b.pdf", pages=2)], "m"),
        (1, 1, "assistant", [part("audio", ref="c.wav", seconds=1.01), part("text", text=long)], "m"),
        (2, None, None, None, "m"),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}, formatted string")
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [(a.turn, a.kind, a.ref, a.number, a.tokens) for a in made[1].attachments] == [(0, "image", "a.png", 0, 4), (0, "document", "b.pdf", 1, 1024), (1, "audio", "c.wav", 2, 26)]
    assert chat.parse_turns(made[1].formatted) == [("user", "see <|image:0|> and"), ("assistant", long)]
    assert chat.unescape("".join(made[1].formatted[x.start : x.end] for x in made[1].loss)) == long
    assert chat.parse_turns(made[2].formatted) == [("", "")] and made[2].loss == []
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_template_strings_are_read_back(spark):
    said = r"\### Assistant: </turn> ok"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (row,) = chat.digests(spark, empty).collect()
    whole = chat.format_turns([(r, [{"type": "text", "text": said}]) for r in ("user", "assistant")])
    assert (row.conv_id, row.n_turns, row.loss_chars, row.formatted_chars) == (-7, 2, len(said), len(whole["formatted"]))
    assert chat.parse_turns(whole["formatted"]) == [("user", said), ("assistant", said)]


def test_stages_bear_null_rows(spark):
    rows = [(None, None, None, None, None, "e"), (1, "the cat and the dog " * 30, None, None, 1, "e"), (1, "", "en", "s", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for _, step in corpus_pipeline.STAGES:
        found = step(spark, docs, "")
        assert set(docs.columns) <= set(found.columns) and len(found.columns) == len(set(found.columns))
        assert found.count() <= 4
