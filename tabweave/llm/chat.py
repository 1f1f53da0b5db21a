"""Chat formatting of typed content parts."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: What a text must not hold unescaped: the escape itself, the start of ``###``, of the turn's
#: end and of a placeholder.  One backslash before it makes it plain.
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>|\|)")
_ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>|\|)|:")
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)
_BODY = re.compile(r"((?:[^\\<]+|\\.|(?!</turn>\n)<)*)</turn>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"(\\.)|<\|(?:image|audio|document|other):\d+\|>", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class PartVisitor:
    """Flattens the typed parts of one conversation into placeholders, in order.

    ``visit`` returns the runs of a turn: (is text, string).  Attachments get consecutive
    numbers over the conversation and the number of tokens that their placeholder expands to:
    an image one for each patch of 14 by 14 pixels, audio 25 a second, a document 512 a page.  A part
    of any other kind is an attachment of that kind and one token, and its text, if any, follows it.
    """

    def __init__(self) -> None:
        self.attachments: list[dict] = []

    def visit(self, turn: int, parts: list[dict]) -> list[tuple[bool, str]]:
        runs: list[tuple[bool, str]] = []
        for part in parts or []:
            kind = part["type"] or "text"
            known = kind in ("text", "image", "audio", "document")
            made = getattr(self, f"visit_{kind}" if known else "visit_other")(part)
            if not isinstance(made, str):
                name = kind if known else "other"
                self.attachments.append({"turn": turn, "kind": kind, "ref": part["ref"], "number": len(self.attachments), "tokens": made})
                runs.append((False, f"<|{name}:{len(self.attachments) - 1}|>"))
                made = None if known else part["text"]
            if made is not None:
                if runs and runs[-1][0]:
                    made = runs.pop()[1] + made  # escaped together: a control string may begin in one part and end in the next
                runs.append((True, made))
        return runs

    def visit_text(self, part: dict) -> str:
        return part["text"] or ""

    def visit_other(self, part: dict) -> int:
        return 1

    def visit_image(self, part: dict) -> int:
        return max(1, math.ceil((part["width"] or 0) / 14) * math.ceil((part["height"] or 0) / 14))

    def visit_audio(self, part: dict) -> int:
        return max(1, math.ceil((part["seconds"] or 0) * 25))

    def visit_document(self, part: dict) -> int:
        return max(1, part["pages"] or 0) * 512


def format_turns(turns: list[tuple[str, list[dict]]]) -> dict:
    """One conversation: its string, the spans under the loss mask, and its attachments."""
    visitor, out, at, loss = PartVisitor(), [], 0, []
    for k, (role, parts) in enumerate(turns):
        head = OPEN + escape(role or "", _ROLE_CONTROL) + ROLE_END
        out.append(head)
        at += len(head)
        for is_text, run in visitor.visit(k, parts):
            run = escape(run) if is_text else run
            if is_text and role == "assistant" and run:
                loss.append({"start": at, "end": at + len(run)})
            out.append(run)
            at += len(run)
        out.append(CLOSE)
        at += len(CLOSE)
    return {"formatted": "".join(out), "loss": loss, "attachments": visitor.attachments}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back; placeholders are left out of the texts."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = _BODY.match(formatted, head.end())
        text = _PLACEHOLDER.sub(lambda m: m[1] or "", body[1])
        turns.append((unescape(head[1]), unescape(text)))
        at = body.end()
    return turns


_FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<turn:int,kind:string,ref:string,number:int,tokens:long>>"


def _format_sorted(batches):
    """Rows sorted by conversation and turn; one conversation is held at a time."""
    open_id, turns, began, done = None, [], False, []
    for batch in batches:
        for conv, role, parts in zip(batch["_conv"], batch["role"], batch["parts"], strict=True):
            if began and conv != open_id:
                done.append({"conv_id": None if open_id == "" else int(open_id), **format_turns(turns)})
                turns = []
            open_id, began = conv, True
            turns.append((role, [dict(p) if isinstance(p, dict) else p.asDict() for p in parts] if parts is not None else []))
        if done:
            yield pd.DataFrame(done).astype({"conv_id": "Int64"})
            done = []
    if began:
        yield pd.DataFrame([{"conv_id": None if open_id == "" else int(open_id), **format_turns(turns)}]).astype({"conv_id": "Int64"})


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format each conversation (conv_id, turn, role, parts) into one string.

    Turns stand in the order of ``turn`` (nulls first; ties by role and parts, so repeated
    rows stand side by side and each counts).  A null conv_id is a conversation of its own,
    null parts or text are empty, a null role is an empty one; parts of unknown kinds are kept as
    attachments.  An empty table gives an empty
    table.  The rows are dealt by conversation and sorted; a task holds one conversation at a
    time, which is one row of the result, so no conversation may exceed what a row can hold.
    """
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), "turn", "role", F.col("parts").cast(PART_TYPE).alias("parts"))
    order = ["_conv", "turn", "role", "parts"]
    return rows.repartition("_conv").sortWithinPartitions(*order).select("_conv", "role", "parts").mapInPandas(_format_sorted, _FORMATTED)


def text_parts(text: str = "text"):
    """A column of parts that holds one text."""
    none = {k: F.lit(None) for k in ("ref", "width", "height", "seconds", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[v.alias(k) for k, v in none.items()])).cast(PART_TYPE)


def _read_back(batches):
    import hashlib

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        out = []
        for conv, formatted, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"], strict=True):
            turns = parse_turns(formatted)
            spans = [x if isinstance(x, dict) else x.asDict() for x in loss]
            masked = unescape("".join(formatted[x["start"] : x["end"]] for x in spans))
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(formatted)))
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield frame.astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what they hold."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInPandas(_read_back, schema)


def digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own strings."""
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_conversations(rows.withColumn("parts", text_parts())))
