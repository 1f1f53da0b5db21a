"""Byte-level BPE encoding in overlapping chunks, and decoding.

A text of at most ``chunk_chars`` characters is one chunk and is encoded where it is read.
A longer one is cut into overlapping chunks that are dealt over the cluster:

1. Each chunk is pre-tokenised on its own, from an arbitrary character on.
2. The pattern looks ahead only, so once two neighbouring chunks have a pre-token boundary in
   common, all that follows it agrees: there the chunks of a text are stitched.  Where an
   overlap holds no common boundary (one pre-token longer than it), the chunks are joined and
   pre-tokenised again.
3. The pieces between the stitches are dealt over the cluster once more and encoded.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, per_process, slices, small_batches, text_of

CHUNK_CHARS, OVERLAP = 32_768, 512
#: A match may depend on so many characters behind its end: contractions look two ahead.
LOOKAHEAD = 3


def read_ranks(path: str) -> bytes:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


def token_table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}


@cache
def unlike_characters() -> dict[int, str]:
    """Characters that the two regex libraries class differently (their Unicode versions
    differ), each with an ordinary character of the class that the encoder gives it.

    Found once, on the driver, and sent to the tasks that find boundaries.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    alike: dict[int, str] = {}
    for name, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        encoder = set(bytes(probe.encode_ordinary(every)).decode())
        here = set(regex.findall(name, every))
        alike |= {ord(c): stand_in for c in encoder - here}
        for c in here - encoder:
            alike.setdefault(ord(c), "!")
    return alike


class Boundaries:
    """Where the pre-tokens of a text begin, and its end."""

    def __init__(self, pattern: str, alike: dict[int, str]):
        import regex

        self.pattern, self.alike = regex.compile(pattern), alike

    def of(self, text: str) -> list[int]:
        if not text.isascii() and any(ord(c) in self.alike for c in set(text)):
            text = text.translate(self.alike)
        return [*(m.start() for m in self.pattern.finditer(text)), len(text)]


def encoder(ranks: bytes, pattern: str):
    """The library's encoder, one for each worker process."""

    def build():
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=token_table(ranks), special_tokens={})

    return per_process(f"encoder {hash(ranks)} {pattern}", build)


class Pieces:
    """The bytes of all tokens in one array, so that ids are decoded by gathering from it."""

    def __init__(self, ranks: bytes):
        table = token_table(ranks)
        self.length = np.zeros(max(table.values(), default=-1) + 1, np.int64)
        for token, rank in table.items():
            self.length[rank] = len(token)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.zeros(int(self.length.sum()), np.uint8)
        for token, rank in table.items():
            self.flat[self.begin[rank] : self.begin[rank] + len(token)] = np.frombuffer(token, np.uint8)

    def decode(self, column: pa.ListArray) -> pa.Array:
        """A binary array of the concatenated bytes of each list of ids; null where it is null."""
        ids = column.flatten().to_numpy(zero_copy_only=False)
        lengths = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends[:-1], lengths)]
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        return pc.if_else(column.is_valid(), made, pa.scalar(None, pa.binary())) if column.null_count else made


def id_lists(lists: list) -> pa.Array:
    """A list array of numpy arrays or lists of ids."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    values = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _replaced(part: pa.RecordBatch, gone: str, more: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != gone} | more
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def _encode_whole(ranks: bytes, pattern: str, text: str, out: str):
    def run(batches):
        library = encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield _replaced(part, text, {out: id_lists([library.encode_to_numpy(t, disallowed_special=()) for t in texts])})

    return run


def _bound_chunks(pattern: str, alike: dict[int, str]):
    """Adds the boundaries of each chunk, counted from its start."""

    def run(batches):
        find = Boundaries(pattern, alike)
        for batch in batches:
            for part in slices(batch, "_chunk"):
                yield _replaced(part, "", {"_bounds": id_lists([find.of(t) for t in part.column(part.schema.get_field_index("_chunk")).to_pylist()])})

    return run


def stitch(find: Boundaries, chunks: list[dict]):
    """Yield a text's stretches, each with the boundaries of its pieces (from its start to its
    end), from its chunks in order (keys start, chunk, bounds)."""
    now, begin, k, joined = chunks[0], 0, 1, 1
    bounds = np.asarray(now["bounds"]) + now["start"]
    while True:
        if k == len(chunks):
            yield now["chunk"][begin - now["start"] :], bounds[bounds >= begin] - begin
            return
        after = chunks[k]
        theirs = np.asarray(after["bounds"]) + after["start"]
        safe = now["start"] + len(now["chunk"]) - LOOKAHEAD
        common = np.intersect1d(bounds[(bounds >= max(begin, after["start"])) & (bounds <= safe)], theirs)
        if len(common):
            end = int(common[0])
            yield now["chunk"][begin - now["start"] : end - now["start"]], bounds[(bounds >= begin) & (bounds <= end)] - begin
            now, begin, bounds, k, joined = after, end, theirs, k + 1, 1
            continue
        # No boundary in common: join the next chunks (twice as many each time) to this one.
        text, k_to = now["chunk"][begin - now["start"] :], min(len(chunks), k + joined)
        for c in chunks[k:k_to]:
            text += c["chunk"][begin + len(text) - c["start"] :]
        now, bounds = {"start": begin, "chunk": text}, np.asarray(find.of(text)) + begin
        k, joined = k_to, joined * 2


def _stitch_rows(pattern: str, alike: dict[int, str]):
    """Rows (_tw_row, number, stretch, cuts) of the stretches of each text; its other columns
    go with the first."""

    def run(batches):
        find = Boundaries(pattern, alike)
        for batch in batches:
            for i in range(batch.num_rows):
                row, rest, chunks = (batch.column(j)[i] for j in range(3))
                for number, (stretch, cuts) in enumerate(stitch(find, chunks.as_py())):
                    kept = rest.as_py() if number == 0 else None
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([kept], batch.schema.field(1).type), pa.array([number], pa.int32()), pa.array([stretch]), id_lists([cuts])], names=["_tw_row", "_tw_rest", "_number", "_stretch", "_cuts"])

    return run


def _encode_pieces(ranks: bytes, pattern: str):
    def run(batches):
        piece = encoder(ranks, pattern)._core_bpe.encode_single_piece
        for batch in batches:
            for part in slices(batch, "_stretch"):
                ids = []
                for stretch, cuts in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    ids.append([i for a, b in zip(cuts, cuts[1:], strict=False) for i in piece(stretch[a:b].encode())])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], id_lists(ids)], names=["_tw_row", "_tw_rest", "_number", "_ids"])

    return run


def _decode_lists(ranks: bytes, ids: str, out: str):
    def run(batches):
        pieces = per_process(f"pieces {hash(ranks)}", lambda: Pieces(ranks))
        for batch in batches:
            for part in slices(batch, ids):
                yield _replaced(part, out, {out: pieces.decode(part.column(part.schema.get_field_index(ids)))})

    return run


def _long_texts(whole: DataFrame, ranks: bytes, pattern: str, chunk_chars: int, overlap: int, rest: list[str]) -> DataFrame:
    """The columns ``rest`` and ``_ids`` of texts over ``chunk_chars`` characters."""
    alike = unlike_characters()
    long = whole.filter(F.length("_tw_text") > chunk_chars).withColumn("_tw_row", F.monotonically_increasing_id())
    number = F.posexplode(F.sequence(F.lit(0), F.length("_tw_text") - 1, F.lit(chunk_chars))).alias("_number", "_start")
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    chunks = long.select("_tw_row", row.alias("_tw_rest"), "_tw_text", number)
    chunk = F.substring("_tw_text", F.col("_start") + 1, F.lit(chunk_chars + overlap))
    chunks = chunks.select("_tw_row", F.when(F.col("_number") == 0, F.col("_tw_rest")).alias("_tw_rest"), "_number", "_start", chunk.alias("_chunk"))
    ints = T.ArrayType(T.IntegerType())
    dealt = chunks.repartition("_tw_row", "_number").mapInArrow(*lean(_bound_chunks(pattern, alike), T.StructType([*chunks.schema.fields, T.StructField("_bounds", ints)])))
    parts = F.struct("_number", F.col("_start").alias("start"), F.col("_chunk").alias("chunk"), F.col("_bounds").alias("bounds"))
    first = F.first("_tw_rest", ignorenulls=True).alias("_tw_rest")
    gathered = dealt.groupBy("_tw_row").agg(first, F.sort_array(F.collect_list(parts)).alias("_chunks"))
    head = [gathered.schema["_tw_row"], gathered.schema["_tw_rest"], T.StructField("_number", T.IntegerType())]
    stretches = gathered.mapInArrow(*lean(_stitch_rows(pattern, alike), T.StructType([*head, T.StructField("_stretch", T.StringType()), T.StructField("_cuts", ints)])))
    encoded = stretches.repartition("_tw_row", "_number").mapInArrow(*lean(_encode_pieces(ranks, pattern), T.StructType([*head, T.StructField("_ids", ints)])))
    joined = encoded.groupBy("_tw_row").agg(first, F.sort_array(F.collect_list(F.struct("_number", "_ids"))).alias("_all"))
    return joined.select(*[F.col(f"_tw_rest.`{n}`").alias(n) for n in rest], F.flatten(F.col("_all._ids")).alias("_ids"))


def encode(spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """Replace ``text`` by ``out``, the ids (array of int) of the whole text.

    A null text is encoded as an empty one: no ids.  Ties do not exist, repeated rows are
    encoded one by one, and other columns pass through (columns whose names begin with
    ``_tw_`` are reserved; ones named like a result are replaced).  An empty table gives an
    empty table.  ``docs`` should be a table or a staged one: the rows of long texts are
    numbered, which needs a stable order of rows.

    With ``decoded`` the ids are decoded again in the same pass (see :func:`decode`), so that
    a task needs one Python process for both.
    """
    small_batches(spark)
    rest = [f for f in docs.schema.fields if f.name not in (text, out, decoded)]
    fields = [*rest, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    whole = docs.select(*[f.name for f in rest], text_of(text).alias("_tw_text"))
    ids, back = _encode_whole(ranks, pattern, "_tw_text", out), _decode_lists(ranks, out, decoded) if decoded else None

    def run(batches):
        return back(ids(batches)) if back else ids(batches)

    short = whole.filter(F.length("_tw_text") <= chunk_chars).mapInArrow(*lean(run, T.StructType(fields)))
    long = _long_texts(whole, ranks, pattern, chunk_chars, overlap, [f.name for f in rest]).withColumnRenamed("_ids", out)
    return short.unionByName(decode(long, ranks, out, decoded) if decoded else long)


def decode(tokens: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes (binary) of the ids, concatenated.  Null ids give null."""
    fields = [f for f in tokens.schema.fields if f.name != out]
    return tokens.mapInArrow(*lean(_decode_lists(ranks, ids, out), T.StructType([*fields, T.StructField(out, T.BinaryType())])))


def digests(spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Encode ``documents``, decode the ids, and digest both."""
    tokens = encode(spark, docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
