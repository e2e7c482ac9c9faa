"""SentencePiece encoding and decoding through a table of distinct chunks.

The escaped text (a marker in front, each space a marker) is cut before every run of markers.  No
piece of the model has a marker behind another character, so no piece crosses a cut and the text's
pieces are those of its chunks in order.  ``ChunkTable`` refuses a model for which this is not so.

The corpus's chunks are counted (tasks add up what they read before anything is shuffled), those seen
twice or more are segmented once each, and their ids are joined back by position as the texts are read
again.  The table that is sent to the executors has the ``table_chunks`` chunks seen most often, none
longer than ``LONGEST_CHUNK``, so its size has a bound; the chunks that it lacks, seen rarely, are
segmented where they stand.  That changes no result.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows give equal
rows; an empty table gives no rows; other columns are kept, those named as a result are replaced; a very
long text is cut into its chunks and encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpoint
from .arrow import SLICE_ROWS, append_columns, explode_columns, record_batch

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
TABLE_CHUNKS = 200_000  #: chunks of the table that is sent to the executors
LONGEST_CHUNK = 64  #: characters of a chunk of the table
MAX_CHUNKS = 100_000  #: rare chunks that a worker keeps, and distinct ones that a task counts before it passes them on


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text in order, each without its first marker and with others as spaces."""
    if not text:
        return []
    marked = " " + text.replace(MARK, " ")
    return [c[1:] for c in CHUNK.findall(marked)] if "  " in marked else marked[1:].split(" ")


Entry = tuple[int, str, str]  # how many ids, the ids joined by commas, the decoded chunk


class ChunkTable:
    """Ids of a model's chunks: those of a table, and others as they come."""

    def __init__(self, model_path: str, entries: dict[str, Entry] | None = None, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.model.get_piece_size()
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(size)):
            raise ValueError("pieces of this model cross whitespace markers")
        self.mark = self.model.piece_to_id(MARK)
        self.max_chunks = max_chunks
        self.entries = entries or {}
        self.rare: dict[str, Entry] = {}

    def segment(self, chunk: str) -> Entry:
        """The entry of a chunk; the model itself adds the first marker."""
        ids = self.model.encode(chunk) if chunk else [self.mark]
        return len(ids), ",".join(map(str, ids)), " " + self.model.decode(ids)

    def missing(self, chunk: str) -> Entry:
        found = self.rare.get(chunk)
        if found is None:
            if len(self.rare) >= self.max_chunks:
                self.rare.clear()
            found = self.rare[chunk] = self.segment(chunk)
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for entry in self.lookup(text) for i in entry[1].split(",")]

    def lookup(self, text: str | None) -> list[Entry]:
        """Entries of a text's chunks in order."""
        get, missing = self.entries.get, self.missing
        return [get(c) or missing(c) for c in chunks_of(text)]


@lru_cache(maxsize=2)
def model_of(model_path: str) -> ChunkTable:
    """A table without entries, to segment with."""
    return ChunkTable(model_path)


COUNTS = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("n", T.LongType())])
ENTRIES = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])


def distinct_chunks(docs: DataFrame, text_col: str = "text", max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(chunk, n): how often each chunk of at most LONGEST_CHUNK characters comes up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(c, n) for c, n in held.items() if len(c) <= LONGEST_CHUNK]
            held.clear()
            return record_batch(COUNTS, {"chunk": [c for c, _ in kept], "n": [n for _, n in kept]})

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.slice(at, SLICE_ROWS).column(0).to_pylist():
                    held.update(chunks_of(text))
                    if len(held) >= max_chunks:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, COUNTS).groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, text_col: str, path: str, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """(chunk, size, ids, decoded) of the chunks seen most often, twice at least; each is segmented once.

    How often a chunk must be seen is read from a histogram of bounded size, so that the table has
    ``table_chunks`` rows at most.
    """
    counts = checkpoint(distinct_chunks(docs, text_col).where("n > 1"))
    at = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(16 * F.log2(F.col("n") / 1000)))
    total, least = 0, None
    for row in sorted(counts.groupBy(at.alias("at")).count().collect(), reverse=True):
        total += row["count"]
        if total > table_chunks:
            break
        least = row["at"]
    often = counts.where(at >= least if least is not None else F.lit(False))

    def work(chunks: list) -> Iterator[dict]:
        found = [model_of(path).segment(c) for c in chunks]
        yield {"chunk": chunks, "size": [f[0] for f in found], "ids": [f[1] for f in found], "decoded": [f[2] for f in found]}

    cores = docs.sparkSession.sparkContext.defaultParallelism
    return explode_columns(often.repartition(cores), ["chunk"], ENTRIES, work)


def encode_decode(
    docs: DataFrame,
    *,
    text_col: str = "text",
    model_path: str | None = None,
    keep: list[str] | None = None,
    table_chunks: int = TABLE_CHUNKS,
    with_ids: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, and on request ``ids`` and ``decoded``."""
    path = model_path or default_model()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text

    # at most ``table_chunks`` rows of bounded length
    columns = chunk_table(docs, text_col, path, table_chunks).toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast({c: e for c, *e in zip(*columns.values(), strict=True)})
    known: list[ChunkTable] = []

    def work(texts: list) -> list:
        if not known:
            known.append(ChunkTable(path, shared.value))
        chunks = known[0]
        counts, ids_sha, decoded_sha, all_ids, decoded = [], [], [], [], []
        for text in texts:
            found = chunks.lookup(text)
            joined = ",".join([x[1] for x in found])
            plain = "".join([x[2] for x in found])[1:]
            counts.append(sum([x[0] for x in found]))
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(plain.encode()).hexdigest())
            if with_ids:
                all_ids.append([int(i) for i in joined.split(",")] if joined else [])
            if with_text:
                decoded.append(plain)
        return [counts, ids_sha, decoded_sha] + [all_ids] * with_ids + [decoded] * with_text

    return append_columns(docs, [text_col], fields, work, keep)
