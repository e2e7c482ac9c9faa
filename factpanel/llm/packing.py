"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are the powers of two of the document's
length written in binary (as many pieces of ``max_length`` as fit come first, then the remaining
bits, largest first).  Every piece is a sequence of its own, so no sequence crosses documents and
none is padded; sequences of equal length form a bucket, and a training batch takes all of its
sequences from one bucket.

Cases: a null text is the empty text; an empty text is the end id alone (one piece of length 1);
repeated rows and repeated ids are packed one by one, each with its own sequences; a null id stays
null; an empty table gives no rows; extra columns are ignored, whatever their names.  A very long text is
encoded whole and cut into as many pieces as it takes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import explode_columns, slices

MAX_LENGTH = 1024
END_ID = 0
END_OF_TEXT = "<|endoftext|>"
#: Runs of white space (Unicode's, as the pattern's) from this length on are cut out of a text that the pattern can't pass.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoder(ranks_path: str, whole: bool = False):
    """The vocabulary of byte_bpe_50k.json as ranks, whose ids are the same and which is faster; ``whole`` takes a text as one piece."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("bytes", pat_str=r"(?s).+" if whole else public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def encode(text: str | None, ranks_path: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of a text and the end id, as little-endian unsigned 32-bit integers."""
    ids: list[int] = []
    if text:
        try:
            ids = _encoder(ranks_path).encode(text, allowed_special="all")
        except ValueError:  # the pattern looks ahead behind white space and gives up on a run of a million characters
            ids = _encode_around_space(text, _encoder(ranks_path), _encoder(ranks_path, True))
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


def _encode_around_space(text: str, encoder, whole) -> list[int]:
    """The ids of a text with long runs of white space.

    The pattern takes such a run as one piece, without its last character unless the text or what stands before a special token ends there;
    what stands before and behind that piece is cut as if it stood alone.
    """
    ids, at = [], 0
    for m in LONG_SPACE.finditer(text):
        ends = m.end() == len(text) or text.startswith(END_OF_TEXT, m.end())
        end = m.end() if ends else m.end() - 1
        ids += encoder.encode(text[at : m.start()], allowed_special="all")
        ids += whole.encode_ordinary(text[m.start() : end])
        at = end
    return ids + encoder.encode(text[at:], allowed_special="all")


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """The powers of two, none above ``max_length``, that add up to ``n``, largest first."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    ranks_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids.

    The work is one pass without a shuffle: cutting a document needs nothing but the document, and
    a sequence is one piece.  ``sequence_id`` numbers the rows within the input's partitions, which
    a recomputed task repeats exactly.  ``bucket`` is the binary logarithm of the length.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    path = ranks_path or default_ranks()
    schema = T.StructType([f for f in PIECES.fields if with_ids or f.name != "ids"])

    def work(doc_ids: list, texts: list) -> Iterator[dict]:
        for a, b in slices(texts):
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for doc_id, text in zip(doc_ids[a:b], texts[a:b], strict=True):
                ids = encode(text, path, end_id)
                start, view = 0, memoryview(ids).cast("B")
                for n in piece_lengths(len(ids), max_length):
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(view[4 * start : 4 * (start + n)]))
                    out["doc_tokens"].append(len(ids))
                    out["bucket"].append(n.bit_length() - 1)
                    if with_ids:
                        out["ids"].append(ids[start : start + n].astype(np.int32))
                    start += n
            yield out

    pieces = explode_columns(docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), [id_col, text_col], schema, work)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Stores packed pieces so that each folder holds sequences of one length."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
