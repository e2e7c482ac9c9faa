"""Substring dedup: passages that repeat across documents, found by collinear chaining.

Seeds are five-word shingles, winnowed: of every ``window`` shingles in a row the one with the least
hash is a seed, so two documents that share ``window + 4`` words in a row share a seed.  Chunks of
documents count their seeds, counts are added up by hash, and a bitmap of the seeds that repeat keeps
the others out of what follows.  A repeated seed is matched with the first document that has it and
with the last one before its own, and so with the first that has the 16, 36 and 40 words that begin
with it: a passage in n documents gives a few times n matches and not all pairs, and an exact run of
43 words meets a document with 40 of them, wherever its lines stand.  A document's matches with one
other document are chained: the best chain that ends in a match is found through a Fenwick tree over
the other document's positions, with a cost for every word skipped on either side.  Chains are cut at
long gaps and aligned word by word between and beyond their seeds; a part counts as a passage if it has
``min_words`` words and a similarity (twice the aligned equal words over the words of both sides) of
``similarity`` or more.

Every chain is aligned, but for those that could only give what lies within a passage of the document
found before; passages within others of their document are left out at the end, so the result doesn't
hang on how Spark deals out the chains.

Equal texts are one unit; only its first row is searched, and the others have the whole text as their
passage.  What one task gathers is bounded: the counts of a part of the hashes (about four million seeds), a seed's places (a seed
with more than ``hot`` of them is dealt out to several keys, whose first documents are then linked), or
the matches of one document.

Cases: null ids have no result; null and short texts have no passages; rows with equal id and text are
one; an id with several texts has each text searched, and the passages of each name its digest; ties
between occurrences go to the least id and its first position; repeats within one document are left
alone; an empty table gives no rows; extra columns are ignored by ``passages`` and kept by
``without_passages``; a very long text is read, chained and aligned whole, in memory that grows with
its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpoint, numbered
from .arrow import append_columns, fresh, lists, nested, record_batch
from .components import BROADCAST_IDS, small

WIDTH = 5
WINDOW = 4  #: at most 16
BITMAP_HASHES = 1 << 28  #: beyond so many repeated seeds all seeds are shuffled again, not those that a bitmap lets through
CHUNK = 1 << 20  #: seeds that a task counts before it passes them on
PART_SEEDS = 1 << 22  #: seeds of a part of the hashes that a task adds up at once; beyond it they are grouped one by one
HOT = 50_000  #: places of a seed that one key takes
HOT_SEEDS = 100_000  #: so many of the hottest seeds have a number of keys of their own; other hot ones share one
GRID = 8  #: ranges of words begin and end at multiples of this, so that chains share them
LENGTHS = (16, 36, 40)  #: words from a seed on whose first occurrences are partners too
MIN_WORDS = 40
SIMILARITY = 0.8
GAP_COST = 0.1
MAX_GAP = 40
MARGIN = MIN_WORDS  #: words beyond a chain's ends that alignment may take, ``min_words`` at least: one seed can be anywhere in a passage
MULTIPLIER = 0x9E3779B97F4A7C15

NO_SPACE = bytes(int(i not in (9, 10, 11, 12, 13, 32)) for i in range(256))
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
BLOCK = 1 << 20
ROWS_BLOCK = 1 << 17  #: bytes of texts that are worked on as one, so that arrays of eight bytes for each stay in a core's cache


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, from 0 to ``size``."""
    steps = np.full(size + 1, np.uint64(1))
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _words_of(data: bytes, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in a word, and at which places (one more than bytes) a word goes on; none does at ``rows``."""
    word = np.frombuffer(data.translate(NO_SPACE), bool)
    on = np.concatenate([[False], word[1:] & word[:-1], [False]])
    if rows is not None:
        on[rows] = False
    return word, on


def _block_hashes(data: bytes, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the words of a block, from running sums of its bytes, and where they start; no word goes on at a place in ``rows``."""
    letters = np.frombuffer(data, np.uint8)
    word, on = _words_of(data, rows)
    starts, ends = np.flatnonzero(word & ~on[:-1]), np.flatnonzero(word & ~on[1:]) + 1
    powers, inverses = _powers(max(BLOCK, 1 << max(0, len(data)).bit_length()) if len(data) > 2 * ROWS_BLOCK else 2 * ROWS_BLOCK if len(data) > 4096 else 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.add(letters, 1, dtype=np.uint64) * powers[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverses[starts]), starts


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word; words are cut at ASCII white space, A-Z in lower case."""
    data = (text or "").encode().lower()
    if len(data) <= BLOCK:
        return _block_hashes(data)[0]
    parts, at = [], 0
    while at < len(data):
        end = len(data) if at + BLOCK >= len(data) else max(data.rfind(c, at, at + BLOCK) for c in b" \t\n\v\f\r") + 1
        if end <= at:  # a word longer than a block ends at the next white space
            found = [i for c in b" \t\n\v\f\r" if (i := data.find(c, at)) >= 0]
            end = min(found) if found else len(data)
        parts.append(_block_hashes(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h *= np.uint64(MULTIPLIER)
        h += words[j : j + n]
    return _mixed(h)


def winnow(h: np.ndarray, window: int = WINDOW, sizes: np.ndarray | None = None) -> np.ndarray:
    """Positions of seeds; of a run of equal shingles only the first can be one.  ``sizes`` are those of texts, if there are several."""
    sizes = np.array([len(h)]) if sizes is None else sizes
    if not len(h):
        return np.zeros(0, np.int64)
    heads = np.cumsum(sizes) - sizes
    chosen = np.zeros(len(h), bool)
    for start, n in zip(heads[(sizes > 0) & (sizes <= window)].tolist(), sizes[(sizes > 0) & (sizes <= window)].tolist(), strict=True):
        chosen[start + h[start : start + n].argmin()] = True
    if len(h) >= window:
        # the place within sixteen takes the lowest bits, so the least value of a window tells where it is
        place = np.arange(len(h)) - np.repeat(heads, sizes)
        low = (h & ~np.uint64(15)) | (place & 15).astype(np.uint64)
        size = 1
        while 2 * size <= window:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < window:
            low = np.minimum(low[: size - window], low[window - size :])
        starts = np.flatnonzero((place + window <= np.repeat(np.where(sizes > window, sizes, 0), sizes))[: len(low)])
        chosen[starts + (((low[starts] & np.uint64(15)).astype(np.int64) - place[starts]) & 15)] = True
    again = np.concatenate([[False], h[1:] == h[:-1]])
    again[heads[sizes > 0]] = False
    return np.flatnonzero(chosen & ~again)


def run_hashes(words: np.ndarray, at: np.ndarray, length: int, ends: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ma.MaskedArray:
    """32-bit hashes of the ``length`` words from each place on; masked where the text, whose end is in ``ends``, ends before."""
    sums = run_sums(words) if sums is None else sums
    short = at + length > (len(words) if ends is None else ends)
    h = _mixed((sums[np.where(short, at, at + length)] - sums[at]) * _powers(_run_size(words))[1][at]) >> np.uint64(32)
    return np.ma.MaskedArray(h.astype(np.uint32).view(np.int32), short)


def _run_size(words: np.ndarray) -> int:
    return 1 << max(16, len(words).bit_length())


def run_sums(words: np.ndarray) -> np.ndarray:
    """Running sums of words, from which the hashes of runs of any length are made."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_run_size(words))[0][: len(words)], out=sums[1:])
    return sums


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last row + 1, bytes, where each row starts in them) of about ROWS_BLOCK bytes of the texts (null: empty) at a time."""
    texts = texts.fill_null("")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, at = memoryview(texts.buffers()[2] or b""), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ROWS_BLOCK, "right")) - 1)
        yield at, to, bytes(data[ends[at] : ends[to]]), ends[at:to] - ends[at]
        at = to


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of words, hashes of all words) of batches (doc, text), for texts of about ROWS_BLOCK bytes at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, to, data, rows in _pieces(batch.column(1)):
            if len(data) > 2 * ROWS_BLOCK:  # one long text
                words = word_hashes(data.decode())
                yield ids[at:to], np.array([len(words)]), words
            else:
                words, starts = _block_hashes(data.lower(), rows)
                yield ids[at:to], np.diff(np.searchsorted(starts, rows), append=len(starts)), words


def with_counts(docs: DataFrame) -> DataFrame:
    """(doc, text_sha256, n_words) of documents (doc, text, text_sha256); a null text has null words."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField(DIGEST, T.StringType()), T.StructField("n_words", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            for _, _, data, rows in _pieces(batch.column(1)):
                word, on = _words_of(data, rows)
                n.append(np.diff(np.searchsorted(np.flatnonzero(word & ~on[:-1]), rows), append=np.count_nonzero(word & ~on[:-1])))
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield record_batch(schema, {"doc": batch.column(0), DIGEST: batch.column(2), "n_words": np.ma.MaskedArray(np.concatenate(n), none)})

    return docs.select("doc", "text", DIGEST).mapInArrow(work, schema)


def _seeds_of(n_words: np.ndarray, words: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, place among all words) of the seeds of texts that have ``n_words`` of the words, one after the other."""
    ends = np.cumsum(n_words)
    whole = np.ones(len(words), bool)  # a shingle begins here and ends within the text
    for k in range(1, width):
        whole[(ends - k)[n_words >= k]] = False
    sizes = np.maximum(0, n_words - width + 1)
    places = np.flatnonzero(whole)
    h = shingle_hashes(words, width)[places] if len(places) else np.zeros(0, np.uint64)
    at = winnow(h, window, sizes)
    return h[at], np.repeat(np.arange(len(sizes)), sizes)[at], places[at]


COUNTS = T.StructType([T.StructField("part", T.LongType())] + [T.StructField(n, T.ArrayType(T.LongType() if n == "h" else T.IntegerType())) for n in ("h", "docs", "places")])
REPEATED = T.StructType([T.StructField(n, T.LongType()) for n in ("h", "docs", "places")])


def repeated_seeds(docs: DataFrame, width: int = WIDTH, window: int = WINDOW, chunk: int = CHUNK, n_words: int = 0) -> DataFrame:
    """(h, docs, places): seeds of more than one of the documents (doc, text), with how many have it and how often.

    A task adds up what it reads, ``chunk`` seeds at a time, so a seed of very many documents is sent
    once a chunk; a row holds the seeds of one part of the hashes, and a part's rows are added up
    together.  ``n_words`` of all documents tell how many seeds a part can have; where that may be too
    many for a task's memory, Spark groups the seeds by hash, which can go to disk.
    """
    parts = np.uint64(4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def added(h: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[starts], *[np.add.reduceat(n[order], starts) for n in numbers]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n, m = added(*map(np.concatenate, zip(*held, strict=True)))
            part = h % parts
            order = np.argsort(part, kind="stable")
            names, starts = np.unique(part[order], return_index=True)
            cut = [np.split(v[order], starts[1:]) for v in (h.view(np.int64), n.astype(np.int32), m.astype(np.int32))]
            held.clear()
            return record_batch(COUNTS, dict(zip(COUNTS.names, [names.astype(np.int64), *cut], strict=True)))

        for _, n_words, words in _blocks(batches):
            h, text, _ = _seeds_of(n_words, words, width, window)
            if len(h):
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                starts = np.flatnonzero(_changes(h, text))  # what one text has of a seed
                held.append((h[starts], np.ones(len(starts), np.int64), np.diff(np.append(starts, len(h)))))
                size += len(starts)
            if size >= chunk:
                yield flush()
                size = 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def flush() -> pa.RecordBatch:
            h, n, m = added(*map(np.concatenate, zip(*held, strict=True)))
            again = n > 1
            held.clear()
            return record_batch(REPEATED, {"h": h[again], "docs": n[again], "places": m[again]})

        for batch in batches:
            for name, *arrays in zip(batch.column(0).to_pylist(), *map(lists, batch.columns[1:]), strict=True):
                if held and name != part:
                    yield flush()
                part = name
                held.append(tuple(a.astype(np.int64) for a in arrays))
        if held:
            yield flush()

    counts = docs.mapInArrow(count, COUNTS)
    if n_words > PART_SEEDS * int(parts):
        each = counts.select(F.explode(F.arrays_zip("h", "docs", "places")).alias("s")).groupBy(F.col("s.h").alias("h"))
        return each.agg(*[F.sum(F.col(f"s.{n}").cast("long")).alias(n) for n in ("docs", "places")]).where("docs > 1")
    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(add, REPEATED)


def bitmap(hashes: DataFrame, limit: int = BITMAP_HASHES) -> Broadcast | None:
    """Bits at the last places of the hashes ``h``, eight bits or more for each (four beyond 2^27); None beyond ``limit``."""
    n = hashes.count()
    if n > limit:
        return None
    size = 1 << min(30, max(15, (8 * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1).cast("long")) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for k, part in rows:
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


SEEDS = T.StructType(
    [T.StructField("h", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType())]
    + [T.StructField(f"run{n}", T.IntegerType()) for n in LENGTHS]
)


def seeds(docs: DataFrame, width: int = WIDTH, window: int = WINDOW, only: Broadcast | None = None, hot: dict[int, int] | None = None, warm: tuple[Broadcast, int] | None = None) -> DataFrame:
    """(h, salt, doc, pos, runs) of documents (doc, text), without most of those that aren't in the bitmap ``only``.

    ``run16`` and so on are hashes of so many words from the seed on, null where the text ends before.
    ``salt`` is the document's share of a seed in ``hot``, which has the number of its keys, or in the
    bitmap of ``warm``, whose seeds have one number of keys; else zero.
    """
    dealt = sorted((hot or {}).items())

    def within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        place = h & np.uint64(8 * len(bits) - 1)
        return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    hot_hashes, hot_keys = np.array([h for h, _ in dealt], np.int64), np.array([n for _, n in dealt], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n_words, words in _blocks(batches):
            h, text, at = _seeds_of(n_words, words, width, window)
            if only is not None:
                kept = within(only.value, h)
                h, text, at = h[kept], text[kept], at[kept]
            doc, ends = ids.astype(np.int64)[text], np.cumsum(n_words)
            found, keys = h.view(np.int64), np.zeros(len(h), np.int64)
            if warm is not None:
                keys[within(warm[0].value, h)] = warm[1]
            if len(hot_hashes):
                k = np.minimum(np.searchsorted(hot_hashes, found), len(hot_hashes) - 1)
                keys = np.where(hot_hashes[k] == found, hot_keys[k], keys)
            salt = np.where(keys > 0, 1 + (doc * 0x9E3779B1 >> 7 & 0x7FFFFFFF) % np.maximum(keys, 1), 0).astype(np.int32)
            sums = run_sums(words)
            runs = [run_hashes(words, at, n, ends[text], sums) for n in LENGTHS]
            yield record_batch(SEEDS, dict(zip(SEEDS.names, (found, salt, doc, (at - (ends - n_words)[text]).astype(np.int32), *runs), strict=True)))

    return docs.select("doc", "text").mapInArrow(work, SEEDS)


MATCHES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("at", T.IntegerType())])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])])


def partners(h: np.ndarray, salt: np.ndarray, doc: np.ndarray, pos: np.ndarray, runs: list[np.ma.MaskedArray]) -> np.ndarray:
    """Rows (doc, pos, source, at): seeds of one key or run with its first document, those of a key also with the last one before."""
    order = np.lexsort((pos, doc, salt, h))
    h, salt, doc, pos = (c[order] for c in (h, salt, doc, pos))
    key = np.cumsum(_changes(h, salt)) if len(h) else h
    found = []
    for run in (None, *runs):
        if run is None:
            of, d, p = key, doc, pos
        else:
            rows = np.flatnonzero(~np.ma.getmaskarray(run)[order])
            of = (key[rows] << 32) | (np.ma.getdata(run)[order[rows]].astype(np.int64) & 0xFFFFFFFF)
            again = np.argsort(of, kind="stable")  # documents and places stay in order
            of, rows = of[again], rows[again]
            d, p = doc[rows], pos[rows]
        if not len(of):
            continue
        group, holder = _changes(of), _changes(of, d)
        heads = np.flatnonzero(holder)  # a document's first place in a group
        first = np.flatnonzero(group)[np.cumsum(group) - 1]
        before = np.concatenate([[0], heads[:-1]])[np.cumsum(holder) - 1]
        links = [first] if run is not None else [first, np.maximum(first, before)]
        for link in links:
            later = np.flatnonzero(d != d[link])
            found.append((d[later], p[later], d[link[later]], p[link[later]]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    if not len(columns[0]):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    return np.column_stack(columns)[_changes(*columns)]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of rows of SEEDS that come sorted by h and salt."""

    def out(columns: list) -> pa.RecordBatch:
        m = partners(*columns[:4], columns[4:])
        return record_batch(MATCHES, dict(zip(MATCHES.names, m.T, strict=True)))

    held: list = []
    for batch in batches:
        now = []
        for i, c in enumerate(batch.columns):
            values = c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            now.append(values if i < 4 else np.ma.MaskedArray(values, c.is_null().to_numpy(zero_copy_only=False)))
        if held:
            now = [np.ma.concatenate(x) if i >= 4 else np.concatenate(x) for i, x in enumerate(zip(held, now, strict=True))]
        starts = np.flatnonzero(_changes(now[0], now[1])) if len(now[0]) else np.zeros(1, np.int64)
        cut = int(starts[-1])  # the last key may go on in the next batch
        if cut:
            yield out([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held and len(held[0]):
        yield out(held)


def matches(docs: DataFrame, width: int = WIDTH, window: int = WINDOW, hot: int = HOT, n_words: int = 0) -> DataFrame:
    """(doc, pos, source, at): seeds of a document that an earlier one has too, with their place there."""
    repeated = checkpoint(repeated_seeds(docs, width, window, n_words=n_words))
    dealt = repeated.where(F.col("places") > hot)
    listed = dealt.orderBy(F.desc("places"), "h").limit(HOT_SEEDS).collect()
    keys, warm = {r["h"]: 1 + r["places"] // hot for r in listed}, None
    if len(listed) == HOT_SEEDS:  # those that aren't listed are in a bitmap; they have no more places than the last one that is
        most = listed[-1]["places"]
        bits = bitmap(dealt.where((F.col("places") < most) | (F.col("places") == most) & (F.col("h") > listed[-1]["h"])))
        if bits is None:
            raise ValueError("too many hot seeds: raise hot")
        warm = (bits, 1 + most // hot)
    found = seeds(docs, width, window, bitmap(repeated), keys, warm)
    if keys:
        found = checkpoint(found)
    out = found.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_link, MATCHES)
    if keys:  # the first documents of a hot seed's keys are linked with the first of all
        for run in (None, *[f"run{n}" for n in LENGTHS]):
            key = ["h"] if run is None else ["h", run]
            rows = found.where("salt > 0" if run is None else f"salt > 0 and {run} is not null")
            local = rows.groupBy(*key, "salt").agg(F.min(F.struct("doc", "pos")).alias("f"))
            first = local.groupBy(*key).agg(F.min("f").alias("s"), F.count("*").alias("keys")).where("keys > 1")
            out = out.unionByName(local.join(first, key).where("f.doc <> s.doc").select("f.doc", "f.pos", F.col("s.doc").alias("source"), F.col("s.pos").alias("at")))
    return out


def chain(x: np.ndarray, y: np.ndarray, width: int = WIDTH, gap_cost: float = GAP_COST) -> list[np.ndarray]:
    """Chains over matches (x rising): arrays of indexes whose x and y both rise, best chains first.

    A chain's value is ``width`` for each match less ``gap_cost`` for each word it moves on in x and
    in y.  That cost splits into a part of either end, so the best way to reach a match is the
    largest value among those with a smaller y, a prefix maximum of a Fenwick tree.
    """
    n = len(x)
    if n == 1 or ((np.diff(x) > 0).all() and (np.diff(y) > 0).all()):
        return [np.arange(n)]  # every match continues the one before
    levels, rank = np.unique(y, return_inverse=True)
    size = len(levels)
    tree_value, tree_index = [0.0] * (size + 1), [-1] * (size + 1)
    value, parent = [0.0] * n, [-1] * n
    along = (gap_cost * (x + y)).tolist()
    ranks, order_x = rank.tolist(), x.tolist()
    waiting: list[int] = []  # matches at the x at hand, not to be chained with each other

    def put(i: int) -> None:
        v, r = value[i] + along[i], ranks[i] + 1
        while r <= size:
            if tree_index[r] < 0 or v > tree_value[r]:
                tree_value[r], tree_index[r] = v, i
            r += r & -r

    for i in range(n):
        if waiting and order_x[waiting[0]] != order_x[i]:
            for j in waiting:
                put(j)
            waiting.clear()
        best, at, r = 0.0, -1, ranks[i]
        while r > 0:
            if tree_index[r] >= 0 and (at < 0 or tree_value[r] > best):
                best, at = tree_value[r], tree_index[r]
            r -= r & -r
        gain = best - along[i] if at >= 0 else 0.0
        value[i] = width + max(0.0, gain)
        parent[i] = at if gain > 0 else -1
        waiting.append(i)
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: (-value[i], i)):
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = parent[i]
        if path:
            out.append(np.array(path[::-1]))
    return out


def cut(x: np.ndarray, y: np.ndarray, max_gap: int = MAX_GAP) -> list[tuple[np.ndarray, np.ndarray]]:
    """A chain's parts between gaps beyond ``max_gap`` words on either side."""
    at = np.flatnonzero((np.diff(x) > max_gap) | (np.diff(y) > max_gap)) + 1
    return list(zip(np.split(x, at), np.split(y, at), strict=True))


def _extend(equal: np.ndarray) -> int:
    """How far to go along ``equal`` so that matches outweigh mismatches best."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1.0, -1.5))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each word of ``a`` the word of ``b`` it is aligned with and equals, or -1.

    ``x`` and ``y`` are a chain's positions.  Between two matches on one diagonal words stand face to
    face; where the diagonal changes, one block is skipped at the place that leaves most words equal.
    """
    to = np.full(len(a), -1, np.int64)

    def facing(i: int, j: int, n: int) -> None:
        same = np.flatnonzero(a[i : i + n] == b[j : j + n])
        to[i + same] = j + same

    turns = np.flatnonzero(np.diff(y - x)) + 1
    starts, ends = np.concatenate([[0], turns]), np.concatenate([turns, [len(x)]]) - 1
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        facing(x[s], y[s], int(x[e] - x[s]) + width)
    for e in ends[:-1].tolist():
        i, j, i2, j2 = int(x[e]), int(y[e]), int(x[e + 1]), int(y[e + 1])
        to[i:i2] = -1
        n = min(i2 - i, j2 - j)
        ahead = np.concatenate([[0], np.cumsum(a[i : i + n] == b[j : j + n])])
        behind = np.concatenate([[0], np.cumsum((a[i2 - n : i2] == b[j2 - n : j2])[::-1])])
        head = int((ahead + behind[::-1]).argmax())
        facing(i, j, head)
        facing(i2 - (n - head), j2 - (n - head), n - head)
    i, j = int(x[0]), int(y[0])
    n = min(i, j)
    n = _extend((a[i - n : i] == b[j - n : j])[::-1])
    facing(i - n, j - n, n)
    i, j = int(x[-1]) + width, int(y[-1]) + width
    n = max(0, min(len(a) - i, len(b) - j))
    facing(i, j, _extend(a[i : i + n] == b[j : j + n]))
    return to


class Widest:
    """The first of the largest values of a range, by a table over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.table = values, [np.arange(len(values))]
        while (1 << len(self.table)) <= len(values):
            last, half = self.table[-1], 1 << len(self.table) - 1
            left, right = last[:-half], last[half:]
            self.table.append(np.where(values[right] > values[left], right, left))

    def __call__(self, start: int, end: int) -> int:
        k = (end - start).bit_length() - 1
        left, right = int(self.table[k][start]), int(self.table[k][end - (1 << k)])
        return right if self.values[right] > self.values[left] else left


def similar_parts(to: np.ndarray, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, equal words) of an alignment's similar parts.

    A part that isn't similar enough is cut at its longest stretch without equal words, the first of equally long ones.
    """
    out = []
    equal = np.flatnonzero(to >= 0)
    theirs, widest = to[equal], None
    todo = [(0, len(equal))]
    while todo:
        s, e = todo.pop()
        if e - s < 1:
            continue
        first, last = int(equal[s]), int(equal[e - 1]) + 1
        low, high = int(theirs[s]), int(theirs[e - 1]) + 1
        if max(last - first, high - low) < min_words:
            continue
        if 2 * (e - s) >= similarity * (last - first + high - low):
            if last - first >= min_words:
                out.append((first, last, low, high, e - s))
            continue
        if e - s < 2:
            continue
        if widest is None:
            widest = Widest(np.diff(equal) + np.abs(np.diff(theirs)))
        middle = widest(s, e - 1) + 1
        todo += [(s, middle), (middle, e)]
    return sorted(out)


CHAINS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc", "source")]
    + [T.StructField(n, T.IntegerType()) for n in ("ya", "yb")]
    + [T.StructField(n, T.ArrayType(T.ArrayType(T.IntegerType()))) for n in ("x", "y")]
)


def turns(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last match of each stretch of a chain on one diagonal, which is all that alignment asks for."""
    turn = np.diff(y - x) != 0
    kept = np.concatenate([[True], turn]) | np.concatenate([turn, [True]])
    return x[kept], y[kept]


def chains(found: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """Chains of matches: (doc, source, the source's word range to align, and for each chain the seeds' places in either text).

    Chains of a document with one range of a source are one row: where either text repeats itself, the
    same words of the source are matched again and again.
    """
    margin = max(MARGIN, min_words)

    def chained(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        new = _changes(doc, source, pos, at)  # a match can be found in several ways
        doc, source, pos, at = (c[new] for c in (doc, source, pos, at))
        starts = np.flatnonzero(_changes(doc, source))
        size = np.diff(np.append(starts, len(doc)))
        rows = [(s, pos[s : s + 1], at[s : s + 1]) for s in starts[size == 1].tolist()]
        for s, n in zip(starts[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            p, q = pos[s : s + n], at[s : s + n]
            for path in chain(p, q, width):
                rows += [(s, *turns(x, y)) for x, y in cut(p[path], q[path])]
        ends = np.array([(y[0], y[-1]) for _, _, y in rows])
        low, high = np.maximum(0, ends[:, 0] - margin) // GRID * GRID, -(-(ends[:, 1] + width + margin) // GRID) * GRID
        ranges: dict[tuple[int, int, int], tuple[list, list]] = {}
        for (s, x, y), ya, yb in zip(rows, low.tolist(), high.tolist(), strict=True):
            xs, ys = ranges.setdefault((s, ya, yb), ([], []))
            xs.append(x)
            ys.append(y)
        of = np.array([k[0] for k in ranges])
        columns = (doc[of], source[of], [k[1] for k in ranges], [k[2] for k in ranges], [v[0] for v in ranges.values()], [v[1] for v in ranges.values()])
        return record_batch(CHAINS, dict(zip(CHAINS.names, columns, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            starts = np.flatnonzero(_changes(now[0], now[1])) if len(now[0]) else np.zeros(1, np.int64)
            last = int(starts[-1])  # the last pair of documents may go on in the next batch
            if last:
                yield chained(*[x[:last] for x in now])
            held = [x[last:] for x in now]
        if len(held[0]):
            yield chained(*held)

    order = ["doc", "source", "pos", "at"]
    return found.select(*order).repartition("doc").sortWithinPartitions(*order).mapInArrow(work, CHAINS)


PASSAGES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc", "start_word", "end_word", "source", "source_start_word", "source_end_word", "equal_words")]
    + [T.StructField("similarity", T.DoubleType())]
)


def _words(docs: DataFrame) -> DataFrame:
    """(doc, words): 16-bit hashes of the words of documents (doc, text)."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("words", T.ArrayType(T.ShortType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n_words, words in _blocks(batches):
            short = (words >> np.uint64(48)).astype(np.uint16).view(np.int16)
            yield record_batch(schema, {"doc": ids.astype(np.int64), "words": pa.ListArray.from_arrays(np.append(0, np.cumsum(n_words)).astype(np.int32), short)})

    return docs.select("doc", "text").mapInArrow(work, schema)


def reach(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> tuple[int, int]:
    """The words of ``a`` that an alignment of a chain can touch: from the first match to the last, and what ``align`` adds at either end."""
    i, j = int(x[0]), int(y[0])
    n = min(i, j)
    before = _extend((a[i - n : i] == b[j - n : j])[::-1])
    k, m = int(x[-1]) + width, int(y[-1]) + width
    n = max(0, min(len(a) - k, len(b) - m))
    return i - before, k + _extend(a[k : k + n] == b[m : m + n])


def covering(rows: list[tuple]) -> list[tuple]:
    """Passages without those that the ones before and behind them cover together; none of ``rows`` lies within another."""
    rows = sorted(rows, key=lambda r: r[1])
    out: list[tuple] = []
    i = 0
    while i < len(rows):
        if out and rows[i][1] <= out[-1][2]:
            while i + 1 < len(rows) and rows[i + 1][1] <= out[-1][2]:
                i += 1  # of those that go on from the last one the one that reaches furthest
        out.append(rows[i])
        i += 1
    return out


class Passages:
    """Passages of one document, of which none lies within another; of equal ranges the one with the least source stays."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def holds(self, start: int, end: int, source: int) -> bool:
        """Whether whatever lies from ``start`` to ``end`` and comes from ``source`` is within a passage that would stay."""
        return any(r[1] <= start and end <= r[2] and ((r[1], r[2]) != (start, end) or r[3] < source) for r in self.rows)

    def add(self, row: tuple) -> None:
        start, end = row[1:3]
        if any(r[1] <= start and end <= r[2] and ((r[1], r[2]) != (start, end) or r[3:] <= row[3:]) for r in self.rows):
            return
        self.rows = [r for r in self.rows if not (start <= r[1] and r[2] <= end)]
        self.rows.append(row)


def _aligned(found: DataFrame, docs: DataFrame, width: int, min_words: int, similarity: float, broadcast_ids: int) -> DataFrame:
    """The passages of chains, without some of those that lie within others.

    The chains of a row, which are those with one range of a source, are aligned together, and of
    their passages those stay that cover all of them: a stretch of repeated words gives a passage for
    each stretch of the source and not for each way to lay one over the other.  A row is left out if all that
    its alignments could touch lies within passages that are found already.  Which rows of a document come
    together hangs on the plan; what is left when ``widest`` has dropped all that lies within others doesn't.
    """
    ids = checkpoint(found.select("doc").unionByName(found.select(F.col("source").alias("doc"))).distinct())
    words = _words(docs.join(small(ids, broadcast_ids), "doc", "left_semi"))  # the texts are cut down to those with chains, where their ids are few
    # a source's ranges are gathered first, so its words are read and sent once
    ranges = found.groupBy("source").agg(F.collect_set(F.struct("ya", "yb")).alias("ranges"))
    cut_out = F.transform("ranges", lambda r: F.struct(r["ya"].alias("ya"), r["yb"].alias("yb"), F.slice("words", r["ya"] + 1, r["yb"] - r["ya"]).alias("theirs")))
    theirs = ranges.join(words.withColumnRenamed("doc", "source"), "source").select("source", F.explode(cut_out).alias("r")).select("source", "r.*")
    # merged by document, so that its chains come one behind the other
    both = found.join(theirs, ["source", "ya", "yb"]).join(words.hint("merge"), "doc").select("doc", "source", "ya", "x", "y", "theirs", "words")
    margin = max(MARGIN, min_words)

    def of_row(a: np.ndarray, row: tuple, known: Passages) -> list[tuple]:
        doc, source, ya, xs, ys, b, _ = row
        todo = []
        for x, y in zip(xs, ys, strict=True):
            xa = max(0, int(x[0]) - margin)
            mine, x, y = a[xa : int(x[-1]) + width + margin], x - xa, y - ya
            if len(x) == 1 and not _may_hold(mine, b, int(x[0]), int(y[0]), width, min_words, similarity):
                continue
            start, end = reach(mine, b, x, y, width)
            if end - start >= min_words:
                todo.append((xa, mine, x, y, xa + start, xa + end))
        if all(known.holds(start, end, source) for *_, start, end in todo):
            return []
        own = Passages()
        for xa, mine, x, y, start, end in todo:
            if not own.holds(start, end, source):
                for s, e, low, high, equal in similar_parts(align(mine, b, x, y, width), similarity, min_words):
                    own.add((doc, xa + s, xa + e, source, ya + low, ya + high, equal, 2 * equal / (e - s + high - low)))
        return covering(own.rows)

    def of_document(rows: list[tuple]) -> list[tuple]:
        kept = Passages()
        for row in sorted(rows, key=lambda r: (-max(int(x[-1] - x[0]) for x in r[3]), *r[1:3])):
            for passage in of_row(rows[0][6], row, kept):
                kept.add(passage)
        return kept.rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found_in(rows: list[tuple]) -> pa.RecordBatch:
            return record_batch(PASSAGES, dict(zip(PASSAGES.names, zip(*rows, strict=True) if rows else [[]] * len(PASSAGES), strict=True)))

        held: list[tuple] = []  # the chains of one document that come one behind the other
        for batch in batches:
            out, last = [], None
            words = batch.column(6)
            for i, (doc, source, ya, x, y, b) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:3]], *map(nested, batch.columns[3:5]), lists(batch.column(5)), strict=True)):
                if held and held[0][0] != doc:
                    out += of_document(held)
                    held = []
                if not held or last is None:
                    last = words[i].values.to_numpy(zero_copy_only=False)
                held.append((doc, source, ya, [v.astype(np.int64) for v in x], [v.astype(np.int64) for v in y], b, last))
            yield found_in(out)
        if held:
            yield found_in(of_document(held))

    return both.mapInArrow(work, PASSAGES)


def widest(found: DataFrame) -> DataFrame:
    """Passages without those that lie within another one of the document; of equal ranges the one with the least source stays.

    In order of their starts, longer ones first, a passage lies within another if it ends before the furthest end so far.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, furthest = None, -1
        for batch in batches:
            kept = []
            for i, (d, end) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if d != doc:
                    doc, furthest = d, -1
                if end > furthest:
                    furthest = end
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    order = ["doc", "start_word", F.desc("end_word"), "source", "source_start_word", "source_end_word", "equal_words"]
    return found.repartition("doc").sortWithinPartitions(*order).mapInArrow(work, found.schema)


def _may_hold(a: np.ndarray, b: np.ndarray, x: int, y: int, width: int, min_words: int, similarity: float) -> bool:
    """Whether a lone match can be in a passage: its own diagonal, which is all that is aligned then, must hold enough equal words."""
    n, m = min(x, y), min(len(a) - x, len(b) - y)
    return int((a[x - n : x + m] == b[y - n : y + m]).sum()) >= similarity * min_words


DIGEST = "text_sha256"


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def units(docs: DataFrame, id_col: str, text_col: str, broadcast_ids: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Texts (doc, text) that stand first, copies (doc, source, n_words), the names of numbers, and how many words there are in all.

    Where no id has several texts, ids are used as they are and the names are None.  Else ``doc`` is
    a number in the order of id and digest, and the names are (doc, doc_id, text_sha256).
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = checkpoint(with_counts(docs.select(doc.alias("doc"), text.alias("text"), _digest(text).alias(DIGEST)).where("doc is not null")))
    plain = docs.select(doc.alias("doc"), text.alias("text")).where("doc is not null")
    again = checkpoint(rows.groupBy("doc").agg(F.count("*").alias("n"), F.min(DIGEST).alias("a"), F.max(DIGEST).alias("b")).where("n > 1"))
    names = None
    if not again.where("a <> b").isEmpty():
        names = checkpoint(numbered(rows.select("doc", DIGEST).distinct().withColumnRenamed("doc", "doc_id"), [F.col("doc_id"), F.col(DIGEST)], "doc"))
        rows = rows.withColumnRenamed("doc", "doc_id").join(names, ["doc_id", DIGEST]).select("doc", DIGEST, "n_words").distinct()
        plain = plain.withColumn(DIGEST, _digest(F.col("text"))).withColumnRenamed("doc", "doc_id").dropDuplicates(["doc_id", DIGEST])
        plain = plain.join(names, ["doc_id", DIGEST]).select("doc", "text")
    elif not again.isEmpty():  # rows with equal id and text
        ids = small(again.select("doc"), broadcast_ids)
        plain = plain.join(ids, "doc", "left_anti").unionByName(plain.join(ids, "doc", "left_semi").distinct())
    first = rows.groupBy(DIGEST).agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source <> last").select(DIGEST, "source")
    copies = checkpoint(rows.join(first, DIGEST).where("doc <> source").select("doc", "source", "n_words").distinct())
    n_words = rows.agg(F.sum("n_words")).first()[0] or 0
    return plain.join(small(copies.select("doc"), broadcast_ids), "doc", "left_anti"), copies, names, n_words


def _passages(docs: DataFrame, id_col: str, text_col: str, width: int, window: int, min_words: int, similarity: float, broadcast_ids: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Passages by unit, and the units' names if they aren't ids."""
    texts, copies, names, n_words = units(docs, id_col, text_col, broadcast_ids)
    found = checkpoint(chains(matches(texts, width, window, hot, n_words), width, min_words))
    zero = F.lit(0).cast("long")
    whole = copies.where(F.col("n_words") >= min_words).select("doc", zero.alias("start_word"), F.col("n_words").alias("end_word"), "source", zero.alias("source_start_word"), F.col("n_words").alias("source_end_word"), F.col("n_words").alias("equal_words"), F.lit(1.0).alias("similarity"))
    return widest(_aligned(found, texts, width, min_words, similarity, broadcast_ids)).unionByName(whole), names


def passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    broadcast_ids: int = BROADCAST_IDS,
    hot: int = HOT,
) -> DataFrame:
    """Passages of a document that an earlier one has too, as ranges of words (ends exclusive).

    ``text_sha256`` and ``source_text_sha256`` name the texts where an id has several, else they are null.
    """
    found, names = _passages(docs, id_col, text_col, width, window, min_words, similarity, broadcast_ids, hot)
    if names is None:
        none = F.lit(None).cast("string")
        found = found.withColumnsRenamed({"doc": "doc_id", "source": "source_doc_id"}).withColumn(DIGEST, none).withColumn(f"source_{DIGEST}", none)
    else:
        sources = names.select(F.col("doc").alias("source"), F.col("doc_id").alias("source_doc_id"), F.col(DIGEST).alias(f"source_{DIGEST}"))
        found = found.join(names, "doc").join(sources, "source")
    return found.select("doc_id", "start_word", "end_word", "source_doc_id", "source_start_word", "source_end_word", "equal_words", "similarity", DIGEST, f"source_{DIGEST}")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space behind them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = starts[min(a, len(starts) - 1)], starts[min(b, len(starts) - 1)]
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def without_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = "n_chars",
    width: int = WIDTH,
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    broadcast_ids: int = BROADCAST_IDS,
    hot: int = HOT,
) -> DataFrame:
    """``docs`` with each repeated passage left in the first document that has it."""
    found, names = _passages(docs, id_col, text_col, width, window, min_words, similarity, broadcast_ids, hot)
    key, digest, cuts, text = fresh(docs.columns, "doc", DIGEST, "cuts", "kept_text")
    spans = found.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias(cuts))
    on = F.col(f"`{id_col}`").cast("long") == F.col(key)
    if names is None:
        spans = checkpoint(spans)
        ids = small(spans.select(key), broadcast_ids)
        same = docs.join(ids, on, "left_anti")
        joined = docs.join(ids, on, "left_semi").join(spans, on).drop(key)
    else:  # an id doesn't tell the text
        names = names.select(F.col("doc").alias(key), F.col("doc_id").alias(f"{key}_id"), F.col(DIGEST).alias(digest))
        spans = checkpoint(spans.join(names, key).drop(key).withColumnRenamed(f"{key}_id", key))
        on = on & (_digest(F.col(f"`{text_col}`")) == F.col(digest))
        same, joined = docs.join(spans, on, "left_anti"), docs.join(spans, on).drop(key, digest)

    def work(texts: list, cut: list) -> list:
        return [[t if t is None or not c else cut_words(t, [(s["a"], s["b"]) for s in c]) for t, c in zip(texts, cut, strict=True)]]

    out = append_columns(joined, [text_col, cuts], [T.StructField(text, T.StringType())], work, [*docs.columns, cuts])
    named = {text_col: F.col(text)}
    if chars_col and chars_col in docs.columns:
        named[chars_col] = F.length(text).cast(docs.schema[chars_col].dataType)
    changed = out.select(*[named.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return same.unionByName(changed)
