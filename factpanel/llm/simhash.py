"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits.  Position ``i`` gets a non-zero vector of ``radius + 1`` bits; the table
of vector ``v`` keys a fingerprint by its bits at the positions whose vectors have an odd product
with ``v``.  The vectors of at most ``radius`` differing positions do not span the space, so some
``v`` is orthogonal to them all, and in its table the two keys are equal: no pair is missed.

Only distinct fingerprints enter the tables.  A bucket is worked on as sorted rows stream by:
small buckets compare shifted columns, larger ones grow components from one fingerprint at a time,
so a bucket gives at most as many links as it has members.  Members of buckets beyond
``large_bucket`` are linked exactly through the points within half the radius of them: two
fingerprints within the radius share such a point, and two that share one are within the radius.

Cases: a null text is the empty text; a text without words has fingerprint zero and links like any
other; repeated rows share a component; rows with a null id take part, and a component without any
id is null; an empty table gives no rows; extra columns are ignored; a very long text is hashed whole, a
block of shingles at a time when bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpoint
from .arrow import append_columns, fresh
from .components import BROADCAST_IDS, connected_components, join_spread, small

DIGEST = "text_sha256"
BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
SHIFTED = 32  #: buckets up to this size compare shifted columns
LARGE_BUCKET = 65_536


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have set, as an unsigned integer."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and space with 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    if len(words) > width:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(BITS) if 2 * counts[i] > len(hashes))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit masks of the 2^(radius+1) - 1 tables."""
    size = (1 << radius + 1) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def grow(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: each fingerprint in turn takes those not yet reached."""
    left, right = [], []
    rest = f
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    empty = np.zeros(0, f.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def bucket_links(radius: int, large_bucket: int):
    """A function for mapInArrow over rows sorted by (table, key, fingerprint).

    It yields links; a member of a bucket beyond ``large_bucket`` comes as a link to itself.
    """

    def links_of(t: np.ndarray, k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(f)))
        group = np.repeat(np.arange(len(starts)), sizes)
        size_of = sizes[group]
        small = np.flatnonzero((size_of > 1) & (size_of <= SHIFTED))
        for d in range(1, SHIFTED):
            small = small[size_of[small] > d]
            i = small[small + d < len(f)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= radius]
            if len(i):
                yield f[i], f[i + d]
        for g in np.flatnonzero(sizes > SHIFTED):
            yield grow(f[starts[g] : starts[g] + sizes[g]], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        hot = None  # the (table, key) of a bucket that is beyond the limit
        for batch in batches:
            t, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.astype(np.int64).view(np.uint64)
            if hot is not None:
                same = (t == hot[0]) & (k == hot[1])
                if same.any():
                    yield out(f[same], f[same])
                    t, k, f = t[~same], k[~same], f[~same]
                if not len(f):
                    continue
                hot = None
            t, k, f = (np.concatenate(x) for x in zip(held, (t, k, f), strict=True))
            if not len(f):
                continue
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                for a, b in links_of(t[:cut], k[:cut], f[:cut]):
                    yield out(a, b)
            held = [t[cut:], k[cut:], f[cut:]]
            if len(held[2]) > large_bucket:
                hot = (held[0][0], held[1][0])
                yield out(held[2], held[2])
                held = [x[:0] for x in held]
        if len(held[2]):
            for a, b in links_of(*held):
                yield out(a, b)

    return run


def large_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links among all fingerprints in ``hot`` (column f), through points within radius / 2."""
    if radius % 2:
        raise ValueError("the radius must be even")
    flips = [signed(sum(1 << i for i in c)) for n in range(radius // 2 + 1) for c in combinations(range(BITS), n)]
    near = np.array(flips, np.int64)
    schema = T.StructType([T.StructField("z", T.LongType()), T.StructField("f", T.LongType())])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(near ^ np.int64(f)), pa.array(np.full(len(near), f, np.int64))], names=["z", "f"])

    around = hot.mapInArrow(points, schema)
    first = around.groupBy("z").agg(F.min("f").alias("a"), F.max("f").alias("last")).where("a <> last")
    return around.join(first, "z").where("f <> a").select("a", F.col("f").alias("b")).distinct()


def links(fingerprints: DataFrame, *, radius: int = RADIUS, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(a, b) that connect every pair of distinct fingerprints (column f) within the radius."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks(radius))])
    rows = fingerprints.select(F.explode(keys).alias("x"), "f").select("x.t", "x.k", "f")
    found = rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(bucket_links(radius, large_bucket), LINKS)
    found = checkpoint(found.distinct())
    hot = found.where("a = b").select(F.col("a").alias("f"))
    pairs = found.where("a <> b")
    return pairs if hot.isEmpty() else pairs.unionByName(large_links(hot, radius))


def _classed(docs: DataFrame, id_col: str, text_col: str, radius: int, width: int, large_bucket: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, text_sha256, f, class, component_id): ``class`` is one fingerprint of those that are linked."""

    def work(texts: list) -> list:
        return [[signed(fingerprint(t, width)) for t in texts]]

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias(DIGEST))
    prints = checkpoint(append_columns(ids, ["text"], [T.StructField("f", T.LongType())], work, ["doc_id", DIGEST]))
    distinct = prints.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("texts"))
    classes = connected_components(links(distinct.select("f"), radius=radius, large_bucket=large_bucket))
    joined = distinct.join(classes.withColumnRenamed("node", "f"), "f", "left").withColumnRenamed("component", "class")
    least = joined.where("class is not null").groupBy("class").agg(F.min("first_id").alias("least_id"))
    named = joined.join(least, "class", "left").select("f", F.coalesce("class", "f").alias("class"), F.coalesce("least_id", "first_id").alias("component_id"), "texts")
    return join_spread(prints, checkpoint(named), "f", "texts", broadcast_ids)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    width: int = SHINGLE,
    large_bucket: int = LARGE_BUCKET,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each document."""
    found = _classed(docs, id_col, text_col, radius, width, large_bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    width: int = SHINGLE,
    large_bucket: int = LARGE_BUCKET,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """``docs`` without near-duplicates: of linked rows the one with the least id, and then digest of its text, stays.

    Rows with equal id and text are one; texts that aren't linked stay, whatever their ids.  Rows
    without an id, which nothing can name, stay.
    """
    found = checkpoint(_classed(docs, id_col, text_col, radius, width, large_bucket, broadcast_ids)).where("doc_id is not null")
    key, digest, own = fresh(docs.columns, "id", DIGEST, "own_sha256")
    ids = checkpoint(found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows"), F.min("component_id").alias("first")))
    again = ids.where("rows > 1").select(key)
    gone = small(ids.where(f"rows > 1 or {key} <> first").select(key), broadcast_ids)
    same_id = F.col(f"`{id_col}`").cast("long") == F.col(key)
    kept = docs.join(gone, same_id, "left_anti")
    if again.isEmpty():
        return kept
    # the texts of a repeated id are told apart by their digests
    first = found.groupBy("class").agg(F.min(F.struct("doc_id", DIGEST)).alias("x")).select(F.col("x.doc_id").alias(key), F.col(f"x.{DIGEST}").alias(digest))
    winners = checkpoint(first.join(again, key))
    texts = docs.join(small(again, broadcast_ids), same_id, "left_semi").withColumn(own, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    rows = texts.join(winners, same_id & (F.col(own) == F.col(digest)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.groupBy(F.col(f"`{id_col}`").cast("long"), own).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("x"))
    return kept.unionByName(one.select("x.*"))
