"""Near-duplicate embeddings by an exact metric range join on the unit sphere.

Two vectors link if their cosine is at least ``threshold``, which is an angle of at most r.  Pivots,
drawn evenly from the vectors, partition them: a vector lives with its nearest pivot, in a ring of
angles from it, and rings of many vectors are cut into blocks.  A vector also visits the blocks that
come before its own and that may hold a partner.  What the triangle inequality rules out it doesn't
visit: a ring all of whose angles differ from its own by more than r, and a pivot so much farther than
its own that even the border between the two is out of reach.  Blocks then work independently, each
holding its own vectors while the visitors stream by, and every pair meets in one block.

The inequality also says which pairs link without a look: the innermost ring reaches r / 2 from the
pivot, so all of it links, whatever its size, and its members neither visit nor compare each other.

A block gives each vector's number of links and the links of a spanning forest, not all pairs.  Equal
vectors are one, with a weight.  Cosines within 1e-9 of the threshold are computed again by one
formula, so the answer doesn't depend on who visited whom.

What the inequality can't rule out is compared: vectors in general position, all about as far from each
other, visit most blocks, and then work and visits grow with the square of their number.

Cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing;
vectors of different lengths neither; a null id takes part, a component without any id is null, and a
null id is kept if its component is null; rows with equal id and vector are rows of their own that
link; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpoint
from .arrow import record_batch
from .components import connected_components, small

THRESHOLD = 0.9
CLOSE = 1e-9  #: cosines so near to the threshold are computed again
BLOCK = 4096  #: vectors of a block
COPIES = 1000  #: rows of one vector from which on its answer is sent to them
INNER = 64  #: vectors of an inner ring that are worth a block of their own
PIVOTS = 1024  #: pivots at most; beyond that the blocks grow in number, not the pivots
STREAM = 512  #: visitors that a block compares at once
SLACK = 1e-7  #: radians that rounding may take from an angle


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _schema(names: str, vector: T.ArrayType) -> T.StructType:
    """The named columns and the vector, which keeps its own type: single precision is half as much to send."""
    return T.StructType([*T.StructType.fromDDL(names), T.StructField("vector", vector)])


def _read(schema: T.StructType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a digest of the vector; key and vector are null for those that link with nothing."""
    for batch in batches:
        keys, sizes, vectors = [], [], []
        for v in batch.column(1):
            values = None if not v.is_valid else v.values
            good = values is not None and len(values) and not values.null_count
            x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if good else np.zeros(0)
            good = bool(good) and bool(np.isfinite(x).all()) and bool(x.any())
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
            sizes.append(len(x) if good else None)
            vectors.append(x if good else None)
        yield record_batch(schema, {"vec_id": batch.column(0), "key": keys, "size": sizes, "vector": vectors})


def choose_pivots(vectors: DataFrame, size: int, count: int, radius: float, most: int = PIVOTS, block: int = BLOCK) -> np.ndarray:
    """At most one pivot for each block of vectors and at most ``most``, from twice as many vectors drawn evenly by their digest.

    The draw is bounded, so it may go through the driver.  A drawn vector within ``radius`` of a pivot
    is no pivot: a dense group gets one, in whose inner ring it lies.
    """
    wanted = min(most, max(1, -(-count // block)))
    drawn = vectors.orderBy("key").limit(2 * wanted).select("vector").collect()
    points = _unit(np.array([r[0] for r in drawn], np.float64).reshape(-1, size))
    chosen = []
    for p in points:
        if len(chosen) < wanted and (not chosen or (np.array(chosen) @ p).max() < np.cos(radius)):
            chosen.append(p)
    return np.array(chosen)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _homes(schema: T.StructType, pivots, size: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STREAM):
                part = batch.slice(at, STREAM)
                x = _unit(_matrix(part.column(2), size))
                angle = _angles(x, pivots.value)
                cell = angle.argmin(axis=1)
                # the inner ring is a little narrower than half the radius, so no rounding makes a link of it that isn't one
                ring = np.maximum(0, np.floor((angle[np.arange(len(x)), cell] + SLACK) / width)).astype(np.int32)
                yield record_batch(schema, {"node": part.column(0), "weight": part.column(1), "cell": cell.astype(np.int32), "ring": ring, "vector": part.column(2)})

    return run


def grouped(filled: list[tuple[int, int, int]], block: int) -> tuple[np.ndarray, ...]:
    """Groups of neighbouring rings of a pivot, from (cell, ring, vectors) in order: arrays (cell, first ring, last ring, vectors).

    An inner ring of some size stands alone, as its pairs are known; other rings come together until they fill half a block.
    """
    out: list[list[int]] = []
    for cell, ring, n in filled:
        alone = ring == 0 and n >= INNER
        if out and out[-1][0] == cell and 2 * out[-1][3] < block and not out[-1][4]:
            out[-1][2:4] = [ring, out[-1][3] + n]
        else:
            out.append([cell, ring, ring, n, alone])
    return tuple(np.array(out, np.int64).reshape(-1, 5).T)


def _visits(schema: T.StructType, pivots, groups, size: int, width: float, radius: float):
    """For rows (node, weight, cell, ring, vector) the blocks where they live and those before it that they visit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        cells, first, last, starts, counts, inner = groups.value
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))
        chord = 2 * np.sin(radius / 2)
        low, high = first * width - SLACK, (last + 1) * width + SLACK
        rings = int(last.max()) + 1
        for batch in batches:
            for at in range(0, batch.num_rows, STREAM):
                part = batch.slice(at, STREAM)
                node, weight, cell, ring = (part.column(i).to_numpy() for i in range(4))
                near = _unit(_matrix(part.column(4), size)) @ p.T
                angle = np.arccos(np.clip(near, -1.0, 1.0))
                rows = np.arange(len(near))
                within = near[rows, cell][:, None] - near <= chord * gap[cell] + SLACK  # the border between the pivots is within reach
                mine = np.searchsorted(cells * rings + first, cell.astype(np.int64) * rings + ring, side="right") - 1
                own = starts[mine] + node % counts[mine]
                may = within[:, cells] & (angle[:, cells] - radius <= high) & (angle[:, cells] + radius >= low)
                may &= np.arange(len(cells))[None, :] <= mine[:, None]
                alone = inner[mine] > 0
                may[rows[alone], mine[alone]] = False  # the inner ring's pairs are known
                r, g = np.nonzero(may)
                # all blocks of the groups, and of the own group those before the own
                upto = np.where(g == mine[r], own[r] - starts[g], counts[g])
                step = np.arange(int(upto.sum())) - np.repeat(np.cumsum(upto) - upto, upto)
                unit = np.concatenate([own, np.repeat(starts[g], upto) + step]).astype(np.int32)
                row = np.concatenate([rows, np.repeat(r, upto)])
                visits = np.arange(len(unit)) >= len(own)
                for a in range(0, len(unit), STREAM):
                    s = slice(a, a + STREAM)
                    arrays = [pa.array(unit[s]), pa.array(visits[s]), pa.array(node[row[s]]), pa.array(weight[row[s]]), part.column(4).take(pa.array(row[s]))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return run


FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("links", T.LongType())])


class Block:
    """The vectors that live in a block; counts its links and joins what is linked."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, raw: np.ndarray, threshold: float, inner: bool) -> None:
        self.node, self.weight, self.raw, self.threshold = node, weight.astype(np.float64), raw, threshold
        self.x = _unit(raw)
        self.label = np.zeros(len(node), np.int64) if inner else np.arange(len(node))
        self.links = np.zeros(len(node))
        self.joined: list[tuple[int, int]] = []
        for a in range(0, 0 if inner else len(node), STREAM):
            rows, hit = self.hits(self.x[a : a + STREAM], raw[a : a + STREAM])
            hit[np.arange(len(rows)), a + rows] = False
            self.links[a + rows] += hit @ self.weight
            for k, row in zip(rows, hit, strict=True):
                self.join(np.append(np.flatnonzero(row), a + k))

    def hits(self, x: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``x`` that link with one of the block's vectors, and for each whether it does with which."""
        cosine = x @ self.x.T
        rows = np.flatnonzero(cosine.max(axis=1) >= self.threshold - CLOSE)
        cosine = cosine[rows]
        hit = cosine >= self.threshold
        for i, j in zip(*np.nonzero(np.abs(cosine - self.threshold) <= CLOSE), strict=True):
            hit[i, j] = exact_cosine(raw[rows[i]], self.raw[j]) >= self.threshold
        return rows, hit

    def join(self, at: np.ndarray) -> int:
        """Makes the vectors at these places one component; gives one of them."""
        labels = np.unique(self.label[at])
        for other in labels[1:]:
            self.joined.append((int(labels[0]), int(other)))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]
        return int(labels[0])

    def visit(self, node: np.ndarray, weight: np.ndarray, raw: np.ndarray) -> dict:
        rows, hit = self.hits(_unit(raw), raw)
        some = hit.any(axis=1)
        rows, hit = rows[some], hit[some]
        self.links += weight[rows].astype(np.float64) @ hit
        others = [self.join(np.flatnonzero(row)) for row in hit]
        return {"node": node[rows], "other": self.node[np.array(others, np.int64)], "links": (hit @ self.weight).astype(np.int64)}

    def result(self) -> dict:
        """Each vector's links, and the joins, which a label's own place stands for."""
        some = np.flatnonzero(self.links)
        a, b = np.array(self.joined, np.int64).reshape(-1, 2).T
        return {"node": np.concatenate([self.node[some], self.node[a]]), "other": np.concatenate([self.node[some], self.node[b]]), "links": np.concatenate([self.links[some].astype(np.int64), np.zeros(len(a), np.int64)])}


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (a, b))  # powers of two, which change no digit
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def _compare(size: int, threshold: float, inner_units):
    """For rows of VISITS sorted by unit, those who live there first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, block = None, [], None

        def begin() -> Block:
            node, weight, raw = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return Block(node, weight, raw, threshold, bool(inner_units.value[unit]))

        for batch in batches:
            names, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (visits[1:] != visits[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if names[a] != unit:
                    if held:
                        block = begin()
                    if block is not None:
                        yield record_batch(FOUND, block.result())
                    unit, block = names[a], None
                part = batch.slice(a, b - a)
                node, weight, raw = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), size)
                if not visits[a]:
                    held.append((node, weight, raw))
                    continue
                if held:
                    block = begin()
                for at in range(0, len(node), STREAM):
                    s = slice(at, at + STREAM)
                    yield record_batch(FOUND, block.visit(node[s], weight[s], raw[s]))
        if held:
            block = begin()
        if block is not None:
            yield record_batch(FOUND, block.result())

    return run


def _of_size(vectors: DataFrame, size: int, threshold: float, block: int, most: int) -> DataFrame:
    """(node, other, links) of the distinct vectors (node, key, weight, vector) of one length."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    radius = float(np.arccos(threshold))
    width = radius / 2 - SLACK
    kind = vectors.schema["vector"].dataType
    pivots = sc.broadcast(choose_pivots(vectors, size, vectors.count(), radius, most, block))
    homes = vectors.select("node", "weight", "vector").mapInArrow(_homes(_schema("node long, weight long, cell int, ring int", kind), pivots, size, width), _schema("node long, weight long, cell int, ring int", kind))
    homes = checkpoint(homes)
    # a row for each ring of a pivot that holds vectors: at most pivots times rings
    filled = homes.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("node").alias("first")).orderBy("cell", "ring").collect()
    cells, first, last, n, inner = grouped([tuple(r)[:3] for r in filled], block)
    counts = -(-n // block)
    groups = sc.broadcast((cells, first, last, np.cumsum(counts) - counts, counts, inner))
    alone = sc.broadcast(np.repeat(inner > 0, counts))
    schema = _schema("unit int, visits boolean, node long, weight long", kind)
    visits = homes.mapInArrow(_visits(schema, pivots, groups, size, width, radius), schema)
    found = visits.repartition("unit").sortWithinPartitions("unit", "visits").mapInArrow(_compare(size, threshold, alone), FOUND)
    # the inner rings' own links: each vector to all others, and to the first for the component
    cores = [(int(r["cell"]), int(r["weight"]), int(r["first"])) for r in filled if r["ring"] == 0 and r["n"] >= INNER]
    if not cores:
        return found
    table = spark.createDataFrame(cores, "cell int, total long, first long")
    known = homes.where("ring = 0").join(F.broadcast(table), "cell").select("node", F.col("first").alias("other"), (F.col("total") - F.col("weight")).alias("links"))
    return found.unionByName(known)


def near_duplicates(
    table: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``table``; ``threshold`` is above zero and below one.

    Vectors of each length are joined apart, one job after the other, so a table should have few lengths.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be above zero and below one")
    kind = table.schema[vector_col].dataType
    if kind != T.ArrayType(T.FloatType(), kind.containsNull):
        kind = T.ArrayType(T.DoubleType())
    schema = _schema("vec_id long, key binary, size int", kind)
    source = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    rows = checkpoint(source.mapInArrow(partial(_read, schema), schema))
    distinct = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"), F.any_value("size").alias("size"), F.any_value("vector").alias("vector"))
    vectors = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in vectors.select("size").distinct().collect())
    parts = [_of_size(vectors.where(F.col("size") == s), s, threshold, block, pivots) for s in sizes]
    out = rows.select("vec_id", "key")
    if not parts:
        return _named(out.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")}))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = checkpoint(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    ids = checkpoint(vectors.select("node", "key", "weight", "vec_id").join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = ids.groupBy("component").agg(F.min("vec_id").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    values = [(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("least").isNull() & (F.col("component") == F.col("node")), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")]
    named = checkpoint(ids.join(least, "component", "left").select("key", "weight", *values))
    # the keys of many copies are sent to their rows, where they are few enough
    many = small(named.where(F.col("weight") > COPIES).drop("weight"))
    alone = out.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    few = out.join(many, "key", "left_anti").where("key is not null").join(named.drop("weight"), "key")
    return _named(few.unionByName(out.join(many, "key")).drop("key").unionByName(alone))


def _named(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
