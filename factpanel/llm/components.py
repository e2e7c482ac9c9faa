"""Connected components over links, and tables that are small enough to be sent to the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import checkpoint

#: Tables of ids up to so many rows (some 100 MB) are sent to the executors; larger ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000

HEAVY = 100_000  #: keys with a larger share than one in so many are joined by broadcast


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with the hint to broadcast it if it has at most ``limit`` rows, else as it is.

    ``ids`` should be cheap to read again, such as a checkpoint.
    """
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``weight``, by a left join on ``key``, which ``table`` has once.

    A small table is sent to the executors.  Else the keys that hold over a HEAVY-th of all weight,
    fewer than HEAVY, are: their rows, which could be a third of all, stay where they are, and
    only the others are dealt out by key.  ``table`` should be a checkpoint, ``rows`` cheap to read twice.
    """
    plain = table.drop(weight)
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(plain), key, "left")
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    hot = F.broadcast(table.where(heavy).drop(weight))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(~heavy).drop(weight), key, "left")
    return rows.join(hot, key).unionByName(rest)


def _near_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and everything in u's rows."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that links reach, for every node that a link names.

    ``links`` has integer columns ``a`` and ``b``.  Large-star and small-star rounds alternate until
    the edges stay the same; each is an aggregation and a join on node, so no task gathers a
    component, and a hub's rows can be split.  Rows with a null end are no links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpoint(edges)
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _near_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _near_min(large)
        edges = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = checkpoint(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
