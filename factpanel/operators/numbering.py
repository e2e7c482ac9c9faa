"""Dense numbers 1..n in a total order without gathering the rows in one task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder at once, so a lost executor costs no earlier step."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name`` counting from 1 in the given order, which should leave no ties.

    The sorted rows are written once; each partition's rows are numbered by their place in it and
    the number of rows before it, of which there is one per partition.
    """
    return placed(df.orderBy(*order), name)


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in the order that it comes in, from 1; rows that are sorted aren't sorted again."""
    ordered = checkpoint(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row per partition
    place = F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return ordered.withColumn("__part", part).join(offsets, "__part").withColumn(name, place + F.col("__before")).drop("__at", "__part", "__before")
