"""Change detection for landed documents: what a run has read, by key, digest and version.

A manifest has a row for each key: the digest of its documents and the version in which they last
changed.  Versions are folders, each written once; the last one that was finished counts, so a run that
breaks off leaves what was before.  A run recomputes the companies that are new or have changed and adds
their rows under its version; a company's rows count if its version in the manifest is theirs.  Nothing
that hasn't changed is computed or written again, and vanished companies drop out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import checkpoint

MANIFEST = "key string, digest string, version int"
STATES = ("new", "changed", "unchanged", "vanished")


def digests(documents: DataFrame, key: str = "file_key") -> DataFrame:
    """(key, digest) of documents (key, text); the files of a key count together, in any order."""
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    return documents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(own)), ","), 256).alias("digest"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key, digest, state, before_version) from a manifest and the digests of what is there now."""
    old = before.select("key", F.col("digest").alias("old_digest"), F.col("version").alias("before_version"))
    both = now.join(old, "key", "full")
    state = F.when(F.col("old_digest").isNull(), "new").when(F.col("digest").isNull(), "vanished").when(F.col("digest") == F.col("old_digest"), "unchanged").otherwise("changed")
    return both.select("key", "digest", state.alias("state"), "before_version")


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a folder whose writing has come to an end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath() for s in store.listStatus(path)]
    marks = [(p.getName(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in names]
    return sorted(int(n.split("=")[1]) for n, mark in marks if n.startswith("version=") and store.exists(mark))


def last_version(spark: SparkSession, folder: str) -> int:
    return max(_finished(spark, f"{folder}/manifest"), default=0)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    version = last_version(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={version}") if version else spark.createDataFrame([], MANIFEST)


def refresh(spark: SparkSession, folder: str, documents: DataFrame, build: Callable[[DataFrame], DataFrame], *, key: str = "file_key") -> DataFrame:
    """Brings the rows in ``folder`` up to date with ``documents`` (key, text); gives the changes.

    ``build`` makes rows with the column ``key`` of the documents that are new or have changed.  Their rows
    are written before the manifest, which makes them count.
    """
    version = last_version(spark, folder) + 1
    found = checkpoint(changes(read_manifest(spark, folder), digests(documents, key)))
    again = found.where(F.col("state").isin("new", "changed")).select(F.col("key").alias("__key"))
    rows = build(documents.join(again, F.col(key) == F.col("__key"), "left_semi"))
    rows.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")  # of a run that broke off
    kept = found.where("state <> 'vanished'").select("key", "digest", F.when(F.col("state") == "unchanged", F.col("before_version")).otherwise(version).cast("int").alias("version"))
    kept.write.parquet(f"{folder}/manifest/version={version}")
    return found


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that count, with their version."""
    manifest = read_manifest(spark, folder).select("key", "version")
    return spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/version={v}" for v in range(1, last_version(spark, folder) + 1)]).join(manifest, ["key", "version"])
