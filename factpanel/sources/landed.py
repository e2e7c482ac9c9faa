"""Landed documents as files: listed by name and size, and only those read that a run asks for.

Spark's own readers do it, so any store that Spark reaches will do and files are packed into
partitions by their bytes.  Listing reads no contents.  Reading prunes files by the key in their name and
by size before they are opened, from the file's metadata; a file too large for one value, or one that was
asked for and isn't there, is a row that says so and not a failed run.

Spark names its files itself, so what is landed from a table has a folder of its name for each file.
Many such folders are written and listed by tasks that take many of them each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

#: The key of a file: in its own name or in its folder's, as in CIK0000000001.json or CIK0000000001.json/part-00000.
KEY = r"CIK(\d{1,10})[^/]*(?:/[^/]*)?\z"
LARGEST = (1 << 31) - (1 << 20)  #: bytes of a file that one value can hold
KEYS_IN_FILTER = 10_000  #: up to so many keys are put into the scan's filter; more are joined
FILES_OF_TASK = 200  #: files that a task writes, about; opening and naming them takes a task's time, not their bytes
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def file_key(path: Column | str) -> Column:
    """The ten-digit key in a file's path, or null."""
    digits = F.regexp_extract(path, KEY, 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def write_files(texts: DataFrame, folder: str, each: int = FILES_OF_TASK) -> None:
    """Texts (file, value), each as a file in a folder of that name below ``folder``, which should be new.

    The number of tasks grows with the files: left to their few bytes, all would be written by one.
    Tasks put their files in place themselves, as the driver would rename them one after the other.
    """
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // each))
    writer = texts.repartition(tasks, "file").write.partitionBy("file").option("lineSep", " ")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


def _load(reader: DataFrameReader, spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """Files below a folder.  Spark lists them here, by a task for each folder up to a limit; four a core will do."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return reader.options(recursiveFileLookup=True, **options).load(path)
    finally:
        spark.conf.set(LISTING_TASKS, before)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_key, bytes, modified) of the files below a folder; their contents aren't read."""
    files = _load(spark.read.format("binaryFile"), spark, path)
    return files.select(F.col("path").alias("source_file"), file_key("path").alias("file_key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, path: str, *, keys: DataFrame | None = None, largest: int = LARGEST) -> DataFrame:
    """(source_file, file_key, text, problem): a row for each file below a folder whose key is in ``keys`` (column cik10).

    ``problem`` is ``too_large`` for files beyond ``largest`` bytes and ``missing`` for keys without a
    file, whose text is null; else it is null.
    """
    files = _load(spark.read.format("text"), spark, path, wholetext=True)
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    kept = files.where(size <= largest)
    listed = list_files(spark, path)
    wanted = None
    if keys is not None:
        wanted = keys.select(C.company_key("cik10").alias("file_key")).where("file_key is not null").distinct()
        few = [r[0] for r in wanted.limit(KEYS_IN_FILTER + 1).collect()]
        if len(few) <= KEYS_IN_FILTER:
            kept = kept.where(file_key(name).isin(few))
    read = kept.select(name.alias("source_file"), file_key(name).alias("file_key"), F.col("value").alias("text"), F.lit(None).cast("string").alias("problem"))
    large = listed.where(F.col("bytes") > largest).select("source_file", "file_key", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("problem"))
    found = read.unionByName(large)
    if wanted is None:
        return found
    missing = wanted.join(listed.select("file_key").distinct(), "file_key", "left_anti").select(F.lit(None).cast("string").alias("source_file"), "file_key", F.lit(None).cast("string").alias("text"), F.lit("missing").alias("problem"))
    return found.join(wanted, "file_key", "left_semi").select("source_file", "file_key", "text", "problem").unionByName(missing)
