"""Fact documents as they land (an extension): parsed once, facts appended, one batch at a time.

The file source remembers which files it has read, so a restart goes on where the last run ended;
a document that is fetched again under a new name gives new facts, of which selection picks the best.

``keep_best`` keeps the best fact of each company, variable and year up as documents land.  The state
of a key is one row, held by Spark's state store and restored after a restart; set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider where there are many keys.  A
batch writes the keys whose best fact it has changed, under its own number, so a batch that is run again
replaces its rows; ``current_best`` takes the last row of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import select
from ..sources import facts
from ..sources.config import Rule, Scope, rules_frame


def landed_documents(spark: SparkSession, folder: str, *, files_a_batch: int = 1000) -> DataFrame:
    """(source_file, text): a stream of JSON files in a folder."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def mapped_facts(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Facts of configured tags, with rule, key of the file and places in the document."""
    table = rules_frame(documents.sparkSession, list(rules))
    opened = facts.open_documents(documents).withColumnRenamed("file_key", "cik10").drop("cik", "text")
    units = facts.explode_units(select.map_to_rules(facts.explode_tags(opened), table, len(rules)))
    return facts.explode_facts(units)


def ingest(spark: SparkSession, folder: str, rules: Sequence[Rule], out: str, state: str) -> StreamingQuery:
    """Starts a query that appends the facts of what has landed to a Parquet table, then ends."""
    rows = mapped_facts(landed_documents(spark, folder), rules)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start()


MET = ["rule_order", "unit_order", "fact_order"]


def keep_best(spark: SparkSession, folder: str, rules: Sequence[Rule], scope: Scope, out: str, state: str, *, files_a_batch: int = 1000) -> StreamingQuery:
    """Starts a query that brings the best facts in ``out`` up to date with what has landed, then ends."""
    judged = select.judge(mapped_facts(landed_documents(spark, folder, files_a_batch=files_a_batch), rules), scope)
    best = select.running_best(judged, met=MET)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start()


def current_best(spark: SparkSession, out: str) -> DataFrame:
    """The best fact of each company, variable and year, from the batches so far."""
    keys = ["cik10", "variable", "company_year"]
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("row"))
    return last.select(*keys, "row.*").drop("batch")
