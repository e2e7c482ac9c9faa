"""Corpus preparation: five stages, each an operator over all that the stage before kept.

1. ``quality``: documents that the base rule or the risk-controlled cutoffs reject go.
2. ``near_duplicates``: one document of each SimHash component stays, the one with the least id.
3. ``substrings``: a passage that repeats across documents stays in the first one only.
4. ``secrets``: found secrets are replaced by a mark.
5. ``packing``: the texts become pieces of sequences.

Every stage but the last returns the columns of ``documents`` (n_chars follows the text).  A stage's
result is written as Parquet and read again as the next one's input.  Rows with nulls, empty texts,
repeated rows and empty tables go through as the operators' docstrings say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factpanel.llm import packing, quality, secrets, simhash, substring
from factpanel.llm.arrow import ready, spread
from factpanel.operators.numbering import use_shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.keep(spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return substring.without_passages(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Thresholds, components and chains have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what lies between them goes to the shared folder.

    A stage's copy of the documents is removed when the next one has written its own, so the last one
    stays, which the result is read from.
    """
    folder = f"{use_shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
