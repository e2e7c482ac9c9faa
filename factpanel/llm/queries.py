"""The queries of the corpus operators: each over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, extraction, fim, gif, licenses, packing, pieces, quality, runs, secrets, simhash, substring, warc
from .arrow import ready, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(_table(spark, sf_dir, name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_texts(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_texts(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_texts(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(_texts(spark, sf_dir, "pages"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_texts(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_texts(spark, sf_dir), keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(_texts(spark, sf_dir), keep=["doc_id"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_texts(spark, sf_dir, "pages")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_texts(spark, sf_dir))


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_secrets, op3_licenses, op4_quality, op5_html, op6_substring, op7_sentencepiece, op8_simhash, op9_gif, op10_warc, op11_periodic_runs, op12_embeddings, op13_fim)
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.oracle_sql(), "op13_fim": fim.oracle_sql()}
