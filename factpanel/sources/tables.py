"""Readers and writers of the tables between the steps, and of the landed lists.

CSV is read with a schema of text columns: nothing is inferred, so keys keep their zeros.  Between
steps Parquet is the better form; CSV is for the published edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from . import schemas

# Texts that the published step's reader takes for missing.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def require_path(path: str | Path, hint: str = "") -> str:
    """The path, or an error that names the step which makes it.  Paths with a scheme are left to Spark."""
    text = str(path)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", text) and not Path(text).exists():
        raise FileNotFoundError(f"missing input: {text}. {hint}".strip())
    return text


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], *, compat_missing: bool = False, hint: str = "", types: Mapping[str, str] | None = None) -> DataFrame:
    """Named text columns of a CSV file with a header; blank is null.

    A missing column is an error.  ``compat_missing`` takes texts such as NA for missing too.  ``types``
    gives some columns a type; what doesn't parse is null there.
    """
    require_path(path, hint)
    header = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{path} lacks columns: {missing}")
    table = spark.read.csv(path, header=True, schema=schemas.strings(header), multiLine=True, escape='"', nullValue="", enforceSchema=False).select(*columns)
    if compat_missing:
        table = table.select(*[F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)).alias(c) for c in columns])
    return table.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def read_optional(spark: SparkSession, path: str, columns: Sequence[str], *, types: Mapping[str, str] | None = None) -> DataFrame:
    """Like read_csv; a missing file is an empty table with the columns."""
    if exists(spark, path):
        return read_csv(spark, path, columns, types=types)
    empty = spark.createDataFrame([], schemas.strings(columns))
    return empty.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reaches."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def wanted_keys(table: DataFrame, column: str = "cik10") -> DataFrame:
    """The distinct keys in order; blank ones go, odd ones are an error."""
    kept = schemas.require_columns(table, [column]).where(C.blank_to_null(column).isNotNull())
    return kept.select(C.company_key(column, strict=True).alias(column)).distinct().orderBy(column)


def still_wanted(wanted: DataFrame, landed: DataFrame, column: str = "cik10") -> DataFrame:
    """Keys without a landed file: what an incremental fetch has left to do."""
    return wanted.join(landed.select(column).distinct(), column, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order: Iterable) -> DataFrame:
    """The first row of each key in a stated order; ``order`` should leave no ties."""
    from pyspark.sql import Window

    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


TICKER = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
SUBMISSION = "struct<name:string,entityType:string,sic:string,sicDescription:string,fiscalYearEnd:string,tickers:array<string>,exchanges:array<string>>"


def ticker_map(landed: DataFrame, downloaded_at: str) -> DataFrame:
    """(ticker, cik, cik10, name, downloaded_at) of the landed list (column text), first row of a pair."""
    rows = landed.select(F.posexplode(F.map_values(F.from_json("text", TICKER))).alias("__order", "r"))
    rows = rows.select("__order", F.upper(C.strip("r.ticker")).alias("ticker"), F.col("r.cik_str").alias("cik"), F.col("r.title").alias("name"))
    rows = rows.withColumn("cik10", C.zero_pad("cik", 10)).withColumn("downloaded_at", F.lit(downloaded_at))
    return keep_first(rows, ["ticker", "cik"], ["__order"]).select("ticker", "cik", "cik10", "name", "downloaded_at").orderBy("ticker")


def unique_companies(tickers: DataFrame) -> DataFrame:
    """(cik, cik10, name): the first ticker's row of each company."""
    return keep_first(tickers, ["cik10"], ["ticker", "name"]).select("cik", "cik10", "name").orderBy("cik10")


def metadata(companies: DataFrame, landed: DataFrame, downloaded_at: str) -> DataFrame:
    """Company metadata from landed submissions (cik10, text, source_url, cache_path, error_message).

    A company whose document is missing or broken gets an error row with the same columns.
    """
    parsed = landed.withColumn("p", F.from_json("text", SUBMISSION, {"columnNameOfCorruptRecord": "_corrupt"}))
    joined = companies.join(parsed, "cik10", "left")
    ok = F.col("text").isNotNull() & F.col("p").isNotNull() & F.coalesce(C.strip("text").startswith("{"), F.lit(False)) & F.try_parse_json("text").isNotNull()

    def when_ok(c) -> object:
        return F.when(ok, c).otherwise(F.lit(""))

    error = F.substring(F.coalesce("error_message", F.when(F.col("text").isNull(), "no document landed").otherwise("document can't be parsed")), 1, 500)
    return joined.select(
        "cik",
        "cik10",
        F.col("name").alias("name_from_ticker_map"),
        when_ok(F.col("p.name")).alias("name_from_sec"),
        when_ok(F.col("p.entityType")).alias("entity_type"),
        when_ok(F.col("p.sic")).alias("sic"),
        when_ok(F.col("p.sicDescription")).alias("sic_description"),
        when_ok(F.col("p.fiscalYearEnd")).alias("fiscal_year_end"),
        when_ok(C.join_items("p.tickers")).alias("tickers"),
        when_ok(C.join_items("p.exchanges")).alias("exchanges"),
        "source_url",
        "cache_path",
        F.when(ok, "success").otherwise("error").alias("download_status"),
        F.lit(downloaded_at).alias("downloaded_at"),
        F.when(ok, "").otherwise(error).alias("error_message"),
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """Written as table ``name`` in ``path``, one sorted file for each bucket of the keys, and read again.

    Tables with the same keys and buckets are joined and grouped by the keys without a shuffle.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with a header, nulls as blanks.  A single file is for small results only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
