"""The panel: long facts to one row per company-year and back, and what the two differ in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import schemas

KEYS = ("cik10", "company_year")


def wide(long: DataFrame, variables: Sequence[str], *, keys: Sequence[str] = KEYS, variable: str = "variable", value: str = "value") -> DataFrame:
    """A row per key with a column for each variable, in one aggregation over a given list.

    Two rows for one key and variable are an error, as the panel must hold each fact once.
    """

    def cell(v: str) -> Column:
        here = F.col(variable) == v
        refuse = F.raise_error(F.lit(f"more than one value for a key and {v}"))
        return F.when(F.count_if(here) > 1, refuse).otherwise(F.any_value(F.when(here, F.col(value)), ignoreNulls=True)).alias(v)

    return long.groupBy(*keys).agg(*[cell(v) for v in variables])


def with_companies(panel: DataFrame, companies: DataFrame, variables: Sequence[str]) -> DataFrame:
    return companies.join(panel, "cik10").select(*schemas.COMPANY, "company_year", *variables).orderBy("cik10", "company_year")


def long(panel: DataFrame, variables: Sequence[str], *, keys: Sequence[str] = KEYS, variable: str = "variable", value: str = "value") -> DataFrame:
    """A row per key and variable that has a value."""
    return panel.select(*keys, *variables).unpivot(list(keys), list(variables), variable, value).where(F.col(value).isNotNull())


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def mismatches(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_value: str, right_value: str, tolerance: float) -> DataFrame:
    """Rows of ``left`` whose partner is missing, has no value, or differs by more than ``tolerance``."""
    joined = left.join(right.select(*keys, right_value), list(keys), "left")
    return joined.where(F.col(right_value).isNull() | (F.abs(F.col(left_value) - F.col(right_value)) > tolerance))


def compare(wide: DataFrame, facts: DataFrame, variables: Sequence[str], *, keys: Sequence[str] = KEYS, variable: str = "variable", value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """(keys, finding, variable, wide_value, long_value): all that the two panels differ in, by one merge of their rows by key.

    ``missing_from_long`` and ``missing_from_wide`` stand once for a key, ``differs`` for each value of the
    wide panel whose fact is missing, has no value or is further off than the tolerance.  Null keys have
    no partner.  Tables that ``write_bucketed`` has written by the keys are merged where they lie, without
    a shuffle; what a key has of either is held together in a row.
    """
    cells = F.struct(*[F.col(v).cast("double").alias(v) for v in variables])
    left = wide.groupBy(*keys).agg(F.collect_list(cells).alias("rows"))
    right = facts.groupBy(*keys).agg(F.collect_list(F.struct(F.col(variable).alias("variable"), F.col(value).cast("double").alias("value"))).alias("facts"))
    merged = left.join(right, list(keys), "full").select(*keys, "facts", F.posexplode_outer("rows").alias("place", "row"))
    partners = lambda v: F.filter("facts", lambda x: x["variable"] == v)
    none = F.array(F.struct(F.lit("").alias("variable"), F.lit(None).cast("double").alias("value")))

    def differs(v: str) -> Column:
        mine = F.col(f"row.{v}")
        here = F.coalesce(partners(F.lit(v)), F.array().cast("array<struct<variable:string,value:double>>"))
        off = F.filter(F.when(F.size(here) > 0, here).otherwise(none), lambda x: x["value"].isNull() | (F.abs(mine - x["value"]) > tolerance))
        return F.when(mine.isNotNull(), F.transform(off, lambda x: _finding("differs", F.lit(v), mine, x["value"])))

    empty = F.array().cast("array<struct<finding:string,variable:string,wide_value:double,long_value:double>>")
    once = F.coalesce(F.col("place") == 0, F.lit(True))
    missing = [F.when(once & F.col("facts").isNull(), F.array(_finding("missing_from_long"))), F.when(F.col("row").isNull(), F.array(_finding("missing_from_wide")))]
    found = F.concat(*[F.coalesce(x, empty) for x in (*missing, *map(differs, variables))])
    return merged.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def _finding(name: str, variable: Column | None = None, wide_value: Column | None = None, long_value: Column | None = None) -> Column:
    texts = [F.lit(name), F.lit(None).cast("string") if variable is None else variable]
    numbers = [F.lit(None).cast("double") if x is None else x for x in (wide_value, long_value)]
    return F.struct(*[c.alias(n) for c, n in zip([*texts, *numbers], ("finding", "variable", "wide_value", "long_value"), strict=True)])


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key comes up more than once, with ``group_size``."""
    return df.withColumn("group_size", F.count("*").over(Window.partitionBy(*keys))).where("group_size > 1")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, group_size) of the keys that come up more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("group_size")).where("group_size > 1")
