"""Coverage, tag usage and missing variables of long facts, and the run's report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import schemas


def _usage(long: DataFrame, keys: Sequence[str], observations: str, companies: str, years: str, *, company: str = "cik10", year: str = "company_year") -> DataFrame:
    """Counts and lists by ``keys``, with exact distinct counts of companies and company-years.

    Groups of a company's year are grouped to its own and those to the keys', each step adding up what
    the one before has counted, so no row is copied for a count.  Rows that are dealt out by company
    are shuffled for the last step only, which is a row for each key and task.
    """
    by_year = long.groupBy(company, year, *keys).agg(F.count("*").alias("n"), C.distinct_set("unit").alias("units"), C.distinct_set("form").alias("forms"))
    merged = [C.merged_sets(c).alias(c) for c in ("units", "forms")]
    by_company = by_year.groupBy(company, *keys).agg(F.sum("n").alias("n"), F.count("*").alias("years"), *merged)
    whole = by_company.groupBy(*keys).agg(F.sum("n").alias(observations), F.count(company).alias(companies), F.sum("years").alias(years), *merged)
    return whole.withColumns({c: F.array_join(c, ";") for c in ("units", "forms")})


def _ratio(part: Column, whole: int) -> Column:
    return F.bround(part / F.lit(whole), 6) if whole else F.lit(0.0)


def variable_coverage(long: DataFrame, variables: Sequence[str], rules: DataFrame, company_count: int, wide_rows: int) -> DataFrame:
    """A row for each variable, used or not, with counts and the parts of companies and company-years."""
    listed = long.sparkSession.createDataFrame([(i, v) for i, v in enumerate(variables)], "variable_order int, variable string")
    configured = rules.groupBy("variable").agg(F.count("*").alias("configured_tag_count"))
    used = _usage(long, ["variable"], "selected_observations", "companies_with_value", "company_years_with_value")
    joined = listed.join(configured, "variable", "left").join(used, "variable", "left").na.fill(0).na.fill("", ["units", "forms"])
    ratios = {
        "company_coverage_ratio": _ratio(F.col("companies_with_value"), company_count),
        "company_year_coverage_ratio": _ratio(F.col("company_years_with_value"), wide_rows),
    }
    return joined.withColumns(ratios).orderBy("variable_order").select(*schemas.COVERAGE)


def tag_usage(long: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each rule, used or not.  Derived rows belong to no rule."""
    keys = ["variable", "tier", "tag_priority", "namespace", "tag"]
    used = _usage(long, keys, "selected_observations", "companies_with_selected_value", "company_years_with_selected_value")
    joined = rules.select(*keys, "rule_order").join(used, keys, "left").na.fill(0).na.fill("", ["units", "forms"])
    return joined.orderBy("rule_order").select(*schemas.TAG_USAGE)


def missing_by_company(long: DataFrame, companies: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A row for each company, with the variables it has no value of, in their order."""
    listed = F.array(*[F.lit(v) for v in variables])
    found = long.groupBy("cik10").agg(
        F.count_distinct("company_year").alias("company_year_count"),
        F.count("*").alias("selected_observations"),
        F.collect_set("variable").alias("present"),
    )
    joined = companies.join(found, "cik10", "left")
    present = F.coalesce("present", F.array().cast("array<string>"))
    absent = F.array_except(listed, present)
    return joined.withColumns(
        {
            "company_year_count": F.coalesce("company_year_count", F.lit(0)),
            "selected_observations": F.coalesce("selected_observations", F.lit(0)),
            "variables_with_any_value": F.size(present).cast("long"),
            "variables_missing_any_value": F.size(absent).cast("long"),
            "missing_variables": F.array_join(absent, ";"),
        }
    ).select(*schemas.MISSING)


def quality_report(inputs: Mapping[str, object], counts: Mapping[str, int], outputs: Mapping[str, int]) -> str:
    """A Markdown account of a run, from the one row of its counts."""
    parts = ["# Fact panel run", ""]
    for title, rows in (("Inputs", inputs), ("Counts", counts), ("Rows written", outputs)):
        parts += [f"## {title}", "", "| what | value |", "| --- | --- |"]
        parts += [f"| {k.replace('_', ' ')} | {format(v, ',') if isinstance(v, int) and title != 'Inputs' else v} |" for k, v in rows.items()]
        parts.append("")
    return "\n".join(parts)


def write_report_table(spark: SparkSession, folder: str, text: str) -> None:
    """A report as the one file of a folder, in whatever store Spark reaches."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def write_report(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
