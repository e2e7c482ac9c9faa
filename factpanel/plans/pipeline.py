"""The steps wired together: companies to a universe, documents to a panel, the panel to warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classify, derive, panel, quality, reports, select
from ..sources import facts, schemas, tables
from ..sources.config import Rule, Scope, rules_frame, variables_of


@dataclass
class Panel:
    """What a run over fact documents gives.  ``stats`` is a table of one row."""

    long: DataFrame
    wide: DataFrame
    coverage: DataFrame
    usage: DataFrame
    missing: DataFrame
    stats: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees what the run keeps on the executors' disks; the tables would be computed anew."""
        for df in self.held:
            df.unpersist()


def universe_of(metadata: DataFrame, *, compat_nan: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(universe, excluded, summary) of company metadata."""
    companies = classify.normalized(classify.classify(metadata, compat_nan=compat_nan))
    return classify.universe(companies), classify.excluded(companies), classify.universe_summary(companies)


def companies_of(universe: DataFrame) -> DataFrame:
    """The company columns with checked keys, the first row of each key by id."""
    schemas.require_columns(universe, schemas.COMPANY, "research universe")
    keyed = universe.withColumn("cik10", C.company_key("cik10", strict=True))
    order = [F.col("research_universe_id").cast("long"), *[F.col(c) for c in schemas.COMPANY[1:]]]
    return tables.keep_first(keyed, ["cik10"], order).select(*schemas.COMPANY)


def listed_rows(companies: DataFrame, documents: DataFrame, rules: DataFrame, n_rules: int, units: Sequence[str]) -> DataFrame:
    """What the documents hold, dealt out by company, each document read once: facts under configured tags of accepted units, with their rule.

    Besides them stand a row for each document, with its ``status``, and one for each foreign unit, with
    the number of its facts (``foreign``); both have no ``fact_order``.  Of companies not asked for only the documents are listed.
    """
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("namespace", "string"), ("tag", "string"), ("units", facts.UNITS))])
    tags = lambda space: F.transform(F.filter(F.map_entries(space["value"]), lambda t: t["value"].isNotNull()), lambda t: F.struct(space["key"].alias("namespace"), t["key"].alias("tag"), t["value"]["units"].alias("units")))
    spaces = F.filter(F.map_entries("facts"), lambda x: x["value"].isNotNull())
    entries = F.concat(F.array(none), F.coalesce(F.flatten(F.transform(spaces, tags)), F.array().cast(f"array<struct<namespace:string,tag:string,units:{facts.UNITS}>>")))
    opened = facts.whole_documents(documents).select("source_file", F.col("file_key").alias("cik10"), "status", F.posexplode(entries).alias("place", "t"))
    rows = opened.select("source_file", "cik10", F.when(F.col("place") == 0, F.col("status")).alias("status"), "t.*")
    known = rows.join(F.broadcast(rules) if n_rules <= select.BROADCAST_RULES else rules, ["namespace", "tag"], "left").where("variable is not null or status is not null")
    keep = [c for c in known.columns if c != "units"]
    listed = known.select(*keep, F.posexplode_outer("units").alias("unit_order", "unit", "items")).where("unit is not null or status is not null")
    accepted = F.col("unit").isin(*units)
    counted = listed.select(*keep, "unit_order", "unit", F.when(~accepted, F.size("items")).alias("foreign"), F.when(accepted, F.col("items")).alias("items"))
    held = [c for c in counted.columns if c != "items"]
    single = counted.select(*held, F.posexplode_outer("items").alias("fact_order", "f")).where("f is not null or status is not null or foreign is not null")
    asked = companies.select("cik10").distinct().withColumn("asked", F.lit(True))
    dealt = single.select(*held, "fact_order", "f.*").repartition("cik10")
    return dealt.join(asked, "cik10", "left").where("asked or status is not null").drop("asked")


def build_panel(companies: DataFrame, documents: DataFrame, rules: Sequence[Rule], scope: Scope, *, units: Sequence[str] = select.UNITS) -> Panel:
    """Long and wide panel, reports and counters of fact documents (source_file, text).

    A company's facts stay together from the first shuffle by its key: ranking, derivation and pivot
    group by the key and more, for which that placement is enough.
    """
    spark = documents.sparkSession
    table, variables = rules_frame(spark, list(rules)), variables_of(list(rules))
    rows = select.judge(listed_rows(companies, documents, table, len(rules), units), scope, units=units).persist(StorageLevel.DISK_ONLY)
    judged = rows.where("fact_order is not null")
    met = ["rule_order", "unit_order", "fact_order"]
    best = select.best_candidates(judged, met=met).withColumn("number", C.number("val"))
    kept = best.select("cik10", "company_year", "variable", "val", "number", *[c for c in schemas.FACT if c not in ("source_file",)], "source_file", *select.RANKS, "rule_order")
    found = derive.outcomes(derive.side_by_side(kept))
    full = derive.with_derived(kept, found).persist(StorageLevel.DISK_ONLY)
    named = full.join(companies, "cik10")
    long = named.withColumn("value", F.col("val")).orderBy("cik10", "company_year", "tier_rank", "tag_priority", "rule_order", "variable").select(*schemas.LONG)
    values = panel.wide(full.select("cik10", "company_year", "variable", F.col("number").alias("value")), variables)
    wide = panel.with_companies(values, companies, variables)
    counts = _stats(companies, rows, judged, found)
    n_companies, n_wide = companies.count(), values.count()
    return Panel(
        long,
        wide,
        reports.variable_coverage(full, variables, table, n_companies, n_wide),
        reports.tag_usage(full, table),
        reports.missing_by_company(full, companies, variables),
        counts,
        (rows, full),
    )


def _stats(companies: DataFrame, rows: DataFrame, judged: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters over companies, files, facts and derivations, from what ``listed_rows`` lists."""
    opened = rows.where("status is not null")
    states = companies.select("cik10").join(opened.select("cik10", "status"), "cik10", "left").agg(
        F.count_distinct("cik10").alias("companies_in_universe"),
        F.count_if(F.col("status").isin("ok", "no_facts")).alias("companyfacts_files_parsed"),
        F.count_if(F.col("status").isNull()).alias("missing_companyfacts_files"),
        F.count_if(F.col("status") == "corrupt").alias("json_parse_errors"),
        F.count_if(F.col("status") == "no_facts").alias("files_without_facts"),
    )
    files = opened.agg(F.count_distinct("source_file").alias("companyfacts_files_found"))
    by_unit = rows.agg(F.coalesce(F.sum(F.col("foreign").cast("long")), F.lit(0)).alias("facts_rejected_unit"))
    by_fact = judged.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("candidate_facts"),
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in select.REASONS if r != "facts_rejected_unit"],
    )
    # tables of one row each, side by side by a constant key
    out = states.withColumn("__one", F.lit(1))
    for part in (files, by_unit, by_fact, derive.counters(found)):
        out = out.join(part.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def report_of(result: Panel, scope: Scope, inputs: dict) -> str:
    stats = result.stats.first().asDict()
    rows = {name: df.count() for name, df in (("long", result.long), ("wide", result.wide), ("variable_coverage", result.coverage), ("tag_usage", result.usage), ("missing_by_company", result.missing))}
    years = "open" if scope.start_year is None and scope.end_year is None else f"{scope.start_year}-{scope.end_year}"
    said = {**inputs, "accepted_units": ";".join(select.UNITS), "accepted_forms": ";".join(scope.forms), "company_years": years, "horizon_years": scope.horizon_years, "last_split_year": scope.max_split_year}
    return reports.quality_report(said, stats, rows)


def write_panel(result: Panel, folder: str) -> None:
    for name in ("long", "wide", "coverage", "usage", "missing", "stats"):
        tables.write_parquet(getattr(result, name), f"{folder}/{name}")


def check_panel(result_wide: DataFrame, result_long: DataFrame, scope: Scope, rules: Sequence[Rule], *, this_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbered warnings, summary) of a panel."""
    found = quality.all_warnings(result_wide, result_long, scope, rules, this_year=this_year)
    return quality.ranked(found), quality.summary(found).orderBy(*quality.summary_order())


def run(spark: SparkSession, metadata: DataFrame, documents: DataFrame, rules: Sequence[Rule], scope: Scope, folder: str, *, this_year: int | None = None) -> Panel:
    """All steps from company metadata and fact documents to written tables."""
    universe, excluded, summary = universe_of(metadata)
    for name, df in (("universe", universe), ("excluded", excluded), ("universe_summary", summary)):
        tables.write_parquet(df, f"{folder}/{name}")
    companies = companies_of(spark.read.parquet(f"{folder}/universe"))
    result = build_panel(companies, documents, rules, scope)
    write_panel(result, folder)
    warnings, checks = check_panel(spark.read.parquet(f"{folder}/wide"), spark.read.parquet(f"{folder}/long"), scope, rules, this_year=this_year)
    tables.write_parquet(warnings, f"{folder}/warnings")
    tables.write_parquet(checks, f"{folder}/warnings_summary")
    return result

