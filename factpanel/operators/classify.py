"""Companies classified by industry code, and the research universe selected from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import schemas
from .numbering import numbered

# Ranges of industry codes, words and labels of the published classification.
MAJOR_GROUPS = [
    (100, 999, "Agriculture_Forestry_Fishing"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transportation_Communications_Utilities"),
    (5000, 5199, "Wholesale_Trade"),
    (5200, 5999, "Retail_Trade"),
    (6000, 6799, "Finance_Insurance_Real_Estate"),
    (7000, 8999, "Services"),
    (9000, 9999, "Public_Administration_Or_Nonclassifiable"),
]
TECHNOLOGY = [(3570, 3579), (3660, 3669), (3670, 3679), (3810, 3819), (3820, 3829), (7370, 7379)]
TECHNOLOGY_WORDS = ["computer", "software", "semiconductor", "data processing", "electronic", "communications equipment"]
EXTENDED = [
    (8000, 8099, "extended_candidate_healthcare_services"),
    (7000, 8999, "extended_candidate_services"),
    (5000, 5199, "extended_candidate_wholesale_trade"),
    (1500, 1799, "extended_candidate_construction"),
    (4000, 4899, "extended_candidate_transportation_communications"),
    (1000, 1499, "extended_candidate_energy_mining"),
]
SPAC_WORDS = ["blank check", "special purpose acquisition", "acquisition corp", "acquisition corporation", "acquisition company", "acquisition co", "spac"]
REIT_WORDS = ["real estate investment trust", "reit"]
FUND_WORDS = ["etf", "fund", "trust", "portfolio", "shares", "physical gold", "physical silver"]
TARGET_SECTORS = ["Technology", "Retail", "Industrials_Manufacturing", "Extended_Candidate"]


#: (sector, reason for leaving it out, rule) in the order in which they are tried; the twelfth's rule is the range's label.
OUTCOMES = [
    ("Unknown", "metadata_download_error", "download_status_not_success"),
    ("Unknown", "missing_sic", "sic_missing_or_invalid"),
    ("Excluded_NonOperating_Entity", "non_operating_entity_type", "entity_type_not_operating"),
    ("Excluded_SPAC_Blank_Check", "spac_or_blank_check_company", "sic_6770_or_blank_check_keyword"),
    ("Excluded_REIT", "reit_excluded", "sic_6798_or_reit_keyword"),
    ("Excluded_Fund_ETF_Trust", "fund_etf_or_trust_excluded", "fund_etf_trust_keyword_or_sic"),
    ("Excluded_Financials_Insurance_RealEstate", "financials_insurance_real_estate_excluded", "sic_6000_6799"),
    ("Excluded_Utilities", "utilities_excluded", "sic_4900_4999"),
    ("Technology", "", "technology_sic_range_or_keyword"),
    ("Retail", "", "sic_5200_5999"),
    ("Industrials_Manufacturing", "", "sic_2000_3999_non_technology"),
    ("Extended_Candidate", "", ""),
    ("Other_Out_Of_Scope", "out_of_scope_sector", "not_in_target_research_sectors"),
]


def first_rule(code: Column, described: Column, words: Column, kind: Column, status: Column) -> Column:
    """The number, from 1, of the first of OUTCOMES that holds.

    Words are looked for anywhere, within other words too: "aerospace" holds "spac".
    """
    technology = reduce(lambda a, b: a | b, [C.between(code, *r) for r in TECHNOLOGY]) | C.contains_any(described, TECHNOLOGY_WORDS)
    tests = [
        F.lower(C.strip(C.text(status))) != "success",
        code.isNull(),
        (kind != "") & (kind != "operating"),
        (code == 6770) | C.contains_any(words, SPAC_WORDS),
        (code == 6798) | C.contains_any(words, REIT_WORDS),
        code.isin(6722, 6726, 6732, 6733) | C.contains_any(words, FUND_WORDS),
        C.between(code, 6000, 6799),
        C.between(code, 4900, 4999),
        technology,
        C.between(code, 5200, 5999),
        C.between(code, 2000, 3999),
        C.label_of_range(code, EXTENDED).isNotNull(),
    ]
    out = F.lit(len(OUTCOMES))
    for number, test in list(enumerate(tests, 1))[::-1]:
        out = F.when(test, number).otherwise(out)
    return out


def classify(metadata: DataFrame, *, compat_nan: bool = False) -> DataFrame:
    """Metadata with codes, groups, sector, inclusion, reason and rule (columns CLASSIFIED).

    Blank and null are the same.  With ``compat_nan`` a missing entity type or name reads "nan", as
    it did where the table went through CSV: such a company isn't operating, and its name is "nan".
    """
    entity, sec = F.col("entity_type"), F.col("name_from_sec")
    if compat_nan:
        entity, sec = (F.coalesce(C.blank_to_null(c), F.lit("nan")) for c in (entity, sec))
    name = F.coalesce(F.nullif(sec, F.lit("")), F.nullif(F.col("name_from_ticker_map"), F.lit("")), F.lit(""))
    # steps of their own: code, words and rule are computed once, and what is generated stays small
    described = F.lower(C.text("sic_description"))
    words = {"sic_int": C.industry_code("sic"), "described": described, "words": F.concat_ws(" ", described, F.lower(C.text(name))), "kind": F.lower(C.strip(C.text(entity)))}
    worded = metadata.withColumns({f"__{k}": v for k, v in words.items()})
    code = F.col("__sic_int")
    with_class = worded.withColumn("__rule", first_rule(code, F.col("__described"), F.col("__words"), F.col("__kind"), F.col("download_status")))
    sector, reason, rule = (F.element_at(F.array(*[F.lit(o[i]) for o in OUTCOMES]), F.col("__rule")) for i in range(3))
    return with_class.select(
        "cik",
        C.zero_pad("cik10", 10).alias("cik10"),
        "name_from_ticker_map",
        "name_from_sec",
        "entity_type",
        "sic",
        code.alias("sic_int"),
        "sic_description",
        C.label_of_range(code, MAJOR_GROUPS, "Unknown").alias("sic_major_group"),
        sector.alias("research_sector"),
        (reason == "").alias("include_in_research_universe"),
        reason.alias("exclude_reason"),
        F.when(rule == "", C.label_of_range(code, EXTENDED)).otherwise(rule).alias("classification_rule"),
        C.zero_pad("fiscal_year_end", 4).alias("fiscal_year_end"),
        "tickers",
        "exchanges",
    )


def normalized(classified: DataFrame) -> DataFrame:
    """Adds company_name, primary_ticker and primary_exchange."""
    schemas.require_columns(classified, [c for c in schemas.CLASSIFIED], "classified companies")
    return classified.withColumns(
        {
            "cik10": C.zero_pad("cik10", 10),
            "company_name": C.first_name("name_from_sec", "name_from_ticker_map"),
            "primary_ticker": C.first_item("tickers"),
            "primary_exchange": C.first_item("exchanges"),
        }
    )


def in_universe() -> Column:
    return (
        F.coalesce(F.col("include_in_research_universe"), F.lit(False))
        & F.coalesce(F.col("research_sector").isin(TARGET_SECTORS), F.lit(False))
        & F.coalesce(F.lower("entity_type") == "operating", F.lit(False))
        & F.col("sic_int").isNotNull()
    )


def universe(companies: DataFrame) -> DataFrame:
    """Companies of the universe, numbered in order of sector, code, name and key."""
    order = [F.col(c).asc_nulls_last() for c in ("research_sector", "sic_int", "company_name", "cik10")]
    kept = numbered(companies.where(in_universe()), order, "research_universe_id")
    return kept.withColumn("research_universe_id", F.col("research_universe_id").cast("int")).select(*schemas.UNIVERSE)


def excluded(companies: DataFrame) -> DataFrame:
    """Companies whose key no row includes, or whose sector isn't a target.

    This isn't the complement of the universe: an included company of a target sector that isn't
    operating or has no code is in neither.
    """
    included = companies.where("include_in_research_universe").select("cik10").distinct().withColumn("__included", F.lit(True))
    joined = companies.join(included, "cik10", "left")
    out = joined.where(F.col("__included").isNull() | ~F.coalesce(F.col("research_sector").isin(TARGET_SECTORS), F.lit(False)))
    order = [F.col(c).asc_nulls_last() for c in ("exclude_reason", "research_sector", "company_name", "cik10")]
    return out.orderBy(*order).select(*schemas.EXCLUDED)


def universe_summary(companies: DataFrame) -> DataFrame:
    """(metric, value): totals, missing values, and counts by sector, group and exchange."""
    is_in = in_universe()

    def where(c: Column) -> Column:
        return F.when(is_in, c)

    totals = companies.agg(
        F.count("*").alias("input_rows"),
        F.count_if(is_in).alias("research_universe_rows"),
        F.count_if(~is_in).alias("excluded_or_out_of_scope_rows"),
        F.count_distinct(where(F.col("cik10"))).alias("unique_ciks_in_research_universe"),
        F.count_distinct(where(F.nullif(F.col("primary_ticker"), F.lit("")))).alias("unique_primary_tickers_in_research_universe"),
        F.count_if(is_in & (F.col("primary_ticker") == "")).alias("missing_primary_ticker_in_research_universe"),
        F.count_if(is_in & (F.col("primary_exchange") == "")).alias("missing_primary_exchange_in_research_universe"),
    )
    long = totals.unpivot([], totals.columns, "metric", "value")
    exchange = F.when(F.col("primary_exchange") == "", "missing").otherwise(F.col("primary_exchange"))
    labels = {"sector_count": F.col("research_sector"), "sic_major_group_count": F.col("sic_major_group"), "primary_exchange_count": exchange}
    metrics = F.array_compact(F.array(*[F.concat(F.lit(f"{k}__"), v) for k, v in labels.items()]))
    return long.unionByName(companies.where(is_in).select(F.explode(metrics).alias("metric")).groupBy("metric").agg(F.count("*").alias("value")))
