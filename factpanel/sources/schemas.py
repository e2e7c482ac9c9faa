"""Schemas and column lists of the tables, and checks that a table has its columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of the columns and variables of the published tables.
COMPANY = ["research_universe_id", "cik", "cik10", "company_name", "primary_ticker", "research_sector", "fiscal_year_end"]
FLOWS = ["revenues", "net_income", "cost_of_revenue", "operating_costs", "depreciation_amortization", "ebit", "interest_expense", "capex", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow"]
STOCKS = ["assets", "liabilities", "liabilities_and_equity", "current_assets", "current_liabilities", "equity", "cash", "accounts_receivable", "inventory", "ppe", "intangible_assets", "goodwill", "long_term_investments", "long_term_debt", "short_term_debt", "retained_earnings"]
VARIABLES = """assets liabilities liabilities_and_equity current_assets current_liabilities revenues net_income equity cash
accounts_receivable inventory cost_of_revenue operating_costs ppe intangible_assets goodwill depreciation_amortization
long_term_investments long_term_debt short_term_debt ebit interest_expense capex retained_earnings operating_cash_flow
investing_cash_flow financing_cash_flow""".split()
FACT = ["unit", "namespace", "tag", "tier", "tag_priority", "form", "fp", "filed", "accn", "frame", "start", "end", "fy", "source_file"]
LONG = [*COMPANY, "company_year", "variable", "value", *FACT]
METADATA = """cik cik10 name_from_ticker_map name_from_sec entity_type sic sic_description fiscal_year_end tickers exchanges
source_url cache_path download_status downloaded_at error_message""".split()
CLASSIFIED = """cik cik10 name_from_ticker_map name_from_sec entity_type sic sic_int sic_description sic_major_group
research_sector include_in_research_universe exclude_reason classification_rule fiscal_year_end tickers exchanges""".split()
UNIVERSE = """research_universe_id cik cik10 company_name primary_ticker tickers primary_exchange exchanges entity_type sic
sic_int sic_description sic_major_group research_sector fiscal_year_end classification_rule""".split()
EXCLUDED = """cik cik10 company_name primary_ticker tickers primary_exchange exchanges entity_type sic sic_int
sic_description sic_major_group research_sector include_in_research_universe exclude_reason classification_rule""".split()
INVENTORY = "namespace tag label description units forms company_count company_year_count fact_count".split()
COVERAGE = """variable configured_tag_count selected_observations companies_with_value company_years_with_value
company_coverage_ratio company_year_coverage_ratio units forms""".split()
TAG_USAGE = """variable tier tag_priority namespace tag selected_observations companies_with_selected_value
company_years_with_selected_value units forms""".split()
MISSING = [*COMPANY, "company_year_count", "selected_observations", "variables_with_any_value", "variables_missing_any_value", "missing_variables"]
WARNING = """warning_id severity check_name scope research_universe_id cik cik10 company_name primary_ticker research_sector
company_year variable value reference_variable reference_value details""".split()
SUMMARY = "severity check_name warning_count company_count company_year_count first_warning_id".split()

RULES = T.StructType(
    [
        T.StructField("variable", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("tier_rank", T.IntegerType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("tag_priority", T.IntegerType()),
        T.StructField("rule_order", T.IntegerType()),
    ]
)


def strings(names: Iterable[str]) -> T.StructType:
    """A schema of text columns: nothing is inferred, so leading zeros stay."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df
