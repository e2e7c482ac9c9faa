"""The check catalogue on hand-written panels."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factpanel.operators import quality
from factpanel.sources import config, schemas
from factpanel.sources.config import Scope

SCOPE = Scope(("10-K",), 2011, 2025)
RULES = config.read_rules()


def wide_of(spark, rows, variables=schemas.VARIABLES):
    """Rows of (company, year, {variable: text})."""
    names = [*schemas.COMPANY, "company_year", *variables]
    data = [(str(c), str(c), f"{c:010d}", f"N{c}", "T", "Retail", "1231", y, *[values.get(v) for v in variables]) for c, y, values in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))


def long_of(spark, rows):
    """Rows of (company, year, variable, value, {changes})."""
    base = {"unit": "USD", "namespace": "us-gaap", "tier": "tier_1", "tag_priority": "1", "form": "10-K", "fp": "FY", "accn": "a", "frame": None, "source_file": "f"}
    data = []
    for c, y, variable, value, changes in rows:
        rule = next(r for r in RULES if r.variable == variable)
        row = base | {"tag": rule.tag, "fy": y, "start": f"{y}-01-01", "end": f"{y}-12-31", "filed": f"{int(y) + 1}-02-01"} | changes
        data.append((str(c), str(c), f"{c:010d}", f"N{c}", "T", "Retail", "1231", y, variable, value, *[row[f] for f in schemas.FACT]))
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in schemas.LONG))


def names(warnings, **where):
    rows = [r for r in warnings.collect() if all(r[k] == v for k, v in where.items())]
    return Counter(r["check_name"] for r in rows)


def full(**values):
    """A row with enough values not to be sparse."""
    return {"long_term_debt": "1", "short_term_debt": "1", "retained_earnings": "1", "depreciation_amortization": "1"} | values


ROW_CASES = [
    ({"assets": "-1"}, {"assets_negative"}),
    ({"liabilities_and_equity": "-1"}, {"liabilities_and_equity_negative"}),
    ({"cash": "-5", "inventory": "-5", "ppe": "-1", "liabilities": "-1"}, {"cash_negative", "inventory_negative", "ppe_negative", "liabilities_negative"}),
    ({"assets": "1.051", "liabilities_and_equity": "1"}, {"assets_differs_from_liabilities_and_equity"}),
    ({"assets": "105", "liabilities_and_equity": "100"}, set()),
    ({"assets": "100", "liabilities": "151"}, {"liabilities_absurdly_above_assets"}),
    ({"assets": "100", "liabilities": "160", "equity": "-60"}, set()),
    ({"assets": "100", "liabilities": "160", "equity": "-20"}, {"liabilities_absurdly_above_assets"}),
    ({"assets": "100", "current_assets": "106", "cash": "106", "accounts_receivable": "106", "inventory": "106", "ppe": "106", "goodwill": "106"}, {f"{v}_above_assets" for v in ("current_assets", "cash", "accounts_receivable", "inventory", "ppe", "goodwill")}),
    ({"liabilities": "100", "current_liabilities": "106"}, {"current_liabilities_above_liabilities"}),
    ({"assets": "100", "liabilities": "10", "equity": "30"}, {"large_assets_liabilities_equity_gap"}),
    ({"revenues": "-1"}, {"revenues_negative"}),
    ({"net_income": "-21", "revenues": "10", "assets": "14"}, {"net_loss_abs_large_relative_to_revenues"}),
    ({"net_income": "-22", "assets": "14"}, {"net_loss_abs_large_relative_to_assets"}),
    ({"net_income": "21", "revenues": "10", "assets": "13"}, {"net_profit_large_relative_to_revenues", "net_profit_large_relative_to_assets"}),
    ({"net_income": "21", "revenues": "0"}, set()),
    ({"cost_of_revenue": "-1"}, {"cost_of_revenue_negative"}),
    ({"operating_costs": "-1"}, {"operating_costs_negative"}),
    ({"operating_costs": "100", "cost_of_revenue": "106"}, {"cost_of_revenue_above_operating_costs"}),
    ({"capex": "-1"}, {"capex_negative"}),
    ({"cash": "1d"}, {"non_numeric_financial_value"}),
]


def test_row_checks(spark):
    rows = [(i + 1, "2020", full(**values)) for i, (values, _) in enumerate(ROW_CASES)]
    got = quality.wide_warnings(quality.prepare_wide(wide_of(spark, rows)), SCOPE, 2026).collect()
    for i, (values, want) in enumerate(ROW_CASES):
        assert {r["check_name"] for r in got if r["cik"] == str(i + 1)} == want, values
    shown = next(r for r in got if r["check_name"] == "liabilities_absurdly_above_assets" and r["cik"] == "6")
    assert (shown["variable"], shown["value"], shown["reference_variable"], shown["reference_value"]) == ("liabilities", "151", "assets", "100")
    raw = next(r for r in got if r["check_name"] == "non_numeric_financial_value")
    assert (raw["variable"], raw["value"]) == ("cash", "1d")


def test_structure_checks(spark):
    rows = [(1, "2020", full()), (1, "2020", full()), (2, "odd", full()), (3, "2010", full()), (4, "2030", full()), (5, "2020", {"cash": "1", "ppe": "1", "capex": "1"})]
    got = quality.wide_warnings(quality.prepare_wide(wide_of(spark, rows)), SCOPE, 2026)
    assert names(got) == {"wide_duplicate_company_year": 2, "company_year_not_numeric": 1, "company_year_outside_configured_dataset_range": 2, "company_year_in_future": 1, "sparse_company_year": 1}
    fewer = wide_of(spark, [(1, "2020", {"assets": "-1"})], ["assets", "cash"])
    missing = quality.missing_columns_warning(fewer).first()
    assert (missing["check_name"], missing["value"], missing["reference_value"]) == ("financial_variables_missing_from_wide", "25", "27")
    assert quality.missing_columns_warning(wide_of(spark, rows)).isEmpty()
    assert set(names(quality.wide_warnings(quality.prepare_wide(fewer), SCOPE, 2026))) == {"assets_negative", "sparse_company_year"}


def test_coverage_checks(spark):
    years = lambda c, n, k: [(c, str(2011 + i), {"assets": "1" if i < k else None, "liabilities": "1", "revenues": "1", "net_income": "1", "equity": "1", "operating_cash_flow": "1"}) for i in range(n)]
    got = quality.coverage_warnings(quality.prepare_wide(wide_of(spark, years(1, 4, 0) + years(2, 5, 2) + years(3, 6, 3)))).collect()
    assert [(r["check_name"], r["cik"], r["scope"], r["company_year"], r["value"], r["reference_value"]) for r in got] == [("assets_missing_for_majority_of_years", "2", "company", "2011", "2", "5")]


LONG_CASES = [
    ("assets", {"namespace": "derived"}, {"derived_source_metadata_invalid"}),
    ("assets", {"unit": "EUR"}, {"source_unit_outside_accepted_units"}),
    ("assets", {"unit": " usd "}, set()),
    ("assets", {"tag": "Other"}, {"source_tag_not_in_sec_tags_config"}),
    ("assets", {"filed": "2020-12-01"}, {"source_filing_before_period_end"}),
    ("assets", {"filed": "2021-08-29"}, {"source_filing_lag_too_long"}),
    ("assets", {"filed": "2022-01-05"}, {"source_filing_lag_too_long", "source_filing_year_after_company_year_window"}),
    ("ebit", {"start": "2020-10-01"}, {"flow_period_not_annual"}),
    ("ebit", {"start": None}, {"flow_period_not_annual"}),
    ("ebit", {"fp": "Q2"}, {"flow_source_fp_not_fy"}),
    ("revenues", {"start": "2020-10-01"}, {"flow_period_not_annual", "revenues_may_be_quarterly"}),
    ("revenues", {"fp": "Q1", "start": None}, {"flow_period_not_annual", "revenues_may_be_quarterly"}),
    ("revenues", {"fp": "Q1", "start": None, "frame": "CY2020"}, {"flow_period_not_annual"}),
]


def test_long_row_checks(spark):
    long = long_of(spark, [(i + 1, "2020", v, "1", c) for i, (v, c, _) in enumerate(LONG_CASES)])
    got = quality.long_rows(long, SCOPE, config.rules_frame(spark, RULES)).collect()
    for i, (_, changes, want) in enumerate(LONG_CASES):
        assert {r["check_name"] for r in got if r["cik"] == str(i + 1)} == want, changes


def test_long_group_checks(spark):
    rows = [
        (1, "2020", "assets", "1", {"fy": "2019", "accn": "a", "end": "2020-12-31"}),
        (1, "2020", "equity", "1", {"fy": "2020", "accn": "b", "end": "2020-12-30"}),
        (1, "2020", "cash", "1", {"form": "10-Q", "fy": "2001"}),
        (2, "2020", "assets", "1", {}),
    ]
    got = {r["check_name"]: r for r in quality.long_groups(long_of(spark, rows), SCOPE).collect()}
    assert set(got) == {"source_form_outside_dataset_config", "source_fy_differs_from_company_year", "mixed_source_fiscal_years", "mixed_source_accessions", "mixed_source_period_ends"}
    assert (got["source_fy_differs_from_company_year"]["variable"], got["source_fy_differs_from_company_year"]["value"]) == ("assets", "2019")
    assert (got["mixed_source_fiscal_years"]["variable"], got["mixed_source_fiscal_years"]["value"]) == ("assets;equity", "2019;2020")
    assert got["mixed_source_accessions"]["value"] == "2" and got["source_form_outside_dataset_config"]["variable"] == "cash"


def test_consistency_and_formulas(spark):
    wide = wide_of(spark, [(1, "2020", full(assets="10", liabilities_and_equity="11", revenues="5", ebit="1", operating_costs="4")), (2, "2020", full())])
    rows = [(1, "2020", v, x, {}) for v, x in (("long_term_debt", "1"), ("short_term_debt", "1"), ("retained_earnings", "1"), ("depreciation_amortization", "1"), ("liabilities_and_equity", "11"), ("revenues", "5.5"), ("ebit", "1"))]
    derived = {"namespace": "derived", "tier": "derived"}
    rows += [(1, "2020", "assets", "10", derived | {"tag": "LiabilitiesAndStockholdersEquityAsAssets"}), (1, "2020", "operating_costs", "4", derived | {"tag": "RevenuesLessOperatingIncomeLoss"})]
    rows += [(1, "2020", "ebit", "1", {}), (3, "2020", "cash", "1", {})]
    long = long_of(spark, rows)
    typed = quality.prepare_wide(wide)
    got = quality.consistency_warnings(typed, long)
    counts = names(got)
    assert counts["long_duplicate_company_year_variable"] == 1 and counts["wide_company_year_missing_from_long"] == 1 and counts["long_company_year_missing_from_wide"] == 1
    off = {(r["cik10"][-1], r["variable"]): (r["value"], r["reference_value"]) for r in got.collect() if r["check_name"] == "wide_value_differs_from_long"}
    assert off[("1", "revenues")] == ("5", "5.5") and ("2", "long_term_debt") in off and ("1", "assets") not in off
    assert names(quality.formula_warnings(typed, long)) == {"derived_assets_formula_mismatch": 1}


def test_dataset_checks_and_numbers(spark):
    wide = wide_of(spark, [(1, "2020", full(assets="-1"))])
    empty = long_of(spark, [(1, "2020", "cash", "1", {})]).where(F.lit(False))
    found = quality.ranked(quality.all_warnings(wide, empty, SCOPE, RULES, this_year=2026)).collect()
    assert [(r["warning_id"], r["check_name"]) for r in sorted(found, key=lambda r: r["warning_id"])] == [(1, "assets_negative"), (2, "long_facts_not_available"), (3, "revenue_metadata_not_available")]
    without = quality.all_warnings(wide, long_of(spark, [(1, "2020", "cash", "1", {})]), SCOPE, [], this_year=2026)
    assert names(without)["sec_tags_config_not_available"] == 1
    summary = {r["check_name"]: r for r in quality.summary(quality.ranked(quality.all_warnings(wide, empty, SCOPE, RULES, this_year=2026))).collect()}
    assert (summary["assets_negative"]["company_count"], summary["assets_negative"]["company_year_count"]) == (1, 1)
    assert summary["long_facts_not_available"]["company_year_count"] is None
    with pytest.raises(ValueError):
        quality.all_warnings(wide, empty.drop("accn"), SCOPE, RULES)
    nothing = quality.ranked(quality.all_warnings(wide, empty, SCOPE, RULES, this_year=2026).where(F.lit(False)))
    assert nothing.count() == 0 and quality.summary(nothing).count() == 0


def random_panels(spark, seed, n=60):
    """A wide and a long panel with everything that can be odd: repeated, blank and null keys, texts that aren't numbers, missing partners."""
    rng = random.Random(seed)
    keys = [(rng.randint(1, 9), rng.choice(["2012", "2013", "2014", "2015", "2016", "2017", "odd", "", None, "2050"])) for _ in range(n)]
    value = lambda: rng.choice([None, "1", "-5", "100", "104.5", "2000", "x", " "])
    wide = wide_of(spark, [(c, y, {v: value() for v in schemas.VARIABLES if rng.random() < 0.7}) for c, y in keys])
    rows = []
    for c, y in keys[: n // 2] + [(rng.randint(8, 12), "2014") for _ in range(10)]:
        for variable in rng.choices(schemas.VARIABLES, k=rng.randint(0, 9)):
            year = y if (y or "").isdigit() else "2014"
            changes = {"form": rng.choice(["10-K", "10-K", " 10-k", "8-K"]), "fy": rng.choice([year, year, "2001", None, ""]), "accn": rng.choice("aab"), "end": rng.choice([f"{year}-12-31", f"{year}-12-31", f"{year}-09-30", None, "x"])}
            changes |= {"start": rng.choice([f"{year}-01-01", f"{year}-10-01", None]), "filed": rng.choice([f"{int(year) + 1}-02-01", f"{year}-01-01", None]), "unit": rng.choice(["USD", "EUR", None]), "fp": rng.choice(["FY", "Q1", None])}
            made = {"assets": "LiabilitiesAndStockholdersEquityAsAssets", "operating_costs": "RevenuesLessOperatingIncomeLoss"}.get(variable)
            if made and rng.random() < 0.6:
                changes |= {"namespace": "derived", "tier": rng.choice(["derived", "tier_1"]), "tag": made}
            elif rng.random() < 0.2:
                changes |= {"tag": rng.choice(["Other", None])}
            rows.append((c, year, variable, rng.choice(["1", "100", "x", None]), changes))
    long = long_of(spark, rows)
    odd = F.when(F.col("cik") == "9", F.lit(None)).when(F.col("cik") == "8", F.lit("")).otherwise(F.col("cik10"))
    return wide.withColumn("cik10", odd), long.withColumn("cik10", odd)


def part_by_part(wide, long, rules):
    """The catalogue by the functions that each run a part of it, in one union."""
    spark, typed = wide.sparkSession, quality.prepare_wide(wide)
    table = config.rules_frame(spark, rules) if rules else None
    parts = [quality.wide_warnings(typed, SCOPE, 2026), quality.coverage_warnings(typed), quality.consistency_warnings(typed, long), quality.long_rows(long, SCOPE, table), quality.long_groups(long, SCOPE), quality.formula_warnings(typed, long)]
    return sorted(str(tuple(r)) for p in parts for r in p.collect())


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_gives_what_the_parts_give(spark, seed):
    wide, long = random_panels(spark, seed)
    rules = RULES if seed % 2 else []
    found = quality.all_warnings(wide, long, SCOPE, rules, this_year=2026).collect()
    single = {"financial_variables_missing_from_wide", "sec_tags_config_not_available", "revenue_metadata_not_available"}
    assert sorted(str(tuple(r)) for r in found if r["check_name"] not in single) == part_by_part(wide, long, rules)
    assert len({r["check_name"] for r in found}) > 30
    assert not any(r["check_name"] == "revenue_metadata_not_available" for r in found)
    without = quality.all_warnings(wide, long.where("variable <> 'revenues'"), SCOPE, rules, this_year=2026)
    assert names(without)["revenue_metadata_not_available"] == 1


@pytest.mark.parametrize("seed", range(2))
def test_dataset_warnings_are_those_of_the_whole_run_and_only_counted(spark, seed):
    wide, long = random_panels(spark, seed)
    for facts, rules in ((long, RULES), (long, []), (long.where("variable <> 'revenues'"), []), (long.where("false"), RULES)):
        whole = quality.all_warnings(wide, facts, SCOPE, rules, this_year=2026).where("scope = 'dataset'")
        assert sorted(map(str, quality.dataset_warnings(wide, facts, rules).collect())) == sorted(map(str, whole.collect()))
    plan = quality.dataset_counts(wide, long)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "regexp" not in plan


def test_texts_of_facts_are_parsed_once(spark):
    plan = quality.long_rows(random_panels(spark, 0)[1], SCOPE, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{4}-\d{2}-\d{2}") == 3  # start, end and filed


def test_each_panel_is_read_and_dealt_out_once(spark, tmp_path):
    wide, long = random_panels(spark, 1)
    wide.write.parquet(str(tmp_path / "wide"))
    long.write.parquet(str(tmp_path / "long"))
    wide, long = (spark.read.parquet(str(tmp_path / n)) for n in ("wide", "long"))
    years = quality.company_years(quality.prepare_wide(wide), long, SCOPE, config.rules_frame(spark, RULES), len(RULES))
    plan = quality.judged_years(years, schemas.VARIABLES, SCOPE, 2026)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert len([line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "cik10" in line]) == 1


def test_summary_counts_from_unnumbered_warnings(spark):
    found = quality.all_warnings(*random_panels(spark, 2), SCOPE, RULES, this_year=2026)
    rows = quality.ranked(found).collect()
    for s in quality.summary(found).collect():
        mine = [r for r in rows if (r["severity"], r["check_name"]) == (s["severity"], s["check_name"])]
        years = {(r["cik10"], r["company_year"]) for r in mine if r["cik10"].strip() and r["company_year"].strip()}
        assert (s["warning_count"], s["company_count"], s["company_year_count"], s["first_warning_id"]) == (len(mine), len({r["cik10"] for r in mine if r["cik10"]}), len(years) or None, min(r["warning_id"] for r in mine))
    plan = quality.summary(found)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_numbers_are_dense_over_many_partitions(spark):
    from factpanel.operators.numbering import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(9)
    got = [(r["x"], r["n"]) for r in numbered(df, [F.col("x")], "n").collect()]
    assert sorted(got) == [(x, i + 1) for i, x in enumerate(sorted(x for x, _ in got))]
