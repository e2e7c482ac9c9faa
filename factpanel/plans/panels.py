"""Queries that run whole steps: documents to a panel, landed lists to tables, tables to files and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classify, derive, inventory, panel, quality, select
from ..operators.numbering import checkpoint, placed, use_shared_folder
from ..sources import config, facts, tables
from ..sources.config import Rule, rules_frame
from . import checks, pipeline
from .driver import BEST_SQL, CLASSIFIED_SQL, FACTS_SQL, RULES_SQL, SCOPE, WIDE_SQL, _long_sql, companies, line_facts, orders_wide, part_companies, query, table

# ---------------------------------------------------------------- documents to a panel

RULES = [
    Rule("revenues", "tier_1", 1, "F", "A", 1, 0),
    Rule("liabilities_and_equity", "tier_1", 1, "F", "R", 1, 1),
    Rule("equity", "tier_2", 2, "F", "N", 1, 2),
    Rule("ebit", "tier_1", 1, "O", "A", 1, 3),
    Rule("assets", "tier_1", 1, "O", "N", 1, 4),
    Rule("operating_costs", "tier_3", 3, "O", "R", 1, 5),
]
VARIABLES = [r.variable for r in RULES]  # those of the wide panel; liabilities, which no rule names, stand in the long one
_RULES_SQL = "rules(variable, tier, tier_rank, namespace, tag, tag_priority, rule_order) AS (VALUES " + ", ".join(f"('{r.variable}', '{r.tier}', {r.tier_rank}, '{r.namespace}', '{r.tag}', {r.tag_priority}, {r.rule_order})" for r in RULES) + ")"
_CARRIED = 'unit, form, fp, filed, accn, frame, start, "end", fy'
_RANKS = ", ".join(select.RANKS[:-1])


def _made(variable: str, tag: str, value: str, condition: str, sources: list[str]) -> str:
    first, *more = sources
    joins = "".join(f" JOIN best {s} USING (cik10, company_year)" for s in more)
    ranks = ", ".join(f"greatest({', '.join(f'{s}.{r}' for s in sources)}) AS {r}" if more else f"{first}.{r}" for r in select.RANKS[:-1])
    where = " AND ".join([f"{s}.variable = '{s}'" for s in sources] + [condition])
    carried = ", ".join(f"{first}.{c.strip()}" for c in _CARRIED.split(","))
    return f"SELECT cik10, company_year, '{variable}' AS variable, {value} AS number, 'derived' AS namespace, '{tag}' AS tag, 'derived' AS tier, 0 AS tag_priority, 99 AS tier_rank, {first}.rule_order, {carried}, {ranks} FROM best {first}{joins} WHERE {where}"


_N = {v: f"CAST({v}.val AS DOUBLE)" for v in VARIABLES}
_ABSENT = "NOT EXISTS (SELECT 1 FROM best x WHERE x.cik10 = liabilities_and_equity.cik10 AND x.company_year = liabilities_and_equity.company_year AND x.variable = 'assets')"
PANEL_SQL = f"""{BEST_SQL.replace(RULES_SQL, _RULES_SQL)},
costs AS ({_made("operating_costs", derive.COSTS_TAG, f"{_N['revenues']} - {_N['ebit']}", f"{_N['revenues']} - {_N['ebit']} >= 0", ["revenues", "ebit"])}),
made AS (SELECT * FROM costs UNION ALL {_made("assets", derive.ASSETS_TAG, _N["liabilities_and_equity"], _ABSENT, ["liabilities_and_equity"])}
  UNION ALL {_made("liabilities", derive.LIABILITIES_TAG, f"{_N['liabilities_and_equity']} - {_N['equity']}", f"{_N['liabilities_and_equity']} - {_N['equity']} >= 0", ["liabilities_and_equity", "equity"])}),
full_panel AS (SELECT cik10, company_year, variable, CAST(val AS DOUBLE) AS number, namespace, tag, tier, tag_priority, tier_rank, rule_order, {_CARRIED}, {_RANKS} FROM best b
  WHERE variable <> 'operating_costs' OR NOT EXISTS (SELECT 1 FROM costs c WHERE c.cik10 = b.cik10 AND c.company_year = b.company_year) UNION ALL SELECT * FROM made)"""
_SHOWN = ["cik10", "company_year", "variable", "number", "unit", "namespace", "tag", "tier", "tag_priority", "form", "fp", "filed", "accn", "frame", "start", "end", "fy"]
_SHOWN_SQL = ", ".join(f'"{c}"' if c != "tag_priority" else "CAST(tag_priority AS INTEGER) AS tag_priority" for c in _SHOWN)


def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies' lines as fact documents; a company's orders are cut into parts of a hundred, which bounds each document.

    Every fiftieth company has a broken document besides.
    """
    fields = ["start", "end", "val", "accn", "fy", "fp", "form", "filed", "frame"]
    f = line_facts(spark, sf_dir).withColumn("part", F.floor(F.col("accn").cast("long") / 100)).withColumn("val", F.when(F.col("val") != "", F.col("val").cast("long")))
    levels = ["namespace", "tag", "unit"]
    lists = f.groupBy("cik10", "part").agg(F.sort_array(F.collect_list(F.struct(*levels, F.struct(*fields).alias("fact")))).alias("all"))

    def opened(items, depth: int):
        """A document's facts by the names of a level, which follow each other in its sorted list, and of those below it."""
        if depth == len(levels):
            return F.transform(items, lambda x: x["fact"])
        names = F.array_distinct(F.transform(items, lambda x: x[levels[depth]]))
        below = F.transform(names, lambda v: F.struct(v.alias("k"), opened(F.filter(items, lambda x: x[levels[depth]] == v), depth + 1).alias("v")))
        by_name = F.map_from_entries(below)
        return F.struct(by_name.alias("units")) if levels[depth] == "unit" else by_name

    whole = lists.select("cik10", "part", opened(F.col("all"), 0).alias("facts"))
    name = lambda part: F.concat(part, F.lit("/CIK"), F.col("cik10"), F.lit(".json"))
    good = whole.select(name(F.col("part").cast("string")).alias("source_file"), F.to_json(F.struct(F.col("cik10").alias("cik"), "facts")).alias("text"))
    broken = companies(spark, sf_dir).where("cast(cik10 as long) % 50 = 0").select(name(F.lit("broken")).alias("source_file"), F.lit('{"facts": {').alias("text"))
    return good.unionByName(broken)


def line_panel(spark: SparkSession, sf_dir: str) -> pipeline.Panel:
    return pipeline.build_panel(companies(spark, sf_dir), line_documents(spark, sf_dir), RULES, SCOPE)


@query(f"WITH {PANEL_SQL} SELECT row_number() OVER (ORDER BY cik10, company_year, tier_rank, tag_priority, rule_order, variable) AS place, {_SHOWN_SQL} FROM full_panel")
def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long panel of documents, in its order."""
    result = line_panel(spark, sf_dir)
    out = placed(result.long.withColumn("number", C.number("value")).select(*_SHOWN))
    result.release()
    return out


@query(f"WITH {PANEL_SQL} SELECT row_number() OVER (ORDER BY cik10, company_year) AS place, cik10, company_year, {', '.join(f"max(number) FILTER (variable = '{v}') AS {v}" for v in VARIABLES)} FROM full_panel GROUP BY cik10, company_year")
def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide panel of documents, in its order."""
    result = line_panel(spark, sf_dir)
    out = placed(result.wide.select("cik10", "company_year", *VARIABLES))
    result.release()
    return out


@query(f"""WITH {PANEL_SQL}, docs AS (SELECT DISTINCT cik10, CAST(accn AS BIGINT) // 100 AS part FROM facts), broken AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 50 = 0)
SELECT 'companies_in_universe' AS metric, count(*) AS value FROM customer
UNION ALL SELECT 'companyfacts_files_found', count(*) + (SELECT n FROM broken) FROM docs UNION ALL SELECT 'companyfacts_files_parsed', count(*) FROM docs
UNION ALL SELECT 'json_parse_errors', n FROM broken UNION ALL SELECT 'files_without_facts', 0
UNION ALL SELECT 'missing_companyfacts_files', count(*) FROM customer WHERE c_custkey % 50 <> 0 AND lpad(CAST(c_custkey AS VARCHAR), 10, '0') NOT IN (SELECT cik10 FROM docs)
UNION ALL SELECT coalesce(reject_reason, 'candidate_facts'), count(*) FROM judged GROUP BY 1
UNION ALL SELECT 'derived_' || variable, count(*) FROM made m WHERE variable <> 'operating_costs' GROUP BY variable
UNION ALL SELECT 'derived_operating_costs' || CASE WHEN b.cik10 IS NULL THEN '' ELSE '_replaced' END, count(*) FROM costs c LEFT JOIN (SELECT * FROM best WHERE variable = 'operating_costs') b USING (cik10, company_year) GROUP BY 1
UNION ALL SELECT 'derived_assets_rejected', 0 UNION ALL SELECT 'derived_liabilities_rejected', count(*) FROM best t JOIN best e USING (cik10, company_year) WHERE t.variable = 'liabilities_and_equity' AND e.variable = 'equity' AND CAST(t.val AS DOUBLE) < CAST(e.val AS DOUBLE)
UNION ALL SELECT 'derived_operating_costs_rejected', count(*) FROM best t JOIN best e USING (cik10, company_year) WHERE t.variable = 'revenues' AND e.variable = 'ebit' AND CAST(t.val AS DOUBLE) < CAST(e.val AS DOUBLE)""")
def panel_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run that aren't zero, and those of odd files and rejected derivations."""
    result = line_panel(spark, sf_dir)
    stats = checkpoint(result.stats)
    result.release()
    long = stats.select(*[F.col(c).cast("long").alias(c) for c in stats.columns]).unpivot([], stats.columns, "metric", "value")
    return long.where("value > 0 or metric in ('files_without_facts', 'missing_companyfacts_files') or metric like 'derived%rejected'")


@query(f"WITH {PANEL_SQL} SELECT cik10, company_year, variable, number, accn, filed, {', '.join(f'CAST({r} AS INTEGER) AS {r}' for r in select.RANKS)} FROM full_panel WHERE tier = 'derived'")
def derived_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived values with the worst ranks and the provenance of their sources."""
    mapped = select.map_to_rules(line_facts(spark, sf_dir), rules_frame(spark, RULES), len(RULES))
    best = select.best_candidates(select.judge(mapped, SCOPE), met=["start"]).withColumn("number", C.number("val"))
    kept = best.select("cik10", "company_year", "variable", "val", "number", "namespace", "tag", "tier", "tag_priority", "accn", "filed", *select.RANKS)
    full = derive.with_derived(kept, derive.outcomes(derive.side_by_side(kept)))
    return full.where("tier = 'derived'").select("cik10", "company_year", "variable", "number", "accn", "filed", *[F.col(r).cast("int").alias(r) for r in select.RANKS])


# ---------------------------------------------------------------- landed lists

@query("""SELECT row_number() OVER (ORDER BY n_name) AS place, n_name AS ticker, CAST(n_nationkey AS BIGINT) AS cik, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik10, 'Company ' || n_nationkey AS name, 'then' AS downloaded_at FROM nation""")
def ticker_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed ticker list, in which every pair comes twice, as a table in its order."""
    n = table(spark, sf_dir, "nation")
    twice = n.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    entry = F.struct((F.col("n_nationkey") + 100 * F.col("again")).alias("at"), F.struct(F.col("n_nationkey").alias("cik_str"), F.concat(F.lit(" "), F.lower("n_name")).alias("ticker"), F.concat(F.when(F.col("again") == 1, "Other ").otherwise("Company "), F.col("n_nationkey").cast("string")).alias("title")).alias("v"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["at"].cast("string").alias("k"), x["v"].alias("v")))
    landed = twice.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias("text"))  # a list of fixed size
    return placed(tables.ticker_map(landed, "then"))


@query("""SELECT row_number() OVER (ORDER BY cik10) AS place, * FROM (SELECT CAST(n_regionkey AS BIGINT) AS cik, lpad(CAST(n_regionkey AS VARCHAR), 10, '0') AS cik10, min(n_name) AS name FROM nation GROUP BY 1, 2)""")
def unique_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ticker's row of each company."""
    tickers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), F.col("n_regionkey").cast("long").alias("cik"), C.zero_pad("n_regionkey", 10).alias("cik10"), F.col("n_name").alias("name"))
    return placed(tables.unique_companies(tickers))


@query("""WITH s AS (SELECT *, s_suppkey % 10 AS d, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS k FROM supplier), t AS (SELECT *, d NOT IN (3, 4, 5, 6) AS ok FROM s)
SELECT s_suppkey AS cik, k AS cik10, s_name AS name_from_ticker_map, CASE WHEN ok THEN upper(s_name) ELSE '' END AS name_from_sec, CASE WHEN ok THEN 'operating' ELSE '' END AS entity_type,
  CASE WHEN ok THEN CAST(1000 + s_nationkey AS VARCHAR) ELSE '' END AS sic, CASE WHEN ok THEN 'Made "here", and there' ELSE '' END AS sic_description, CASE WHEN ok THEN '1231' ELSE '' END AS fiscal_year_end,
  CASE WHEN ok AND d <> 7 THEN 'S' || s_suppkey || ';T' ELSE '' END AS tickers, CASE WHEN ok THEN 'X' ELSE '' END AS exchanges, CASE WHEN d = 3 THEN NULL ELSE 'u' || s_suppkey END AS source_url,
  CASE WHEN ok THEN 'success' ELSE 'error' END AS download_status, 'then' AS downloaded_at,
  CASE WHEN ok THEN '' WHEN d = 3 THEN 'no document landed' WHEN d = 6 THEN repeat('error ', 83) || 'er' ELSE 'document can''t be parsed' END AS error_message FROM t""")
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed company documents as a table: some are missing, broken, of another kind, or an error."""
    s = table(spark, sf_dir, "supplier").withColumns({"cik10": C.zero_pad("s_suppkey", 10), "d": F.col("s_suppkey") % 10})
    fields = {"name": F.upper("s_name"), "entityType": F.lit("operating"), "sic": (1000 + F.col("s_nationkey")).cast("string"), "sicDescription": F.lit('Made "here", and there'), "fiscalYearEnd": F.lit("1231")}
    tickers = F.when(F.col("d") != 7, F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.lit("T")))
    good = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], tickers.alias("tickers"), F.array(F.lit("X")).alias("exchanges")))
    text = F.when(F.col("d") == 4, '{"name": ').when(F.col("d") == 5, "[1]").when(F.col("d") != 6, good)
    error = F.when(F.col("d") == 6, F.repeat(F.lit("error "), 100))
    landed = s.where("d <> 3").select("cik10", text.alias("text"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("source_url"), F.lit("c").alias("cache_path"), error.alias("error_message"))
    wanted = s.select(F.col("s_suppkey").alias("cik"), "cik10", F.col("s_name").alias("name"))
    return tables.metadata(wanted, landed, "then").drop("cache_path")


@query("""WITH t AS (SELECT n_nationkey AS n, i, 'T' || i AS tag, CASE WHEN (n_nationkey + i) % 3 = 0 THEN NULL WHEN (n_nationkey + i) % 5 = 0 THEN '' ELSE 'label ' || n_nationkey END AS label,
  CASE WHEN (n_nationkey + i) % 4 <> 0 THEN 'described ' || n_nationkey END AS description FROM nation, range(7) r(i))
SELECT row_number() OVER (ORDER BY tag) AS place, 'x' AS namespace, tag, coalesce(arg_min(label, n) FILTER (label <> ''), '') AS label, coalesce(arg_min(description, n) FILTER (description <> ''), '') AS description,
  'USD' AS units, string_agg(DISTINCT 'F' || n % 2, ';' ORDER BY 'F' || n % 2) AS forms, count(DISTINCT n) AS company_count, count(DISTINCT (n, 2000 + i)) AS company_year_count, count(*) AS fact_count FROM t GROUP BY tag""")
def inventory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with labels and descriptions, in its order."""
    n = F.col("n_nationkey")
    tags = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    at = n + F.col("i")
    named = F.concat(F.lit("label "), n.cast("string"))
    fact = F.struct(F.lit(1).alias("val"), (2000 + F.col("i")).alias("fy"), F.concat(F.lit("F"), (n % 2).cast("string")).alias("form"))
    payload = F.struct(F.when(at % 3 == 0, None).when(at % 5 == 0, "").otherwise(named).alias("label"), F.when(at % 4 != 0, F.concat(F.lit("described "), n.cast("string"))).alias("description"), F.struct(F.array(fact).alias("USD")).alias("units"))
    by_company = tags.groupBy("n_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("T"), F.col("i").cast("string")), payload))).alias("x"))
    docs = by_company.select(F.concat(F.lit("CIK"), C.zero_pad("n_nationkey", 10), F.lit(".json")).alias("source_file"), F.to_json(F.struct(F.col("n_nationkey").alias("cik"), F.struct("x").alias("facts"))).alias("text"))
    return placed(inventory.tag_inventory(facts.open_documents(docs)))


# ---------------------------------------------------------------- configuration, files, orders

@query("""SELECT * FROM (VALUES
  ('assets', 1, 1, 'Assets', 'Assets'),
  ('liabilities', 1, 1, 'Liabilities', 'Liabilities'),
  ('liabilities_and_equity', 1, 1, 'LiabilitiesAndStockholdersEquity', 'LiabilitiesAndStockholdersEquity'),
  ('current_assets', 1, 1, 'AssetsCurrent', 'AssetsCurrent'),
  ('current_liabilities', 1, 1, 'LiabilitiesCurrent', 'LiabilitiesCurrent'),
  ('revenues', 3, 6, 'Revenues', 'RevenueFromContractWithCustomerIncludingAssessedTax'),
  ('net_income', 2, 2, 'NetIncomeLoss', 'ProfitLoss'),
  ('equity', 2, 2, 'StockholdersEquity', 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest'),
  ('cash', 2, 3, 'CashAndCashEquivalentsAtCarryingValue', 'Cash'),
  ('accounts_receivable', 2, 4, 'AccountsReceivableNetCurrent', 'AccountsAndOtherReceivablesNetCurrent'),
  ('inventory', 1, 1, 'InventoryNet', 'InventoryNet'),
  ('cost_of_revenue', 2, 3, 'CostOfGoodsAndServicesSold', 'CostOfGoodsSold'),
  ('operating_costs', 1, 1, 'CostsAndExpenses', 'CostsAndExpenses'),
  ('ppe', 2, 2, 'PropertyPlantAndEquipmentNet', 'PropertyPlantAndEquipmentGross'),
  ('intangible_assets', 2, 3, 'IntangibleAssetsNetExcludingGoodwill', 'IntangibleAssetsNetIncludingGoodwill'),
  ('goodwill', 1, 1, 'Goodwill', 'Goodwill'),
  ('depreciation_amortization', 2, 2, 'DepreciationDepletionAndAmortization', 'DepreciationAndAmortization'),
  ('long_term_investments', 1, 1, 'LongTermInvestments', 'LongTermInvestments'),
  ('long_term_debt', 3, 5, 'LongTermDebtNoncurrent', 'OtherLongTermDebtNoncurrent'),
  ('short_term_debt', 3, 6, 'DebtCurrent', 'LongTermDebtAndCapitalLeaseObligationsCurrent'),
  ('ebit', 1, 1, 'OperatingIncomeLoss', 'OperatingIncomeLoss'),
  ('interest_expense', 2, 3, 'InterestExpense', 'InterestAndDebtExpense'),
  ('capex', 2, 2, 'PaymentsToAcquirePropertyPlantAndEquipment', 'PaymentsToAcquireProductiveAssets'),
  ('retained_earnings', 2, 2, 'RetainedEarningsAccumulatedDeficit', 'RetainedEarningsUnappropriated'),
  ('operating_cash_flow', 2, 2, 'NetCashProvidedByUsedInOperatingActivities', 'NetCashProvidedByUsedInOperatingActivitiesContinuingOperations'),
  ('investing_cash_flow', 2, 2, 'NetCashProvidedByUsedInInvestingActivities', 'NetCashProvidedByUsedInInvestingActivitiesContinuingOperations'),
  ('financing_cash_flow', 2, 2, 'NetCashProvidedByUsedInFinancingActivities', 'NetCashProvidedByUsedInFinancingActivitiesContinuingOperations')) c(variable, tiers, tags, first_tag, last_tag)""")
def configured_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured rules by variable; priorities run through a variable's tiers."""
    rules = rules_frame(spark, config.read_rules())
    by = rules.groupBy("variable").agg(F.count_distinct("tier").cast("int").alias("tiers"), F.max("tag_priority").alias("tags"), F.min_by("tag", "tag_priority").alias("first_tag"), F.max_by("tag", "tag_priority").alias("last_tag"))
    return by


@query("SELECT '10-K' AS forms, 2011 AS start_year, 2025 AS end_year, 1 AS horizon_years, 2024 AS max_split_year")
def configured_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = config.read_scope()
    return spark.createDataFrame([(";".join(s.forms), s.start_year, s.end_year, s.horizon_years, s.max_split_year)], "forms string, start_year int, end_year int, horizon_years int, max_split_year int")


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik10, CASE c_custkey % 7 WHEN 1 THEN 'a "quoted", text' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 5 THEN c_name WHEN 6 THEN '007' END AS text FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as CSV and read again: blanks and the texts that mean missing become null, zeros in front stay."""
    k = F.col("c_custkey") % 7
    text = F.when(k == 0, "NA").when(k == 1, 'a "quoted", text').when(k == 2, "two\nlines").when(k == 3, "").when(k == 4, None).when(k == 5, F.col("c_name")).otherwise("007")
    path = f"{use_shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(table(spark, sf_dir, "customer").select(C.zero_pad("c_custkey", 10).alias("cik10"), text.alias("text"), F.lit("x").alias("more")), path)
    return tables.read_csv(spark, path, ["cik10", "text"], compat_missing=True)


_COMPARED = ["assets", "liabilities", "cash"]


@query(f"""WITH {WIDE_SQL}, w AS (SELECT * FROM wide WHERE CAST(cik10 AS BIGINT) % 9 <> 4), l AS (SELECT cik10, company_year, variable, CASE WHEN CAST(company_year AS INTEGER) % 3 = 0 THEN value + 1 ELSE value END AS value
  FROM ({_long_sql(_COMPARED)}) WHERE CAST(cik10 AS BIGINT) % 11 <> 5 AND NOT (variable = 'cash' AND CAST(company_year AS INTEGER) % 4 = 1)),
m AS ({_long_sql(_COMPARED, "w")})
SELECT cik10, company_year, 'missing_from_long' AS finding, NULL AS variable, NULL::DOUBLE AS wide_value, NULL::DOUBLE AS long_value FROM (SELECT cik10, company_year FROM w EXCEPT SELECT cik10, company_year FROM l) a
UNION ALL SELECT cik10, company_year, 'missing_from_wide', NULL, NULL, NULL FROM (SELECT cik10, company_year FROM l EXCEPT SELECT cik10, company_year FROM w) b
UNION ALL SELECT m.cik10, m.company_year, 'differs', variable, m.value, l.value FROM m LEFT JOIN l USING (cik10, company_year, variable) WHERE l.value IS NULL OR abs(m.value - l.value) > 0.5""")
def panel_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide and the long panel of orders, stored by company and year, and all that they differ in."""
    wide, number = orders_wide(spark, sf_dir), F.col("cik10").cast("long")
    year = F.col("company_year").cast("int")
    long = panel.long(wide, _COMPARED).where((number % 11 != 5) & ~((F.col("variable") == "cash") & (year % 4 == 1)))
    long = long.withColumn("value", F.col("value") + F.when(year % 3 == 0, 1).otherwise(0))
    run, buckets = uuid.uuid4().hex, int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = [tables.write_bucketed(df, f"{name}_{run}", panel.KEYS, buckets, f"{use_shared_folder(spark)}/{name}-{run}") for name, df in (("wide", wide.where(number % 9 != 4)), ("long", long))]
    return panel.compare(*stored, _COMPARED, tolerance=0.5)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
  CASE WHEN o_orderkey % 5 < 2 THEN year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) ELSE 0 END AS number, lpad(CAST(o_orderkey % 1300 AS VARCHAR), 4, '0') AS year_end FROM orders""")
def odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that parse or not, as dates and as numbers; ends of fiscal years with zeros in front."""
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, day).when(k == 1, F.concat(F.lit(" "), day, F.lit("\t"))).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 3, F.concat(F.substring(day, 1, 4), F.lit("-02-30")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", C.iso_date("t").cast("string").alias("parsed"), C.date_number("t").alias("number"), C.zero_pad((F.col("o_orderkey") % 1300).cast("string"), 4).alias("year_end"))


@query(f"WITH {CLASSIFIED_SQL} SELECT row_number() OVER (ORDER BY exclude_reason, research_sector, company_name, cik10) AS place, cik10, exclude_reason FROM classified WHERE NOT included")
def excluded_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(classify.excluded(part_companies(spark, sf_dir))).select("place", "cik10", "exclude_reason")


@query(f"""WITH {checks.NUMBERED_SQL}, s AS (SELECT severity, check_name, count(*) AS warning_count FROM n GROUP BY 1, 2)
SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, warning_count DESC, check_name) AS place, * FROM s) WHERE place <= 10""")
def summary_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of the summary of warnings, which a run shows."""
    return placed(quality.summary(checks.odd_warnings(spark, sf_dir)).orderBy(*quality.summary_order()).limit(10)).select("place", "severity", "check_name", "warning_count")


@query(f"WITH {FACTS_SQL} SELECT cik10, string_agg(DISTINCT form, ';' ORDER BY form) AS forms, count(DISTINCT accn) AS filings FROM facts GROUP BY cik10")
def filings_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_facts(spark, sf_dir).groupBy("cik10").agg(C.distinct_join("form").alias("forms"), F.count_distinct("accn").alias("filings"))
