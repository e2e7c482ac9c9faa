"""The catalogue of data-quality checks over the wide and the long panel.

``all_warnings`` runs the whole catalogue in one pass: both panels are dealt out by company, a row is
made of each company-year with what either panel has of it, and the checks of its rows, of its groups and
between the panels stand side by side in arrays of that row.  Each panel is scanned and shuffled once.
What a company-year has is held together in a row: a few facts for each variable.  The other functions
run one part of the catalogue alone.  A condition that is null doesn't hold.  Checks whose columns a table
lacks are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources import schemas
from ..sources.config import Rule, Scope, rules_frame
from . import derive, panel
from .numbering import checkpoint, numbered
from .select import BROADCAST_RULES, MAX_FILING_YEAR_LEAD, MAX_LAG_DAYS, UNITS

# Thresholds and lists of the published checks.
MIN_YEARS, MIN_COVERAGE = 5, 0.5
LIABILITIES_TO_ASSETS, NEGATIVE_EQUITY_GAP = 1.5, 0.1
COMPONENT_TO_TOTAL, BALANCE_GAP, TOTALS_GAP = 1.05, 0.5, 0.05
RESULT_TO_REVENUES, RESULT_TO_ASSETS = 2.0, 1.5
FORMULA_GAP, WIDE_LONG_GAP = 1e-6, 1e-6
SPARSE = 3
CORE = ["assets", "liabilities", "revenues", "net_income", "equity", "operating_cash_flow"]
SOURCE = ["assets", "liabilities", "liabilities_and_equity", "equity", "revenues", "net_income"]
COMPONENTS = [("current_assets", "assets"), ("current_liabilities", "liabilities"), ("cash", "assets"), ("accounts_receivable", "assets"), ("inventory", "assets"), ("ppe", "assets"), ("goodwill", "assets")]
NEGATIVES = [("assets", "high"), ("liabilities_and_equity", "high"), ("liabilities", "medium"), ("cash", "medium"), ("inventory", "medium"), ("ppe", "medium")]
SEVERITIES = ["high", "medium", "low"]

CONTEXT = ["research_universe_id", "cik", "cik10", "company_name", "primary_ticker", "research_sector", "company_year"]
NUMBERS = ["value_number", "reference_number"]
BODY = ["severity", "check_name", "scope", "variable", "value", "reference_variable", "reference_value", "details"]


@dataclass(frozen=True)
class Check:
    """A condition on a row, and what the warning says: the value and what it was held against.

    With ``numbers`` both are doubles, which get six digits once the condition has held.
    """

    name: str
    severity: str
    condition: Column
    variable: Column | str
    value: Column
    reference: str = ""
    reference_value: Column | None = None
    details: Column | str = ""
    numbers: bool = False

    def body(self, scope: str = "company_year") -> Column:
        def text(x: Column | str) -> Column:
            return F.lit(x) if isinstance(x, str) else C.text(x)

        values = [self.value, F.lit(None) if self.reference_value is None else self.reference_value]
        texts = [F.lit(None).cast("string") if self.numbers else C.text(v) for v in values]
        numbers = [v.cast("double") if self.numbers else F.lit(None).cast("double") for v in values]
        parts = [F.lit(self.severity), F.lit(self.name), F.lit(scope), text(self.variable), texts[0], F.lit(self.reference), texts[1], text(self.details), *numbers]
        return F.when(C.is_true(self.condition), F.struct(*[p.alias(n) for n, p in zip(BODY + NUMBERS, parts, strict=True)]))


def _context(df: DataFrame) -> list[Column]:
    return [(C.text(c) if c in df.columns else F.lit("")).alias(c) for c in CONTEXT]


def run_checks(df: DataFrame, checks: Sequence[Check], extra: Sequence[Column] = (), scope: str = "company_year") -> DataFrame:
    """Warnings of all checks over a table, in one scan.  ``extra`` are arrays of further bodies."""
    bodies = F.array_compact(F.array(*[c.body(scope) for c in checks])) if checks else None
    parts = [*([bodies] if bodies is not None else []), *extra]
    rows = df.select(*_context(df), F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("w"))
    return _shown(rows.select(*CONTEXT, "w.*"))


def _shown(rows: DataFrame) -> DataFrame:
    """Warnings with their numbers as texts."""
    shown = C.with_six_digits(rows, {n: F.col(n) for n in NUMBERS})
    named = {"value": F.coalesce("value", NUMBERS[0]), "reference_value": F.coalesce("reference_value", NUMBERS[1])}
    return shown.select(*CONTEXT, *[named.get(c, F.col(c)).alias(c) for c in BODY])


def dataset_warning(df: DataFrame, name: str, severity: str, condition: Column, value: Column | None = None, reference: str = "", reference_value: Column | None = None, details: Column | str = "") -> DataFrame:
    """A warning without company, from a table of one row."""
    check = Check(name, severity, condition, "", F.lit("") if value is None else value, reference, reference_value, details)
    return df.select(*[F.lit("").alias(c) for c in CONTEXT], F.explode(F.array_compact(F.array(check.body("dataset")))).alias("w")).select(*CONTEXT, *[f"w.{c}" for c in BODY])


def prepare_wide(wide: DataFrame) -> DataFrame:
    """Typed values: text columns of variables become numbers, with ``invalid`` naming what didn't parse."""
    schemas.require_columns(wide, [*schemas.COMPANY, "company_year"], "wide panel")
    present = [v for v in schemas.VARIABLES if v in wide.columns]
    texts = [v for v in present if dict(wide.dtypes)[v] == "string"]
    odd = F.array(*[F.when(C.invalid_number(v), F.struct(F.lit(v).alias("variable"), F.col(v).alias("raw"))) for v in texts])
    invalid = F.array_compact(odd) if texts else F.array().cast("array<struct<variable:string,raw:string>>")
    typed = {v: C.number(v) if v in texts else F.col(v).cast("double") for v in present}
    return wide.withColumn("invalid", invalid).withColumns(typed).withColumn("year", C.number("company_year"))


def wide_checks(wide: DataFrame, scope: Scope, this_year: int | Column) -> list[Check]:
    """The checks of one row of the wide panel, for the columns that it has."""
    has = set(wide.columns)
    year, at = F.col("year"), F.col("company_year")
    out = [
        Check("wide_duplicate_company_year", "high", F.col("__copies") > 1, "company_year", at, details="more than one row for the company and year"),
        Check("company_year_not_numeric", "high", (C.strip(C.text(at)) != "") & year.isNull(), "company_year", at, details="the year isn't a number"),
    ]
    outside = F.lit(False)
    if scope.start_year is not None:
        outside = outside | C.is_true(year < scope.start_year)
    if scope.end_year is not None:
        outside = outside | C.is_true(year > scope.end_year)
    out.append(Check("company_year_outside_configured_dataset_range", "low", outside, "company_year", at, details="the year is outside the configured range; nothing is dropped here"))
    this_year = F.lit(this_year) if isinstance(this_year, int) else this_year
    out.append(Check("company_year_in_future", "high", year > this_year, "company_year", at, details="the year hasn't begun yet"))

    def add(name: str, severity: str, needs: Sequence[str], condition, variable: str, reference: str = "", details: str = "") -> None:
        if set(needs) <= has:
            ref = F.col(reference) if reference else None
            out.append(Check(name, severity, condition(*[F.col(n) for n in needs]), variable, F.col(variable), reference, ref, details, numbers=True))

    for variable, severity in NEGATIVES:
        add(f"{variable}_negative", severity, [variable], lambda v: v < 0, variable, details=f"{variable} is below zero")
    add(
        "assets_differs_from_liabilities_and_equity", "medium", ["assets", "liabilities_and_equity"],
        lambda a, t: C.differs(a, t, TOTALS_GAP), "assets", "liabilities_and_equity", "both name the balance-sheet total and should agree",
    )
    if {"assets", "liabilities"} <= has:
        a, b = F.col("assets"), F.col("liabilities")
        explained = F.lit(False)
        if "equity" in has:
            e = F.col("equity")
            explained = C.is_true((e < 0) & (a > 0) & (F.abs(a - b - e) <= F.abs(a) * NEGATIVE_EQUITY_GAP))
        condition = (a > 0) & (b > a * LIABILITIES_TO_ASSETS) & ~explained
        out.append(Check("liabilities_absurdly_above_assets", "high", condition, "liabilities", b, "assets", a, f"above {LIABILITIES_TO_ASSETS} times assets, and negative equity doesn't explain it", numbers=True))
    for part, total in COMPONENTS:
        add(f"{part}_above_{total}", "medium", [part, total], lambda p, t: (t > 0) & (p > t * COMPONENT_TO_TOTAL), part, total, f"above {COMPONENT_TO_TOTAL} times {total}")
    if {"assets", "liabilities", "equity"} <= has:
        a, b, e = F.col("assets"), F.col("liabilities"), F.col("equity")
        gap = (F.abs(a) > 0) & (F.abs(a - b - e) > F.abs(a) * BALANCE_GAP)
        out.append(Check("large_assets_liabilities_equity_gap", "low", gap, "assets", a, "liabilities", b, "assets are far from liabilities and equity; equity may be defined otherwise", numbers=True))
    add("revenues_negative", "medium", ["revenues"], lambda v: v < 0, "revenues", details="revenues are below zero")
    for base, most in (("revenues", RESULT_TO_REVENUES), ("assets", RESULT_TO_ASSETS)):
        add(
            f"net_loss_abs_large_relative_to_{base}", "medium", ["net_income", base],
            lambda n, b, most=most: (n < 0) & (F.abs(b) > 0) & (F.try_divide(F.abs(n), F.abs(b)) > most), "net_income", base, f"the loss is above {most} times {base}",
        )
        add(
            f"net_profit_large_relative_to_{base}", "medium", ["net_income", base],
            lambda n, b, most=most: (n > 0) & (F.abs(b) > 0) & (F.try_divide(n, F.abs(b)) > most), "net_income", base, f"the profit is above {most} times {base}",
        )
    add("cost_of_revenue_negative", "low", ["cost_of_revenue"], lambda v: v < 0, "cost_of_revenue", details="cost of revenue is below zero")
    add("operating_costs_negative", "low", ["operating_costs"], lambda v: v < 0, "operating_costs", details="operating costs are below zero")
    add(
        "cost_of_revenue_above_operating_costs", "medium", ["cost_of_revenue", "operating_costs"],
        lambda c, o: (o > 0) & (c > o * COMPONENT_TO_TOTAL), "cost_of_revenue", "operating_costs", f"above {COMPONENT_TO_TOTAL} times operating costs",
    )
    add("capex_negative", "medium", ["capex"], lambda v: v < 0, "capex", details="payments should not be below zero")
    present = [v for v in schemas.VARIABLES if v in has]
    filled = reduce(lambda x, y: x + y, [F.col(v).isNotNull().cast("int") for v in present], F.lit(0))
    out.append(Check("sparse_company_year", "low", filled <= SPARSE, "", filled, "configured_variables", F.lit(len(present)), F.concat(filled.cast("string"), F.lit(" variables have a value"))))
    return out


def with_copies(wide: DataFrame) -> DataFrame:
    """How often a row's company and year come up."""
    return wide.withColumn("__copies", F.count("*").over(Window.partitionBy("cik10", "company_year")))


def wide_warnings(wide: DataFrame, scope: Scope, this_year: int | Column) -> DataFrame:
    """Warnings of single rows of a prepared wide panel."""
    counted = with_copies(wide)
    return run_checks(counted, wide_checks(wide, scope, this_year), [_odd_values(F.col("invalid"))])


def missing_columns_warning(wide: DataFrame) -> DataFrame:
    missing = [v for v in schemas.VARIABLES if v not in wide.columns]
    one = wide.sparkSession.range(1)
    return dataset_warning(one, "financial_variables_missing_from_wide", "high", F.lit(bool(missing)), F.lit(len(missing)), "expected_financial_variables", F.lit(len(schemas.VARIABLES)), "missing: " + ";".join(missing))


def coverage_warnings(wide: DataFrame) -> DataFrame:
    """Companies with five years or more that lack a core variable in most of them."""
    core = [v for v in CORE if v in wide.columns]
    first = F.min_by(F.struct(*_context(wide)), F.struct(C.text("company_year"), C.text("research_universe_id"))).alias("first")
    counted = wide.groupBy("cik10").agg(first, F.count("*").alias("years"), *[F.count(v).alias(f"n_{v}") for v in core]).where(F.col("years") >= MIN_YEARS)
    return run_checks(counted.select("first.*", "years", *[f"n_{v}" for v in core]), coverage_checks(core), scope="company")


def coverage_checks(core: Sequence[str]) -> list[Check]:
    """Checks of a company, from the number of its ``years`` and of those with a value (n_ and the variable)."""
    checks = []
    for v in core:
        n, years = F.col(f"n_{v}"), F.col("years")
        said = F.concat(F.lit(f"{v} in "), n.cast("string"), F.lit(" of "), years.cast("string"), F.lit(" years ("), F.format_string("%.1f", 100 * n / years), F.lit("%)"))
        checks.append(Check(f"{v}_missing_for_majority_of_years", "medium", (years >= MIN_YEARS) & (n / years < MIN_COVERAGE), v, n, "company_year_count", years, said))
    return checks


def with_periods(long: DataFrame) -> DataFrame:
    """``long`` with the days, lag and years that its checks ask for, each text parsed once."""
    dated = long.withColumns({"__start": C.iso_date("start"), "__end": C.iso_date("end"), "__filed": C.iso_date("filed")})
    counted = dated.withColumns(
        {
            "__days": F.datediff("__end", "__start") + 1,
            "__lag": F.datediff("__filed", "__end"),
            "__ahead": F.year("__filed") - C.integer("company_year"),
            "__fp": F.upper(C.text("fp")),
        }
    )
    return counted.withColumn("__annual", C.between("__days", *C.ANNUAL_DAYS)).drop("__start", "__end", "__filed")


def long_checks(with_rules: bool) -> list[Check]:
    """The checks of one row ``with_periods`` of the long panel; ``__known`` says whether a rule has its variable and tag."""
    derived = F.col("namespace") == "derived"
    value, at = F.col("value").cast("string"), F.col("variable")
    days, lag, ahead, annual = F.col("__days"), F.col("__lag"), F.col("__ahead"), F.col("__annual")
    flow = F.col("variable").isin(schemas.FLOWS)
    late_fp = F.col("__fp").isin("Q1", "Q2", "Q3") & ~C.is_annual_frame("frame") & ~annual
    origin = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), C.text(c)) for c in ("fp", "form", "start", "end", "accn")])
    d0, d1 = C.ANNUAL_DAYS
    checks = [
        Check("derived_source_metadata_invalid", "high", C.is_true(F.col("tier") == "derived") != C.is_true(derived), at, F.col("namespace"), "tier", F.col("tier"), "namespace and tier must both say derived or neither"),
        Check("source_unit_outside_accepted_units", "high", ~C.is_true(derived) & ~F.upper(C.strip(C.text("unit"))).isin(*UNITS), at, F.col("unit"), "accepted_units", F.lit(";".join(UNITS)), "the unit isn't accepted"),
        Check("source_filing_before_period_end", "high", ~C.is_true(derived) & (lag < 0), at, F.col("filed"), "end", F.col("end"), "filed before the period's end"),
        Check("source_filing_lag_too_long", "high", ~C.is_true(derived) & (lag > MAX_LAG_DAYS), at, F.col("filed"), "filing_lag_days", lag, f"filed more than {MAX_LAG_DAYS} days after the period's end"),
        Check("source_filing_year_after_company_year_window", "high", ~C.is_true(derived) & (ahead > MAX_FILING_YEAR_LEAD), at, F.col("filed"), "company_year", F.col("company_year"), f"filed more than {MAX_FILING_YEAR_LEAD} year after the company year"),
        Check("flow_period_not_annual", "high", flow & ~annual, at, value, "period_days", days, f"the period isn't {d0} to {d1} days long"),
        Check("flow_source_fp_not_fy", "low", flow & annual & (F.col("__fp") != "FY"), at, value, "fp", F.col("fp"), "an annual period whose fiscal period isn't FY"),
        Check("revenues_may_be_quarterly", "high", (F.col("variable") == "revenues") & ((days.isNotNull() & ~annual) | late_fp), "revenues", value, "period_days", days, origin),
    ]
    if with_rules:
        named = F.concat_ws(":", "namespace", "tag")
        checks.append(Check("source_tag_not_in_sec_tags_config", "high", ~C.is_true(derived) & F.col("__known").isNull(), at, named, "sec_tags_config", F.lit("tag rules"), "no rule has this variable, namespace and tag"))
    return checks


def with_rules_known(long: DataFrame, rules: DataFrame | None, n_rules: int) -> DataFrame:
    """``long`` with ``__known``: true where a rule has the row's variable, namespace and tag."""
    if rules is None:
        return long
    keys = ["variable", "namespace", "tag"]
    known = rules.select(*keys).distinct().withColumn("__known", F.lit(True))
    return long.join(F.broadcast(known) if n_rules <= BROADCAST_RULES else known, keys, "left")


def long_rows(long: DataFrame, scope: Scope, rules: DataFrame | None, n_rules: int = 0) -> DataFrame:
    """Warnings of single rows of the long panel."""
    return run_checks(with_periods(with_rules_known(long, rules, n_rules)), long_checks(rules is not None))


def form_check(scope: Scope) -> Check:
    """The check of a company-year's facts whose forms are foreign: their ``variables``, ``forms`` and number ``n``."""
    return Check("source_form_outside_dataset_config", "high", F.col("n") > 0, F.col("variables"), F.col("n"), "accepted_forms", F.lit(";".join(scope.forms)), F.concat(F.lit("forms outside the configuration: "), "forms"))


def is_foreign(form: Column, scope: Scope) -> Column:
    return ~F.upper(C.strip(C.text(form))).isin(*scope.forms)


def source_checks() -> list[Check]:
    """The checks of a company-year's core facts, from the columns that ``source_columns`` makes."""
    return [
        Check("source_fy_differs_from_company_year", "medium", F.col("others") > 0, F.col("other_variables"), F.col("other_years"), "company_year", F.col("company_year"), "the source's fiscal year isn't the company year"),
        Check("mixed_source_fiscal_years", "medium", F.col("n_fy") > 1, F.col("core_variables"), F.col("all_fy"), details="core variables come from several fiscal years"),
        Check("mixed_source_accessions", "low", F.col("n_accn") > 1, F.col("core_variables"), F.col("n_accn"), details="core variables come from several filings"),
        Check("mixed_source_period_ends", "medium", F.col("n_end") > 1, F.col("core_variables"), F.col("all_end"), details="core variables have several period ends"),
    ]


def source_columns(get) -> list[Column]:
    """Aggregates over core facts for ``source_checks``; ``get`` gives a fact's column, null for other rows."""
    other = C.is_true(C.number(get("fy")) != C.number(get("company_year")))
    return [
        C.distinct_join(get("variable")).alias("core_variables"),
        C.distinct_join(F.when(other, get("variable"))).alias("other_variables"),
        C.distinct_join(F.when(other, get("fy"))).alias("other_years"),
        F.count_if(other).alias("others"),
        *[F.size(F.collect_set(F.nullif(get(c).cast("string"), F.lit("")))).cast("long").alias(f"n_{c}") for c in ("fy", "accn", "end")],
        *[C.distinct_join(get(c)).alias(f"all_{c}") for c in ("fy", "end")],
    ]


def long_groups(long: DataFrame, scope: Scope) -> DataFrame:
    """Warnings of company-years of the long panel: forms, and sources that don't agree."""
    keys = ["cik10", "company_year"]
    any_row = F.min(F.struct(*_context(long))).alias("first")
    foreign = long.where(is_foreign(F.col("form"), scope))
    forms = foreign.groupBy(*keys).agg(any_row, C.distinct_join("variable").alias("variables"), F.count("*").alias("n"), C.distinct_join("form").alias("forms"))
    mixed = long.where(F.col("variable").isin(SOURCE)).groupBy(*keys).agg(any_row, *source_columns(F.col))
    rest = [c for c in mixed.columns if c not in keys + ["first"]]
    by_form = run_checks(forms.select("first.*", "variables", "n", "forms"), [form_check(scope)])
    return by_form.unionByName(run_checks(mixed.select("first.*", *rest), source_checks()))


def consistency_warnings(wide: DataFrame, long: DataFrame) -> DataFrame:
    """What the wide and the long panel differ in; the long one must hold rows."""
    keys = ["cik10", "company_year"]
    context = F.min(F.struct(*_context(long))).alias("first")
    copies = long.groupBy(*keys, "variable").agg(context, F.count("*").alias("n")).where("n > 1").select("first.*", "variable", "n")
    parts = [run_checks(copies, [copies_check(F.col("variable"), F.col("n"))])]
    for name, left, right in (("wide_company_year_missing_from_long", wide, long), ("long_company_year_missing_from_wide", long, wide)):
        n = panel.missing_keys(left, right).agg(F.count("*").alias("n"))
        parts.append(dataset_warning(n, name, "high", F.col("n") > 0, F.col("n"), details=LACKING))
    present = [v for v in schemas.VARIABLES if v in wide.columns]
    melted = panel.long(wide, present, value="wide_value")
    selected = long.select(*keys, "variable", C.number("value").alias("long_value"))
    off = panel.mismatches(melted, selected, keys=[*keys, "variable"], left_value="wide_value", right_value="long_value", tolerance=WIDE_LONG_GAP)
    return reduce(DataFrame.unionByName, parts, run_checks(off, [value_check(F.col("variable"), F.col("wide_value"), F.col("long_value"))]))


LACKING = "company-years of one panel that the other lacks"


def copies_check(variable: Column, n: Column) -> Check:
    return Check("long_duplicate_company_year_variable", "high", n > 1, variable, n, details="more than one selected fact for the key")


def value_check(variable: Column, wide_value: Column, long_value: Column) -> Check:
    return Check("wide_value_differs_from_long", "high", F.lit(True), variable, wide_value, "long_value", long_value, "the two panels don't hold the same value", numbers=True)


#: (variable, tag of its derived facts, sources, formula)
FORMULAS = [
    ("assets", derive.ASSETS_TAG, ["liabilities_and_equity"], lambda t: t),
    ("liabilities", derive.LIABILITIES_TAG, ["liabilities_and_equity", "equity"], lambda t, e: t - e),
    ("operating_costs", derive.COSTS_TAG, ["revenues", "ebit"], lambda r, e: r - e),
]


def formula_checks(columns: Sequence[str]) -> dict[str, Check]:
    """For each derived variable that the wide panel can check, the check of its value."""
    return {
        v: Check(f"derived_{v}_formula_mismatch", "high", C.differs(v, formula(*[F.col(s) for s in sources]), FORMULA_GAP), v, F.col(v), sources[0], F.col(sources[0]), "the derived value isn't what its sources give", numbers=True)
        for v, _, sources, formula in FORMULAS
        if {v, *sources} <= set(columns)
    }


def formula_warnings(wide: DataFrame, long: DataFrame) -> DataFrame | None:
    """Derived values that aren't what their formula gives from the wide panel."""
    keys = ["cik10", "company_year"]
    parts, checks = [], formula_checks(wide.columns)
    for variable, tag, sources, _ in FORMULAS:
        if variable not in checks:
            continue
        made = long.where((F.col("variable") == variable) & (F.col("namespace") == "derived") & (F.col("tag") == tag)).select(*keys).distinct()
        joined = made.join(wide.select(*schemas.COMPANY, "company_year", variable, *sources), keys, "left")
        parts.append(run_checks(joined, [checks[variable]]))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _with_context(bodies: Column, context: Column) -> Column:
    """Bodies as rows of a warning: each behind its context."""
    return F.transform(bodies, lambda b: F.struct(*[context[c].alias(c) for c in CONTEXT], *[b[c].alias(c) for c in BODY + NUMBERS]))


def _bodies(checks: Sequence[Check], where: Column | None = None, scope: str = "company_year") -> Column:
    found = [c.body(scope) for c in checks]
    return F.array_compact(F.array(*[f if where is None else F.when(where, f) for f in found]))


def _odd_values(invalid: Column) -> Column:
    """Bodies of texts that aren't numbers."""
    return F.transform(
        invalid,
        lambda x: F.struct(
            F.lit("high").alias("severity"), F.lit("non_numeric_financial_value").alias("check_name"), F.lit("company_year").alias("scope"), x["variable"].alias("variable"),
            C.text(x["raw"]).alias("value"), F.lit("").alias("reference_variable"), F.lit("").alias("reference_value"), F.lit("the value isn't a number").alias("details"),
            *[F.lit(None).cast("double").alias(n) for n in NUMBERS],
        ),
    )


def company_years(typed: DataFrame, long: DataFrame, scope: Scope, rules: DataFrame | None, n_rules: int) -> DataFrame:
    """A row for each company-year of either panel, with what its checks need of both.

    ``ws`` are its rows of the prepared wide panel, ``ls`` its facts (variable, value, context), ``rows``
    the warnings of single facts; the rest are aggregates.  The rows of both panels are dealt out by
    company together, which is enough for the groups by year and for the company's own counts.
    """
    present = [v for v in schemas.VARIABLES if v in typed.columns]
    context = F.struct(*_context(typed))
    left = typed.select("cik10", "company_year", F.struct(context.alias("context"), *present, "year", "invalid").alias("w"))
    known = with_periods(with_rules_known(long, rules, n_rules))
    found = _with_context(_bodies(long_checks(rules is not None)), F.struct(*_context(long)))
    facts = known.select(
        "cik10",
        "company_year",
        F.struct(F.struct(*_context(long)).alias("context"), F.col("company_year"), *[F.col(c) for c in ("variable", "namespace", "tag", "form", "fy", "accn", "end")], C.number("value").alias("value"), found.alias("found")).alias("l"),
    )
    both = left.unionByName(facts, allowMissingColumns=True).repartition("cik10")
    fact, is_fact, is_wide = F.col("l"), F.col("l").isNotNull(), F.col("w").isNotNull()
    foreign, source = is_fact & is_foreign(F.col("l.form"), scope), is_fact & fact["variable"].isin(SOURCE)
    made = {v: is_fact & (fact["variable"] == v) & (fact["namespace"] == "derived") & (fact["tag"] == tag) for v, tag, _, _ in FORMULAS}
    grouped = both.groupBy("cik10", "company_year").agg(
        F.collect_list("w").alias("ws"),
        F.collect_list(F.when(is_fact, F.struct(fact["variable"].alias("variable"), fact["value"].alias("value"), fact["context"].alias("context")))).alias("ls"),
        F.flatten(F.collect_list("l.found")).alias("rows"),
        F.min(F.when(foreign, fact["context"])).alias("foreign_context"),
        C.distinct_join(F.when(foreign, fact["variable"])).alias("variables"),
        F.count_if(foreign).alias("n"),
        C.distinct_join(F.when(foreign, fact["form"])).alias("forms"),
        F.min(F.when(source, fact["context"])).alias("source_context"),
        *source_columns(lambda c: F.when(source, fact[c])),
        *[F.coalesce(F.bool_or(m), F.lit(False)).alias(f"made_{v}") for v, m in made.items()],
        F.count("l").alias("n_facts"),
        F.count_if(is_fact & (fact["namespace"] != "derived")).alias("n_own"),
        F.count_if(is_fact & (fact["variable"] == "revenues")).alias("revenue_facts"),
        F.min(F.when(is_wide, F.struct(C.text("company_year").alias("at"), C.text("w.context.research_universe_id").alias("id"), F.col("w.context").alias("context")))).alias("own_first"),
        *[F.count(f"w.{v}").alias(f"own_{v}") for v in CORE if v in present],
    )
    company = Window.partitionBy("cik10")
    sums = {"years": F.sum(F.size("ws").cast("long")).over(company), "first": F.min("own_first").over(company)} | {f"n_{v}": F.sum(f"own_{v}").over(company) for v in CORE if v in present}
    place = F.row_number().over(company.orderBy(F.col("own_first").asc_nulls_last(), "company_year"))
    return grouped.withColumns(sums).withColumn("leads", place == 1)


def judged_years(years: DataFrame, present: Sequence[str], scope: Scope, this_year: int | Column) -> DataFrame:
    """``found``, the warnings of company-years, and what the checks of the whole dataset count.

    A year comes once for each of its rows of the wide panel, or once without any; its groups are
    judged with the first of them.
    """
    opened = years.select("*", F.posexplode_outer("ws").alias("place", "w"))
    rows = opened.select(*[c for c in opened.columns if c not in ("ws", "w")], F.col("w.context").alias("context"), *[F.col(f"w.{c}").alias(c) for c in (*present, "year", "invalid")], F.size("ws").alias("__copies"))
    is_wide = F.col("place").isNotNull()
    once = F.coalesce(F.col("place") == 0, F.lit(True))
    has_keys = F.col("cik10").isNotNull() & F.col("company_year").isNotNull()  # null keys have no partner
    none = F.filter("ls", lambda _: F.lit(False))
    facts = F.when(has_keys, F.col("ls")).otherwise(none)
    cells = F.map_from_arrays(F.array(*[F.lit(v) for v in present]), F.array(*[F.col(v) for v in present]))
    key = F.struct(*[(C.text(c) if c in ("cik10", "company_year") else F.lit("")).alias(c) for c in CONTEXT])
    off = F.filter("facts", lambda x: F.col("cells")[x["variable"]].isNotNull() & (x["value"].isNull() | (F.abs(F.col("cells")[x["variable"]] - x["value"]) > WIDE_LONG_GAP)))
    filled = F.array_compact(F.array(*[F.when(F.col(v).isNotNull(), F.lit(v)) for v in present]))
    alone = F.filter(filled, lambda v: ~F.array_contains(F.transform("facts", lambda x: x["variable"]), v))
    named = F.transform("ls", lambda x: x["variable"])
    several = F.when(F.size("named") > F.size(F.array_distinct("named")), F.filter(F.array_distinct("named"), lambda v: F.size(F.filter("named", lambda u: u.eqNullSafe(v))) > 1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"facts": facts, "cells": cells, "named": named}).withColumn("several", several)

    def of_variable(v: Column) -> Column:
        return F.filter("ls", lambda x: x["variable"].eqNullSafe(v))

    wide = _bodies([*wide_checks(rows, scope, this_year), *[Check(c.name, c.severity, c.condition & F.col(f"made_{v}") & has_keys, c.variable, c.value, c.reference, c.reference_value, c.details, c.numbers) for v, c in formula_checks(present).items()]], is_wide)
    parts = [
        F.when(once, F.col("rows")),
        _with_context(F.concat(wide, F.coalesce(_odd_values(F.col("invalid")), F.array_compact(F.array(F.lit(None).cast(_BODY_TYPE))))), F.col("context")),
        _with_context(_bodies(coverage_checks([v for v in CORE if v in present]), once & F.col("leads"), "company"), F.col("first.context")),
        _with_context(_bodies([form_check(scope)], once), F.col("foreign_context")),
        _with_context(_bodies(source_checks(), once), F.col("source_context")),
        F.when(once, F.flatten(F.transform("several", lambda v: _with_context(F.array(copies_check(v, F.size(of_variable(v)).cast("long")).body()), F.array_min(F.transform(of_variable(v), lambda x: x["context"])))))),
        F.when(is_wide, _with_context(F.transform(off, lambda x: value_check(x["variable"], F.col("cells")[x["variable"]], x["value"]).body()), key)),
        F.when(is_wide, _with_context(F.transform(alone, lambda v: value_check(v, F.col("cells")[v], F.lit(None).cast("double")).body()), key)),
    ]
    empty = F.filter("rows", lambda _: F.lit(False))
    counts = {
        "n_facts": F.when(once, F.col("n_facts")), "n_own": F.when(once, F.col("n_own")), "revenue_facts": F.when(once, F.col("revenue_facts")),
        "lacks_long": (once & is_wide & (~has_keys | (F.col("n_facts") == 0))).cast("long"), "lacks_wide": (once & (F.col("n_facts") > 0) & (~has_keys | ~is_wide)).cast("long"),
    }
    return rows.select(F.concat(*[F.coalesce(p, empty) for p in parts]).alias("found"), *[c.alias(n) for n, c in counts.items()])


_BODY_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in BODY] + [T.StructField(c, T.DoubleType()) for c in NUMBERS])


def dataset_counts(wide: DataFrame, long: DataFrame) -> DataFrame:
    """One row: what the checks of the whole dataset count, by company-years of either panel."""
    own, revenues = F.col("namespace") != "derived", F.col("variable") == "revenues"
    left = wide.select("cik10", "company_year", F.lit(True).alias("is_wide"), *[F.lit(False).alias(c) for c in ("own", "revenues")])
    right = long.select("cik10", "company_year", F.lit(False).alias("is_wide"), C.is_true(own).alias("own"), C.is_true(revenues).alias("revenues"))
    years = left.unionByName(right).groupBy("cik10", "company_year").agg(
        F.count_if("is_wide").alias("n_wide"), F.count_if(~F.col("is_wide")).alias("n_facts"), F.count_if("own").alias("n_own"), F.count_if("revenues").alias("revenue_facts")
    )
    has_keys = F.col("cik10").isNotNull() & F.col("company_year").isNotNull()  # null keys have no partner
    lacks = {"lacks_long": (F.col("n_wide") > 0) & (~has_keys | (F.col("n_facts") == 0)), "lacks_wide": (F.col("n_facts") > 0) & (~has_keys | (F.col("n_wide") == 0))}
    return years.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_facts", "n_own", "revenue_facts")], *[F.count_if(c).alias(n) for n, c in lacks.items()])


def dataset_warnings(wide: DataFrame, long: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The warnings of ``all_warnings`` that belong to no company; no row is checked for them, only counted."""
    schemas.require_columns(long, schemas.LONG, "long panel")
    schemas.require_columns(wide, [*schemas.COMPANY, "company_year"], "wide panel")
    return _dataset_warnings(wide, dataset_counts(wide, long).first(), bool(rules))  # one row


def _dataset_warnings(wide: DataFrame, n: Row, with_rules: bool) -> DataFrame:
    one = wide.sparkSession.range(1)

    def of_dataset(name: str, severity: str, holds: bool, value: int | None = None, details: str = "") -> DataFrame:
        return dataset_warning(one, name, severity, F.lit(holds), None if value is None else F.lit(value), details=details)

    parts = [missing_columns_warning(wide)]
    if not n["n_facts"]:
        parts.append(of_dataset("long_facts_not_available", "low", True, details="no long facts: their checks were left out"))
    else:
        parts.append(of_dataset("wide_company_year_missing_from_long", "high", n["lacks_long"] > 0, n["lacks_long"], LACKING))
        parts.append(of_dataset("long_company_year_missing_from_wide", "high", n["lacks_wide"] > 0, n["lacks_wide"], LACKING))
        if not with_rules:
            parts.append(of_dataset("sec_tags_config_not_available", "high", n["n_own"] > 0, details="no tag rules: tags weren't checked"))
    parts.append(of_dataset("revenue_metadata_not_available", "low", not n["revenue_facts"], details="no revenue facts: their periods weren't checked"))
    return reduce(DataFrame.unionByName, parts)


def all_warnings(wide: DataFrame, long: DataFrame, scope: Scope, rules: Sequence[Rule], *, this_year: int | Column | None = None) -> DataFrame:
    """The warnings of all checks, unordered.  ``wide`` and ``long`` as read or as built, each read once.

    The company-years' warnings are written to the shared folder, so that the counts for the checks of
    the whole dataset and the warnings themselves come from one pass.
    """
    schemas.require_columns(long, schemas.LONG, "long panel")
    typed = prepare_wide(wide)
    present = [v for v in schemas.VARIABLES if v in wide.columns]
    year = C.year_of_utc_now() if this_year is None else this_year
    table = rules_frame(wide.sparkSession, list(rules)) if rules else None
    years = company_years(typed, long, scope, table, len(rules))
    judged = checkpoint(judged_years(years, present, scope, year))
    n = judged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in judged.columns if c != "found"]).first()  # one row
    found = judged.select(F.explode("found").alias("w")).select("w.*")
    if not n["n_facts"]:
        found = found.where("check_name <> 'wide_value_differs_from_long'")  # nothing to compare with
    return _shown(found).unionByName(_dataset_warnings(wide, n, table is not None))


def _severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(c))


def ranked(warnings: DataFrame) -> DataFrame:
    """Warnings in order of severity, check, company, year and variable, numbered from 1."""
    order = [_severity_rank(), *[F.col(c) for c in ("check_name", "cik10", "company_year", "variable", "value", "reference_value", "details", "scope", "research_universe_id")]]
    return numbered(warnings, order, "warning_id").select(*schemas.WARNING)


def summary(warnings: DataFrame) -> DataFrame:
    """(severity, check_name, warning_count, company_count, company_year_count, first_warning_id), unordered.

    Warnings are numbered by severity and check first, so a check's first number follows from how many
    warnings the checks before it have; ``warnings`` needn't be numbered.  Companies and their years are
    counted by grouping step by step, each step a smaller one.  ``company_year_count`` is null for checks
    without company-years.
    """
    check = ["severity", "check_name"]
    known = (C.strip("cik10") != "") & (C.strip("company_year") != "")
    by_year = warnings.groupBy(*check, F.nullif(F.col("cik10"), F.lit("")).alias("company"), F.when(known, F.struct("cik10", "company_year")).alias("year")).agg(F.count("*").alias("n"))
    by_company = by_year.groupBy(*check, "company").agg(F.sum("n").alias("n"), F.count("year").alias("years"))
    counted = by_company.groupBy(*check).agg(F.sum("n").alias("warning_count"), F.count("company").alias("company_count"), F.nullif(F.sum("years"), F.lit(0)).alias("company_year_count"))
    before = Window.orderBy(_severity_rank(), "check_name").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each check
    return counted.withColumn("first_warning_id", F.coalesce(F.sum("warning_count").over(before), F.lit(0)) + 1).select(*schemas.SUMMARY)


def summary_order() -> list[Column]:
    """Severity, then the most frequent check first."""
    return [_severity_rank(), F.col("warning_count").desc(), F.col("check_name")]
