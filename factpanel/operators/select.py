"""Facts mapped to variables, rejected for one stated reason each, and the best one selected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import schemas
from ..sources.config import Scope

UNITS = ("USD",)
MAX_END_YEAR_LEAD = 1
MAX_LAG_DAYS = 240
MAX_FILING_YEAR_LEAD = 1
#: Reasons in the order in which they are tried; each fact has the first that holds.
REASONS = [
    "facts_rejected_unit",
    "facts_rejected_form",
    "facts_without_value",
    "facts_without_company_year",
    "facts_rejected_company_year",
    "facts_rejected_invalid_end_year",
    "facts_rejected_excessive_filing_lag",
    "facts_rejected_filing_year",
    "facts_rejected_invalid_flow_period",
    "facts_rejected_nonannual",
]
RANKS = ["annual_rank", "form_rank", "fp_rank", "period_match_rank", "filing_lag_days", "fy_match_rank", "frame_match_rank", "tier_rank"]
#: Rules beyond this number are joined by a shuffle instead of sent to each executor.
BROADCAST_RULES = 100_000


def map_to_rules(rows: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Rows with a configured (namespace, tag), with their rule's columns."""
    return rows.join(F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules, ["namespace", "tag"])


def unmapped(rows: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Rows whose (namespace, tag) no rule has."""
    known = rules.select("namespace", "tag").distinct()
    return rows.join(F.broadcast(known) if n_rules <= BROADCAST_RULES else known, ["namespace", "tag"], "left_anti")


def _year_in_scope(value: Column, scope: Scope) -> Column:
    held = value.isNotNull()
    if scope.start_year is not None:
        held = held & (value >= scope.start_year)
    if scope.end_year is not None:
        held = held & (value <= scope.end_year)
    return C.is_true(held)


def year_in_scope(year: Column | str, scope: Scope) -> Column:
    """Whether a year in text form is a number within the scope's bounds."""
    return _year_in_scope(C.integer(year), scope)


def end_year_too_late(end: Column | str, filed: Column | str, fy: Column | str) -> Column:
    year = F.year(C.iso_date(end))
    return C.is_true(year > F.year(C.iso_date(filed)) + MAX_END_YEAR_LEAD) | C.is_true(year > C.integer(fy) + MAX_END_YEAR_LEAD)


def lag_too_long(filed: Column | str, end: Column | str) -> Column:
    """Beyond the cap; an unknown or negative lag is."""
    return C.known_lag_days(filed, end) > MAX_LAG_DAYS


def filing_year_too_late(filed: Column | str, year: Column | str) -> Column:
    return C.is_true(F.year(C.iso_date(filed)) > C.integer(year) + MAX_FILING_YEAR_LEAD)


def judge(rows: DataFrame, scope: Scope, *, flows: Sequence[str] = schemas.FLOWS, units: Sequence[str] = UNITS) -> DataFrame:
    """Adds company_year, the ranks and ``reject_reason`` (null for a candidate).

    ``rows`` are facts with their rule: variable, unit, val, fy, fp, form, filed, frame, start, end.
    """
    flow = F.col("variable").isin(*flows)
    forms = list(scope.forms)
    # texts are parsed once, into columns that all that follows reads
    parsed = rows.withColumns(
        {
            "start_date": C.iso_date("start"),
            "end_date": C.iso_date("end"),
            "filed_date": C.iso_date("filed"),
            "fiscal_year": C.integer("fy"),
            "framed_year": C.frame_year("frame"),
            "upper_form": F.upper(C.text("form")),
            "is_fy": F.upper(C.text("fp")) == "FY",
        }
    )
    fiscal, framed, end, filed = (F.col(c) for c in ("fiscal_year", "framed_year", "end_date", "filed_date"))
    lag = F.datediff(filed, end)
    dated = parsed.withColumns(
        {
            "company_year": F.coalesce(fiscal.cast("string"), framed, F.year(end).cast("string"), C.text("fy")),
            "annual": C.between(F.datediff(end, F.col("start_date")) + 1, *C.ANNUAL_DAYS),
            "filing_lag_days": F.coalesce(F.when(lag >= 0, lag), F.lit(C.LAG_UNKNOWN)),
        }
    )
    year, annual = F.col("company_year"), F.col("annual")
    instant = F.col("upper_form").isin(*forms) & (C.text("end") != "") & (C.text("start") == "")
    by_fy, by_frame = C.is_true(fiscal.cast("string") == year), C.is_true(framed == year)
    at = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("upper_form")).cast("int")
    ranked = dated.withColumn("year_number", C.integer(year)).withColumns(
        {
            "annual_rank": F.when(flow, F.when(annual, 0).otherwise(C.NON_ANNUAL))
            .when(F.col("is_fy"), 0)
            .when(annual, 1)
            .when(framed.isNotNull(), 2)
            .when(instant, 3)
            .otherwise(C.NON_ANNUAL),
            "form_rank": F.when(at > 0, at - 1).otherwise(len(forms)),
            "fp_rank": F.when(F.col("is_fy"), 0).otherwise(1),
            "period_match_rank": F.when(by_fy & by_frame, 0).when(by_fy, 1).when(by_frame, 2).when(fiscal.isNull() & framed.isNull(), 3).otherwise(4),
            "fy_match_rank": F.when(fiscal.isNull(), 1).when(by_fy, 0).otherwise(2),
            "frame_match_rank": F.when(framed.isNull(), 1).when(by_frame, 0).otherwise(2),
        }
    )
    tests = [
        ~F.col("unit").isin(*units),
        ~C.strip("upper_form").isin(*forms),
        C.text("val") == "",
        year == "",
        ~_year_in_scope(F.col("year_number"), scope),
        C.is_true(F.year(end) > F.year(filed) + MAX_END_YEAR_LEAD) | C.is_true(F.year(end) > fiscal + MAX_END_YEAR_LEAD),
        F.col("filing_lag_days") > MAX_LAG_DAYS,
        C.is_true(F.year(filed) > F.col("year_number") + MAX_FILING_YEAR_LEAD),
        flow & ~annual,
        F.col("annual_rank") == C.NON_ANNUAL,
    ]
    reason = F.lit(None).cast("string")
    for name, test in list(zip(REASONS, tests, strict=True))[::-1]:
        reason = F.when(test, name).otherwise(reason)
    return ranked.withColumn("reject_reason", reason).drop("start_date", "fiscal_year", "framed_year", "upper_form", "is_fy", "annual", "year_number")


def reject_counts(judged: DataFrame) -> DataFrame:
    """(outcome, facts): how many facts each reason rejects, and how many are candidates."""
    return judged.groupBy(F.coalesce("reject_reason", F.lit("candidate_facts")).alias("outcome")).agg(F.count("*").alias("facts"))


def order_key() -> list[Column]:
    """The fifteen parts of the order among candidates, then the order in which they are met."""
    return [
        *[F.col(c) for c in RANKS],
        F.col("tag_priority"),
        F.col("filed_date").asc_nulls_first(),  # the earliest filing
        F.col("end_date").desc_nulls_last(),  # of the latest period
        C.text("accn"),
        F.col("namespace"),
        F.col("tag"),
        C.text("val"),
    ]


def order_value(met: Sequence[str] = ()) -> Column:
    """The order among candidates as one value, the least of which is the best: nulls come first, later ends before earlier ones."""
    days = F.unix_date("end_date")
    parts = [*[F.col(c) for c in RANKS], F.col("tag_priority"), F.col("filed_date"), F.coalesce(-days, F.lit(1 << 30)), C.text("accn"), F.col("namespace"), F.col("tag"), C.text("val"), *[F.col(c) for c in met]]
    return F.struct(*[c.alias(f"p{i}") for i, c in enumerate(parts)])


def running_best(judged: DataFrame, *, keys: Sequence[str] = ("cik10", "variable", "company_year"), met: Sequence[str] = ()) -> DataFrame:
    """What ``best_candidates`` gives, as an aggregation: the row of the least order of each key.

    It can be kept up as facts arrive in a stream: the state of a key is its best row so far.
    """
    candidates = judged.where("reject_reason is null")
    kept = [c for c in candidates.columns if c not in (*keys, "reject_reason")]
    found = candidates.groupBy(*keys).agg(F.min(F.struct(order_value(met).alias("at"), F.struct(*kept).alias("row"))).alias("best"))
    return found.select(*keys, "best.row.*")


def best_candidates(judged: DataFrame, *, keys: Sequence[str] = ("cik10", "variable", "company_year"), met: Sequence[str] = ()) -> DataFrame:
    """The first candidate of each key; ``met`` names columns that settle full ties."""
    window = Window.partitionBy(*keys).orderBy(*order_key(), *met)
    candidates = judged.where("reject_reason is null")
    return candidates.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank", "reject_reason")
