"""Balance-sheet and cost values derived from the selected ones.

All three rules look at one company-year at a time, so the selected rows are gathered once to a row
per company-year with the six variables side by side; no table is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .select import RANKS

# Names of the derived tags.
ASSETS_TAG = "LiabilitiesAndStockholdersEquityAsAssets"
LIABILITIES_TAG = "LiabilitiesAndStockholdersEquityLessEquity"
COSTS_TAG = "RevenuesLessOperatingIncomeLoss"
SOURCES = ["liabilities_and_equity", "equity", "assets", "liabilities", "revenues", "ebit", "operating_costs"]
DERIVED_TIER_RANK = 99
COUNTERS = [
    "derived_assets",
    "derived_assets_rejected",
    "derived_liabilities",
    "derived_liabilities_rejected",
    "derived_operating_costs",
    "derived_operating_costs_replaced",
    "derived_operating_costs_rejected",
]


def _facts(selected: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in selected.columns if c not in ("cik10", "company_year")])


def side_by_side(selected: DataFrame) -> DataFrame:
    """(cik10, company_year, a struct for each of SOURCES): the selected row, or null."""
    row = _facts(selected)
    wanted = selected.where(F.col("variable").isin(SOURCES))
    return wanted.groupBy("cik10", "company_year").agg(*[F.any_value(F.when(F.col("variable") == v, row), ignoreNulls=True).alias(v) for v in SOURCES])


def outcomes(rows: DataFrame) -> DataFrame:
    """Adds the derived values (null for none) and a flag for each of COUNTERS."""
    has = {v: F.col(v).isNotNull() for v in SOURCES}
    n = {v: C.number(F.col(v)["val"]) for v in SOURCES}
    total = n["liabilities_and_equity"]
    usable = C.is_true(total >= 0)
    bad_total = has["liabilities_and_equity"] & ~usable
    assets = has["liabilities_and_equity"] & usable & ~has["assets"]
    asked = has["liabilities_and_equity"] & usable & ~has["liabilities"] & has["equity"]
    difference = total - n["equity"]
    liabilities = asked & C.is_true(difference >= 0)
    both = has["revenues"] & has["ebit"]
    margin = n["revenues"] - n["ebit"]
    costs = both & C.is_true(margin >= 0)
    return rows.withColumns(
        {
            "derived_assets_value": F.when(assets, total),
            "derived_liabilities_value": F.when(liabilities, difference),
            "derived_operating_costs_value": F.when(costs, margin),
            "derived_assets": assets,
            "derived_assets_rejected": bad_total,
            "derived_liabilities": liabilities,
            "derived_liabilities_rejected": bad_total | (asked & ~liabilities),
            "derived_operating_costs": costs & ~has["operating_costs"],
            "derived_operating_costs_replaced": costs & has["operating_costs"],
            "derived_operating_costs_rejected": both & ~costs,
        }
    )


def counters(found: DataFrame) -> DataFrame:
    """One row: how often each outcome of COUNTERS came up."""
    return found.agg(*[F.count_if(c).alias(c) for c in COUNTERS])


def _made(variable: str, tag: str, sources: list[str], fields: list[T.StructField]) -> Column:
    """A derived row as a struct, null where nothing is derived."""
    first, value = F.col(sources[0]), F.col(f"derived_{variable}_value")
    changed = {
        "variable": F.lit(variable),
        "val": value.cast("string"),
        "number": value,
        "namespace": F.lit("derived"),
        "tag": F.lit(tag),
        "tier": F.lit("derived"),
        "tag_priority": F.lit(0),
        "tier_rank": F.lit(DERIVED_TIER_RANK),
    }
    for rank in RANKS[:-1]:
        parts = [F.col(s)[rank] for s in sources]
        changed[rank] = F.greatest(*parts) if len(parts) > 1 else parts[0]
    row = F.struct(*[changed.get(f.name, first[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    return F.when(value.isNotNull(), row)


def with_derived(selected: DataFrame, found: DataFrame) -> DataFrame:
    """The selected rows, less replaced operating costs, and the derived rows.

    A derived row takes everything but its own values from its first source.  The variables that the
    rules look at come from the company-years in ``found``, all others from ``selected`` as they are.
    """
    columns = selected.columns
    fields = [f for f in selected.schema.fields if f.name not in ("cik10", "company_year")]
    rows = [F.col(v) if v != "operating_costs" else F.when(~F.col("derived_operating_costs_replaced"), F.col(v)) for v in SOURCES]
    rows += [
        _made("assets", ASSETS_TAG, ["liabilities_and_equity"], fields),
        _made("liabilities", LIABILITIES_TAG, ["liabilities_and_equity", "equity"], fields),
        _made("operating_costs", COSTS_TAG, ["revenues", "ebit"], fields),
    ]
    looked_at = found.select("cik10", "company_year", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("cik10", "company_year", "r.*")
    return selected.where(~F.col("variable").isin(SOURCES)).unionByName(looked_at.select(*columns))
