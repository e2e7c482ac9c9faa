"""Tag rules and dataset scope, read from YAML on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .schemas import FLOWS, RULES, STOCKS

DEFAULT_FORMS = ("10-K",)
CONFIG = Path(__file__).resolve().parent.parent / "config"


@dataclass(frozen=True)
class Scope:
    """Forms and years that a panel takes; a bound that is None is open."""

    forms: tuple[str, ...] = DEFAULT_FORMS
    start_year: int | None = None
    end_year: int | None = None
    horizon_years: int | None = None
    max_split_year: int | None = None


@dataclass(frozen=True)
class Rule:
    variable: str
    tier: str
    tier_rank: int
    namespace: str
    tag: str
    tag_priority: int
    rule_order: int


def _load(path: str | Path) -> Any:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def tier_number(tier: str) -> int:
    found = re.fullmatch(r"tier_(\d+)", tier)
    if not found:
        raise ValueError(f"not a tier: {tier!r}")
    return int(found[1])


def parse_rules(config: Any, *, strict: bool = True) -> list[Rule]:
    """Rules in the order of the file; priorities run through a variable's tiers.

    Strict reading refuses anything odd; lenient reading leaves it out.
    """

    def refuse(why: str) -> None:
        if strict:
            raise ValueError(why)

    if not isinstance(config, dict) or not config:
        refuse("tag rules must be a mapping of variables")
        return []
    unknown = sorted(set(map(str, config)) - set(FLOWS) - set(STOCKS))
    if unknown:
        refuse(f"neither flow nor stock: {unknown}")
    rules: list[Rule] = []
    for variable, tiers in config.items():
        if not isinstance(tiers, dict):
            refuse(f"{variable}: tiers must be a mapping")
            continue
        priority = 0
        for tier, tags in tiers.items():
            rank = tier_number(str(tier)) if strict else int((re.findall(r"\d+", str(tier)) or ["0"])[0])
            if not isinstance(tags, list):
                refuse(f"{variable}.{tier}: tags must be a list")
                continue
            for tag in tags:
                named = tag if isinstance(tag, dict) else {}
                namespace, name = str(named.get("namespace", "")).strip(), str(named.get("tag", "")).strip()
                if not namespace or not name:
                    refuse(f"{variable}.{tier}: a tag needs namespace and tag")
                    continue
                priority += 1
                rules.append(Rule(str(variable), str(tier), rank, namespace, name, priority, len(rules)))
    return rules


def read_rules(path: str | Path = CONFIG / "tag_rules.yaml", *, strict: bool = True) -> list[Rule]:
    """Rules of a file; lenient reading of a missing file gives none."""
    if not strict and not Path(path).exists():
        return []
    return parse_rules(_load(path), strict=strict)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.variable, r.tier, r.tier_rank, r.namespace, r.tag, r.tag_priority, r.rule_order) for r in rules]
    return spark.createDataFrame(rows, RULES)


def variables_of(rules: list[Rule]) -> list[str]:
    return list(dict.fromkeys(r.variable for r in rules))


def parse_scope(config: Any) -> Scope:
    config = config if isinstance(config, dict) else {}
    dataset, target, splits = (config.get(k) or {} for k in ("dataset", "target", "splits"))
    forms = dataset.get("forms", DEFAULT_FORMS)
    if not isinstance(forms, (list, tuple)):
        raise ValueError("dataset.forms must be a list")
    forms = tuple(f for f in (str(x).strip().upper() for x in forms) if f)
    if not forms:
        raise ValueError("dataset.forms must name a form")

    def year(key: str) -> int | None:
        value = dataset.get(key)
        if value in (None, ""):
            return None
        try:
            return int(value)
        except (TypeError, ValueError) as error:
            raise ValueError(f"dataset.{key} isn't a year: {value!r}") from error

    start, end, horizon = year("start_year"), year("end_year"), int(target.get("horizon_years") or 0)
    years = [] if splits.get("train_end_year") in (None, "") else [int(splits["train_end_year"])]
    for key in ("validation_years", "test_years"):
        more = splits.get(key, [])
        if not isinstance(more, (list, tuple)):
            raise ValueError(f"splits.{key} must be a list")
        years += [int(y) for y in more]
    last = max(years, default=None)
    if start is not None and end is not None and start > end:
        raise ValueError(f"start_year {start} is after end_year {end}")
    if end is not None and last is not None and end < last + horizon:
        raise ValueError(f"end_year {end} must reach {last + horizon}: the last split year and its horizon")
    return Scope(forms, start, end, horizon, last)


def read_scope(path: str | Path = CONFIG / "dataset.yaml") -> Scope:
    return parse_scope(_load(path)) if Path(path).exists() else Scope()
