"""The panel of fact documents against a plain-Python account of the same rules."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factpanel.operators import panel as panel_ops
from factpanel.operators import reports
from factpanel.plans import pipeline
from factpanel.sources import config, facts, schemas

TAGS = {
    "assets": ["Assets"],
    "liabilities": ["Liabilities"],
    "liabilities_and_equity": ["LiabilitiesAndStockholdersEquity"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "revenues": ["Revenues", "SalesRevenueNet"],
    "ebit": ["OperatingIncomeLoss"],
    "operating_costs": ["CostsAndExpenses"],
}


def iso(text):
    try:
        return date.fromisoformat(text) if isinstance(text, str) and len(text) == 10 else None
    except ValueError:
        return None


def whole(x):
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def make_fact(rng):
    year = rng.randint(2009, 2021)
    end = date(year, 12, 31) - timedelta(days=rng.choice([0, 0, 0, 30, 200]))
    start = end - timedelta(days=rng.choice([364, 364, 364, 298, 299, 300, 89, 400]))
    fact = {
        "val": rng.choice([0, 5, 100, 250.5, -3, None, "", 1000, 70]),
        "fy": rng.choice([year, year, year, year + 1, None, str(year), "odd"]),
        "fp": rng.choice(["FY", "FY", "fy", "Q1", None]),
        "form": rng.choice(["10-K", "10-K", "10-K", " 10-k ", "10-Q", None]),
        "filed": (end + timedelta(days=rng.choice([60, 60, 240, 241, -1, 400]))).isoformat(),
        "accn": rng.choice(["a1", "a2", "a3"]),
        "end": rng.choice([end.isoformat()] * 9 + ["bad"]),
    }
    if rng.random() < 0.8:
        fact["start"] = start.isoformat()
    if rng.random() < 0.5:
        fact["frame"] = rng.choice([f"CY{year}", f"CY{year}Q4I", f"CY{year}Q2", f"CY{year}\n"])
    return fact


def make_documents(seed):
    rng = random.Random(seed)
    out = {}
    for i in range(12):
        tags = {}
        for names in TAGS.values():
            for name in names:
                if rng.random() < 0.8:
                    units = {"USD": [make_fact(rng) for _ in range(rng.randint(1, 25))]}
                    if rng.random() < 0.3:
                        units["EUR"] = [make_fact(rng), 5, "x"]
                    if rng.random() < 0.1:
                        units["USD"] += [7, "text", None]
                    tags[name] = {"label": name.lower(), "description": None, "units": units}
        tags["Unmapped"] = {"label": "", "units": 5}
        out[f"{i + 1:010d}"] = json.dumps({"cik": i + 1, "entityName": "x", "facts": {"us-gaap": tags, "dei": {}}})
    out["0000000013"] = '{"cik": 13, "facts": '
    out["0000000014"] = json.dumps({"cik": 14, "facts": []})
    out["0000000015"] = json.dumps({"cik": 15})
    return out


def brute(documents, companies, rules, scope):
    stats = dict.fromkeys(["candidate_facts", "json_parse_errors", "missing_companyfacts_files", "files_without_facts", "companyfacts_files_parsed"], 0)
    best = {}

    def hit(name, by=1):
        stats[name] = stats.get(name, 0) + by

    for key in companies:
        if key not in documents:
            hit("missing_companyfacts_files")
            continue
        try:
            body = json.loads(documents[key])
        except ValueError:
            hit("json_parse_errors")
            continue
        hit("companyfacts_files_parsed")
        tree = body.get("facts", {})
        if not isinstance(tree, dict):
            hit("files_without_facts")
            continue
        for rule in rules:
            units = tree.get(rule.namespace, {}).get(rule.tag, {}).get("units", {})
            for unit, listed in units.items() if isinstance(units, dict) else []:
                if unit != "USD":
                    hit("facts_rejected_unit", len(listed))
                    continue
                for f in listed:
                    if not isinstance(f, dict):
                        continue
                    row = judge(f, rule, scope)
                    if isinstance(row, str):
                        hit(row)
                        continue
                    hit("candidate_facts")
                    slot = (key, rule.variable, row["year"])
                    if slot not in best or row["order"] < best[slot]["order"]:
                        best[slot] = row
    return stats, best


def judge(f, rule, scope):
    flow = rule.variable in schemas.FLOWS
    form = f.get("form") or ""
    start, end, filed = iso(f.get("start")), iso(f.get("end")), iso(f.get("filed"))
    fy = whole(f.get("fy"))
    frame = f.get("frame") or ""
    annual_frame = len(frame) in (6, 9) and frame[:2] == "CY" and frame[2:6].isdigit() and frame[6:] in ("", "Q4I")
    framed = frame[2:6] if annual_frame else None
    days = (end - start).days + 1 if start and end else None
    annual = days is not None and 300 <= days <= 400
    if form.strip().upper() not in scope.forms:
        return "facts_rejected_form"
    if f.get("val") in (None, ""):
        return "facts_without_value"
    year = str(fy) if fy is not None else framed or (str(end.year) if end else "") or (f.get("fy") or "")
    if not year:
        return "facts_without_company_year"
    if whole(year) is None or not scope.start_year <= int(year) <= scope.end_year:
        return "facts_rejected_company_year"
    if end and ((filed and end.year > filed.year + 1) or (fy is not None and end.year > fy + 1)):
        return "facts_rejected_invalid_end_year"
    lag = (filed - end).days if filed and end else 999_999
    lag = lag if lag >= 0 else 999_999
    if lag > 240:
        return "facts_rejected_excessive_filing_lag"
    if filed and filed.year > int(year) + 1:
        return "facts_rejected_filing_year"
    if flow and not annual:
        return "facts_rejected_invalid_flow_period"
    fp = (f.get("fp") or "").upper()
    if flow or fp == "FY":
        rank = 0
    elif annual:
        rank = 1
    elif annual_frame:
        rank = 2
    elif form.upper() in scope.forms and f.get("end") and not f.get("start"):
        rank = 3
    else:
        return "facts_rejected_nonannual"
    by_fy, by_frame = fy is not None and str(fy) == year, framed == year
    period = 0 if by_fy and by_frame else 1 if by_fy else 2 if by_frame else 3 if fy is None and framed is None else 4
    match = lambda v: 1 if v is None else 0 if v == year else 2
    stamp = lambda d: d.year * 10000 + d.month * 100 + d.day if d else 0
    order = (
        rank, scope.forms.index(form.upper()) if form.upper() in scope.forms else len(scope.forms), 0 if fp == "FY" else 1, period, lag,
        match(None if fy is None else str(fy)), match(framed), rule.tier_rank, rule.tag_priority, stamp(filed), -stamp(end), str(f.get("accn")), rule.namespace, rule.tag, str(f["val"]),
    )
    return {"year": year, "val": float(f["val"]), "order": order, "tag": rule.tag, "fact": f}


def derive(best):
    out = {k: (r["val"], r["tag"]) for k, r in best.items()}
    stats = dict.fromkeys(["derived_assets", "derived_assets_rejected", "derived_liabilities", "derived_liabilities_rejected", "derived_operating_costs", "derived_operating_costs_replaced", "derived_operating_costs_rejected"], 0)
    for c, y in sorted({(c, y) for c, _, y in best}):
        get = lambda v, c=c, y=y: out.get((c, v, y))
        total, equity = get("liabilities_and_equity"), get("equity")
        if total:
            if total[0] < 0:
                stats["derived_assets_rejected"] += 1
                stats["derived_liabilities_rejected"] += 1
            else:
                if not get("assets"):
                    out[c, "assets", y] = (total[0], "LiabilitiesAndStockholdersEquityAsAssets")
                    stats["derived_assets"] += 1
                if not get("liabilities") and equity:
                    if total[0] - equity[0] < 0:
                        stats["derived_liabilities_rejected"] += 1
                    else:
                        out[c, "liabilities", y] = (total[0] - equity[0], "LiabilitiesAndStockholdersEquityLessEquity")
                        stats["derived_liabilities"] += 1
        revenues, ebit = get("revenues"), get("ebit")
        if revenues and ebit:
            if revenues[0] - ebit[0] < 0:
                stats["derived_operating_costs_rejected"] += 1
            else:
                stats["derived_operating_costs_replaced" if get("operating_costs") else "derived_operating_costs"] += 1
                out[c, "operating_costs", y] = (revenues[0] - ebit[0], "RevenuesLessOperatingIncomeLoss")
    return out, stats


@pytest.fixture(scope="module")
def built(spark):
    documents = make_documents(7)
    rules, scope = config.read_rules(), config.read_scope()
    keys = [f"{i + 1:010d}" for i in range(17)]
    companies = spark.createDataFrame([(str(i + 1), str(i + 1), k, f"C{i}", "T", "Retail", "1231") for i, k in enumerate(keys)], ", ".join(f"{c} string" for c in schemas.COMPANY))
    frame = spark.createDataFrame([(f"file:/x/CIK{k}.json", t) for k, t in documents.items()], "source_file string, text string")
    result = pipeline.build_panel(companies, frame.repartition(3), rules, scope)
    return documents, keys, rules, scope, companies, frame, result


def test_selection_and_derivation_match_plain_python(built):
    documents, keys, rules, scope, _, _, result = built
    stats, best = brute(documents, keys, rules, scope)
    want, more = derive(best)
    got = {(r["cik10"], r["variable"], r["company_year"]): (float(r["value"]), r["tag"]) for r in result.long.collect()}
    assert got == want
    row = result.stats.first().asDict()
    for name, n in {**stats, **more}.items():
        assert row[name] == n, name
    assert row["companies_in_universe"] == 17 and row["companyfacts_files_found"] == 15


def test_order_of_input_does_not_matter(spark, built):
    _, _, rules, scope, companies, frame, result = built
    again = pipeline.build_panel(companies, frame.orderBy(F.rand(5)).repartition(7), rules, scope)
    assert sorted(map(str, again.long.collect())) == sorted(map(str, result.long.collect()))


def test_wide_and_reports_agree_with_long(built):
    _, keys, rules, _, _, _, result = built
    long, wide = result.long.toPandas(), result.wide.toPandas()
    cells = {(r.cik10, r.company_year, v): getattr(r, v) for r in wide.itertuples() for v in schemas.VARIABLES if getattr(r, v) == getattr(r, v) and getattr(r, v) is not None}
    assert cells == {(r.cik10, r.company_year, r.variable): float(r.value) for r in long.itertuples()}
    coverage = result.coverage.toPandas()
    assert coverage["variable"].tolist() == schemas.VARIABLES
    assert coverage["selected_observations"].sum() == len(long)
    usage = result.usage.toPandas()
    assert len(usage) == 61 and usage["selected_observations"].sum() == (long["tier"] != "derived").sum()
    missing = result.missing.toPandas()
    assert len(missing) == len(keys)
    assert (missing["variables_with_any_value"] + missing["variables_missing_any_value"] == 27).all()


def test_inventory_counts_tags_units_and_facts(spark):
    from factpanel.operators.inventory import tag_inventory

    rows = [
        ("file:/x/CIK0000000001.json", json.dumps({"cik": 1, "facts": {"n": {"T": {"label": "", "units": {"USD": [{"fy": 2020, "form": "10-K"}, "x"], "EUR": 5}}, "U": {"units": 5}}}})),
        ("file:/x/CIK0000000002.json", json.dumps({"cik": None, "facts": {"n": {"T": {"label": "second", "units": {"USD": [{"end": "2019-05-05", "form": ""}]}}, "odd": 7}}})),
    ]
    got = {r["tag"]: r.asDict() for r in tag_inventory(facts.open_documents(spark.createDataFrame(rows, "source_file string, text string"))).collect()}
    assert set(got) == {"T", "U"}
    t = got["T"]
    assert (t["label"], t["units"], t["forms"], t["company_count"], t["company_year_count"], t["fact_count"]) == ("second", "EUR;USD", "10-K", 2, 2, 3)
    assert (got["U"]["company_count"], got["U"]["fact_count"], got["U"]["units"]) == (1, 0, "")


def odd_document(rng):
    """A document in which any value may be of another kind, or that breaks off."""
    odd = lambda: rng.choice([None, 5, "x", [], [1], {}, True])
    at = lambda make, p=0.95: make() if rng.random() < p else odd()
    fact = lambda: {k: rng.choice([2012, "2013", "", None, "10-K", "2014-12-31", 1.5]) for k in rng.sample(["fy", "end", "form", "val", "x"], rng.randint(0, 4))}
    unit = lambda: [at(fact) for _ in range(rng.randint(0, 3))]
    units = lambda: {u: at(unit) for u in rng.sample(["USD", "EUR", ""], rng.randint(0, 3))}
    tag = lambda: {"label": rng.choice(["L1", "", None, 7]), "description": rng.choice(["D1", "", "é"]), "units": at(units)}
    space = lambda: {t: at(tag) for t in rng.sample("ABCD", rng.randint(0, 4))}
    facts = lambda: {n: at(space) for n in rng.sample(["n", "m"], rng.randint(0, 2))}
    text = json.dumps({"cik": rng.choice([1, 2, "0000000004", None]), "facts": at(facts)})
    return text if rng.random() < 0.95 else text[:-2]


def plain_inventory(rows):
    """(namespace, tag) -> the inventory's other columns, in plain Python."""
    out = {}
    for source, text in sorted(rows):
        try:
            doc = json.loads(text)
        except ValueError:
            continue
        cik = doc["cik"]
        cik = source[source.index("CIK") + 3 : -5] if cik is None else str(cik).zfill(10)
        spaces = doc["facts"] if isinstance(doc["facts"], dict) else {}
        for space, tags in spaces.items():
            for tag, payload in tags.items() if isinstance(tags, dict) else ():
                if not isinstance(payload, dict):
                    continue
                t = out.setdefault((space, tag), {"label": "", "description": "", "units": set(), "forms": set(), "companies": set(), "years": set(), "n": 0})
                t["companies"].add(cik)
                for c in ("label", "description"):
                    t[c] = t[c] or ("" if payload.get(c) is None else str(payload[c]))
                units = payload.get("units") if isinstance(payload.get("units"), dict) else {}
                for unit, items in units.items():
                    t["units"].add(unit)
                    items = items if isinstance(items, list) else []
                    t["n"] += len(items)
                    for fact in items:
                        if isinstance(fact, dict):
                            t["forms"].add("" if fact.get("form") is None else str(fact["form"]))
                            t["years"].add((cik, fact.get("fy"), fact.get("end")))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_inventory_of_odd_documents(spark, seed):
    from factpanel.functions import columns as C
    from factpanel.operators.inventory import tag_inventory

    rng = random.Random(seed)
    rows = [(f"x/CIK{i:010d}.json", odd_document(rng)) for i in range(150)]
    df = spark.createDataFrame([*rows, ("n/CIK1.json", None), ("e/CIK2.json", "")], "source_file string, text string").repartition(4)
    got = {(r["namespace"], r["tag"]): r for r in tag_inventory(df).collect()}
    want = plain_inventory(rows)
    assert set(got) == set(want)
    pairs = sorted({(str(fy) if fy is not None else None, str(end) if end is not None else None) for t in want.values() for _, fy, end in t["years"]}, key=str)
    years = {(r["fy"], r["end"]): r["y"] for r in spark.createDataFrame(pairs, "fy string, end string").select("*", C.inventory_year("fy", "end").alias("y")).collect()}
    for key, t in want.items():
        of = {(c, years[None if fy is None else str(fy), None if end is None else str(end)]) for c, fy, end in t["years"]}
        shown = (t["label"], t["description"], ";".join(sorted(t["units"] - {""})), ";".join(sorted(t["forms"] - {""})), len(t["companies"]), len({p for p in of if p[1]}), t["n"])
        assert tuple(got[key])[2:] == shown, key


def test_counts_copy_no_rows(spark, built):
    from factpanel.operators.inventory import tag_inventory

    long = built[-1].long
    table = config.rules_frame(spark, config.read_rules())
    docs = spark.createDataFrame([("a", "{}")], "source_file string, text string")
    for df in (reports.variable_coverage(long, schemas.VARIABLES, table, 1, 1), reports.tag_usage(long, table), tag_inventory(docs)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_stored_panels_are_compared_without_a_shuffle(spark, tmp_path):
    panel = panel_ops
    from factpanel.sources import tables

    rng = random.Random(8)
    keys = [(rng.choice([None, "1", "2", "3"]), rng.choice([None, "2011", "2012"])) for _ in range(25)]
    wide = [(*k, rng.choice([None, 1.0, 2.0]), rng.choice([None, 5.0])) for k in keys[:14]]
    long = [(*k, rng.choice(["a", "b", "c"]), rng.choice([None, 1.0, 2.05, 5.0])) for k in keys[9:]]
    w, f = spark.createDataFrame(wide, "cik10 string, company_year string, a double, b double"), spark.createDataFrame(long, "cik10 string, company_year string, variable string, value double")
    stored = [tables.write_bucketed(df, f"compared_{n}", panel.KEYS, 3, str(tmp_path / n)) for n, df in (("w", w), ("f", f))]
    got = panel.compare(*stored, ["a", "b"], tolerance=0.1)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    known = lambda k: None not in k[:2]
    want = [(*k, "missing_from_long", None, None, None) for k in {r[:2] for r in wide} if not known(k) or k not in {r[:2] for r in long}]
    want += [(*k, "missing_from_wide", None, None, None) for k in {r[:2] for r in long} if not known(k) or k not in {r[:2] for r in wide}]
    for r in wide:
        for variable, mine in zip("ab", r[2:], strict=True):
            partners = [x[3] for x in long if known(r) and x[:3] == (*r[:2], variable)] or [None]
            want += [(*r[:2], "differs", variable, mine, other) for other in partners if mine is not None and (other is None or abs(mine - other) > 0.1)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_wide_refuses_two_values_for_one_key(spark):
    df = spark.createDataFrame([("a", "2020", "assets", 1.0), ("a", "2020", "assets", 2.0)], "cik10 string, company_year string, variable string, value double")
    with pytest.raises(Exception, match="more than one value"):
        panel_ops.wide(df, ["assets"]).collect()


def test_empty_long_gives_zero_reports(spark, built):
    _, _, rules, _, companies, _, result = built
    empty = spark.createDataFrame([], result.long.schema)
    table = config.rules_frame(spark, rules)
    assert reports.variable_coverage(empty, schemas.VARIABLES, table, 0, 0).agg(F.sum("selected_observations")).first()[0] == 0
    assert reports.tag_usage(empty, table).where("units <> ''").count() == 0
    assert reports.missing_by_company(empty, companies, schemas.VARIABLES).where("variables_missing_any_value = 27").count() == 17


def test_report_and_whole_run(spark, tmp_path, built):
    _, _, rules, scope, _, frame, _ = built
    metadata = spark.createDataFrame(
        [(i, f"{i:010d}", "map", f"Company {i}", "operating", "3990", "things", "1231", "AA;B", "NYSE", "", "", "success", "", "") for i in range(1, 16)],
        "cik long, " + ", ".join(f"{c} string" for c in schemas.METADATA[1:]),
    )
    result = pipeline.run(spark, metadata, frame, rules, scope, str(tmp_path), this_year=2026)
    text = pipeline.report_of(result, scope, {"companies": "x"})
    assert "| candidate facts |" in text
    warnings = spark.read.parquet(f"{tmp_path}/warnings")
    ids = [r[0] for r in warnings.select("warning_id").orderBy("warning_id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and ids
    total = spark.read.parquet(f"{tmp_path}/warnings_summary").agg(F.sum("warning_count")).first()[0]
    assert total == len(ids)


def test_a_run_reads_each_document_once(spark):
    texts = ['{"cik": 1, "facts": {"us-gaap": {"A": {"units": {"USD": [{"val": 1, "fy": 2020}, 7], "EUR": [{"val": 2}]}}, "B": 3}, "x": null}}', '{"facts": {', '{"facts": 7}', '{"facts": null}', "{}", "[1]", "", ' {"facts": {}} ', '{"facts": {"us-gaap": 5}}', None]
    documents = spark.createDataFrame([(f"a/CIK{i:010d}.json", t) for i, t in enumerate(texts)], "source_file string, text string")
    want = facts.open_documents(documents).select("source_file", "file_key", "cik", "status")
    whole = facts.whole_documents(documents)
    assert sorted(map(str, whole.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    companies = spark.createDataFrame([("0000000000",)], "cik10 string")
    rules = config.rules_frame(spark, [config.Rule("assets", "tier_1", 1, "us-gaap", "A", 1, 0)])
    rows = pipeline.listed_rows(companies, documents, rules, 1, ["USD"])
    assert [(r["val"], r["fact_order"]) for r in rows.where("fact_order is not null").collect()] == [("1", 0)]
    assert [(r["unit"], r["foreign"]) for r in rows.where("foreign is not null").collect()] == [("EUR", 1)]
    assert rows.where("status is not null").count() == len(texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3  # documents, rules and companies
