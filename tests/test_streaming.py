"""Streamed ingest against the same facts read at once."""

import json
import random

import pytest

from factpanel.operators import select
from factpanel.sources import config, facts
from factpanel.sources.config import Scope
from factpanel.streaming import ingest


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()

    def land(i):
        body = {"cik": i, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"val": i, "fy": 2020}]}}, "Other": {"units": {"USD": [{"val": 1}]}}}}}
        (folder / f"CIK{i:010d}.json").write_text(json.dumps(body))

    land(1), land(2)
    rules = config.read_rules()
    for more in (3, 4):
        ingest.ingest(spark, str(folder), rules, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        land(more)
    ingest.ingest(spark, str(folder), rules, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = sorted((r["cik10"], r["variable"], r["val"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(f"{i:010d}", "assets", str(i)) for i in (1, 2, 3, 4)]
    at_once = ingest.mapped_facts(facts.read_documents(spark, str(folder)), rules)
    assert sorted((r["cik10"], r["variable"], r["val"]) for r in at_once.collect()) == got


def document(rng, cik):
    """A company's document with facts of a few tags that compete for the same years, some of them rejected."""
    def fact():
        year = rng.choice([2012, 2013, 2014])
        return {"val": rng.choice([1, 2, 3, None]), "fy": rng.choice([year, year, None]), "fp": rng.choice(["FY", "FY", "Q1"]), "form": rng.choice(["10-K", "10-K", "10-K", "8-K"]), "filed": f"{year + 1}-0{rng.randint(1, 9)}-01", "accn": rng.choice("abc"), "start": f"{year}-01-01", "end": f"{year}-12-{rng.randint(28, 31)}", "frame": rng.choice([f"CY{year}", None])}

    tags = rng.sample(["Assets", "Revenues", "SalesRevenueNet", "StockholdersEquity", "Other"], 3)
    return json.dumps({"cik": cik, "facts": {"us-gaap": {t: {"units": {"USD": [fact() for _ in range(rng.randint(0, 6))]}} for t in tags}}})


@pytest.mark.parametrize("seed", range(2))
def test_running_best_equals_the_batch_in_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = [(f"{part}-CIK{cik:010d}.json", document(rng, cik)) for cik in range(1, 7) for part in range(4)]
    rules, scope = config.read_rules(), Scope(("10-K",), 2011, 2025)
    rng.shuffle(files)
    landed, out, state = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()

    def name(f):  # a folder a part, so that files of one key can land apart
        part, key = f.split("-", 1)
        (landed / part).mkdir(exist_ok=True)
        return landed / part / key

    for at in range(0, len(files), 9):  # each run restarts from the state of the last one
        for f, text in files[at : at + 9]:
            name(f).write_text(text)
        ingest.keep_best(spark, f"{landed}/*", rules, scope, out, state, files_a_batch=4).awaitTermination(180)
    judged = select.judge(ingest.mapped_facts(facts.read_documents(spark, f"{landed}/*"), rules), scope)
    columns = ["cik10", "variable", "company_year", "val", "accn", "filed", "end", "tag", *select.RANKS]
    want = sorted(map(str, select.best_candidates(judged, met=ingest.MET).select(*columns).collect()))
    assert sorted(map(str, ingest.current_best(spark, out).select(*columns).collect())) == want and len(want) > 20
    assert sorted(map(str, select.running_best(judged, met=ingest.MET).select(*columns).collect())) == want
