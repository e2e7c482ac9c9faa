"""Column functions and configuration on hand-written rows."""

import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from factpanel.functions import columns as C
from factpanel.operators import classify
from factpanel.sources import config, landing, schemas, tables


def values(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_company_keys(spark):
    rows = ["320193", "CIK320193", " cik 320193 ", "12345678901", "12a", None]
    assert values(spark, rows, "x string", C.company_key("x")) == ["0000320193"] * 3 + [None] * 3
    with pytest.raises(Exception, match="invalid company key"):
        values(spark, ["12a"], "x string", C.company_key("x", strict=True))
    assert values(spark, [("7", "a/CIK0000000009.json"), (None, "a/CIK0000000009.json")], "x string, f string", C.company_key_or_file("x", "f")) == ["0000000007", "0000000009"]


def test_padding_never_cuts(spark):
    assert values(spark, ["12345678901", "7", "-7"], "x string", C.zero_pad("x", 10)) == ["12345678901", "0000000007", "-000000007"]


def test_first_item(spark):
    assert values(spark, [None, "", " ;ABC;X", "A;B"], "x string", C.first_item("x")) == ["", "", "ABC", "A"]


def test_numbers(spark):
    rows = ["1e5", " 12 ", "1d", "1_000", "", None, "nan", "inf", ".5", "5."]
    assert values(spark, rows, "x string", C.number("x")) == [100000.0, 12.0, None, None, None, None, None, None, 0.5, 5.0]
    assert values(spark, rows, "x string", C.invalid_number("x")) == [False, False, True, True, False, False, True, True, False, False]
    assert values(spark, ["3571.9", "x", None, "-1"], "x string", C.industry_code("x")) == [3571, None, None, -1]


def test_dates(spark):
    rows = ["2020-01-31", "2020-1-5", "20200131", "2020-02-30", " 2020-01-31 ", None, "2020-01-31T00"]
    assert [d and d.isoformat() for d in values(spark, rows, "x string", C.iso_date("x"))] == ["2020-01-31", None, None, None, "2020-01-31", None, None]
    assert values(spark, rows[:2], "x string", C.date_number("x")) == [20200131, 0]


@pytest.mark.parametrize(("fy", "frame", "end", "want"), [("2020", None, None, "2020"), (None, "CY2019", None, "2019"), (None, "CY2019Q4I", None, "2019"), (None, "CY2019Q2", "2018-12-31", "2018"), (None, None, None, ""), ("odd", None, None, "odd"), (None, "CY2019\n", None, "")])
def test_company_year(spark, fy, frame, end, want):
    assert values(spark, [(fy, frame, end)], "fy string, frame string, end string", C.company_year("fy", "frame", "end")) == [want]


def six_digits(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x double").withColumn("six_0_c", F.lit("?"))
    return [r["x"] for r in C.with_six_digits(df, {"x": F.col("x")}).orderBy("i").collect()]


def test_six_digits_follow_python(spark):
    rng = random.Random(4)
    rows = [0.0, 1e9, 0.5, -2.0, 999999.5, 1234567.0, 1e-5, 0.0001, 123.456, -1e-10, 1e100, 5e-324 * 1e10] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 14) for _ in range(3000)]
    got = six_digits(spark, rows)
    assert [g for g, r in zip(got, rows, strict=True) if g != f"{r:.6g}"] == []
    assert six_digits(spark, [None, None])[:1] == [""]
    odd = [float("nan"), float("inf"), float("-inf"), 999999.5, 9999995.0, 8209425.0, 8209435.0]
    assert six_digits(spark, odd) == [f"{x:.6g}" for x in odd]


def test_tolerance_is_strict(spark):
    rows = [(0.05, 0.0), (0.051, 0.0), (None, 1.0), (105.0, 100.0), (105.1, 100.0)]
    assert values(spark, rows, "a double, e double", C.differs("a", "e", 0.05)) == [False, True, False, False, True]


CASES = [
    ({"download_status": "error"}, "download_status_not_success"),
    ({"sic": None}, "sic_missing_or_invalid"),
    ({"entity_type": "other"}, "entity_type_not_operating"),
    ({"sic": "6770"}, "sic_6770_or_blank_check_keyword"),
    ({"name_from_sec": "Aerospace Works"}, "sic_6770_or_blank_check_keyword"),
    ({"sic": "6798"}, "sic_6798_or_reit_keyword"),
    ({"sic": "6722"}, "fund_etf_trust_keyword_or_sic"),
    ({"sic": "6500"}, "sic_6000_6799"),
    ({"sic": "4911"}, "sic_4900_4999"),
    ({"sic": "7372"}, "technology_sic_range_or_keyword"),
    ({"sic": "3990", "sic_description": "Electronic toys"}, "technology_sic_range_or_keyword"),
    ({"sic": "5411"}, "sic_5200_5999"),
    ({"sic": "2834"}, "sic_2000_3999_non_technology"),
    ({"sic": "8050"}, "extended_candidate_healthcare_services"),
    ({"sic": "7500"}, "extended_candidate_services"),
    ({"sic": "1300"}, "extended_candidate_energy_mining"),
    ({"sic": "1850"}, "not_in_target_research_sectors"),
    ({"sic": "9100"}, "not_in_target_research_sectors"),
]


def company(i=1, **changes):
    row = dict.fromkeys(schemas.METADATA, "") | {"cik": i, "cik10": str(i), "name_from_ticker_map": "Map", "name_from_sec": "Sec", "entity_type": "operating", "sic": "3990", "sic_description": "goods", "fiscal_year_end": "930", "tickers": " ;AB", "download_status": "success"}
    row |= changes
    return tuple(row[c] for c in schemas.METADATA)


def metadata(spark, rows):
    return spark.createDataFrame(rows, "cik long, " + ", ".join(f"{c} string" for c in schemas.METADATA[1:]))


def test_classification_order(spark):
    rows = [company(i, **changes) for i, (changes, _) in enumerate(CASES)]
    got = {r["cik"]: r for r in classify.classify(metadata(spark, rows)).collect()}
    assert [got[i]["classification_rule"] for i in range(len(CASES))] == [rule for _, rule in CASES]
    assert got[16]["sic_major_group"] == "Unknown" and got[17]["sic_major_group"] == "Public_Administration_Or_Nonclassifiable"
    assert got[0]["fiscal_year_end"] == "0930" and got[0]["cik10"] == "0000000000"


def test_universe_gap_and_summary(spark):
    rows = [company(1), company(2, entity_type=None), company(3, sic="6500"), company(4, name_from_sec="", tickers=None)]
    companies = classify.normalized(classify.classify(metadata(spark, rows)))
    universe = classify.universe(companies).collect()
    assert [(r["research_universe_id"], r["cik"], r["company_name"], r["primary_ticker"]) for r in universe] == [(1, 4, "Map", ""), (2, 1, "Sec", "AB")]
    assert [r["cik"] for r in classify.excluded(companies).collect()] == [3]
    totals = dict(map(tuple, classify.universe_summary(companies).collect()))
    assert totals["input_rows"] == 4 and totals["research_universe_rows"] == 2 and totals["excluded_or_out_of_scope_rows"] == 2
    assert totals["missing_primary_ticker_in_research_universe"] == 1 and totals["primary_exchange_count__missing"] == 2
    compat = classify.normalized(classify.classify(metadata(spark, rows), compat_nan=True))
    assert compat.where("classification_rule = 'entity_type_not_operating'").count() == 1


def test_rules_and_scope():
    rules = config.read_rules()
    assert len(rules) == 61 and config.variables_of(rules) == schemas.VARIABLES
    with pytest.raises(ValueError):
        config.parse_rules({"assets": {"first": []}})
    with pytest.raises(ValueError):
        config.parse_rules({"unheard_of": {}})
    assert config.parse_rules({"assets": 5, "cash": {"tier_1": [{"namespace": "a", "tag": "b"}, 7]}}, strict=False)[0].tag == "b"
    with pytest.raises(ValueError, match="must reach"):
        config.parse_scope({"dataset": {"end_year": 2023}, "target": {"horizon_years": 1}, "splits": {"test_years": [2023]}})
    assert config.parse_scope(None) == config.Scope(horizon_years=0)
    assert config.read_scope("/no/such/file") == config.Scope()


def test_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([("0001", 'a "b", c\nd', None), ("0002", "NA", "x")], "cik10 string, name string, note string")
    tables.write_csv(df, str(tmp_path / "t"), single_file=True)
    back = tables.read_csv(spark, str(tmp_path / "t"), ["cik10", "name", "note"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert tables.read_csv(spark, str(tmp_path / "t"), ["name"], compat_missing=True).where("name is null").count() == 1
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t"), ["nope"])
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none"), ["a"], hint="make it first")
    assert tables.read_optional(spark, str(tmp_path / "none"), ["a"]).count() == 0
    assert [r[0] for r in tables.wanted_keys(spark.createDataFrame([("2",), ("CIK1",), ("",), ("2",)], "cik10 string")).collect()] == ["0000000001", "0000000002"]


def test_ticker_map_and_metadata(spark):
    landed = spark.createDataFrame([('{"0":{"cik_str":5,"ticker":" ab ","title":"A"},"1":{"cik_str":5,"ticker":"AB","title":"B"},"2":{"cik_str":6,"ticker":"c","title":"C"}}',)], "text string")
    tickers = tables.ticker_map(landed, "now")
    assert [(r["ticker"], r["cik10"], r["name"]) for r in tickers.collect()] == [("AB", "0000000005", "A"), ("C", "0000000006", "C")]
    companies = tables.unique_companies(tickers)
    documents = spark.createDataFrame([("0000000005", '{"name":"N","sic":"100","tickers":["X",null,"Y"]}', "u", "p", None)], "cik10 string, text string, source_url string, cache_path string, error_message string")
    rows = {r["cik10"]: r for r in tables.metadata(companies, documents, "now").collect()}
    assert (rows["0000000005"]["tickers"], rows["0000000005"]["download_status"]) == ("X;Y", "success")
    assert rows["0000000006"]["download_status"] == "error" and rows["0000000006"]["error_message"]


def test_landing(tmp_path):
    pauses, calls = [], []

    def opener(url):
        calls.append(url)
        if url.endswith("2") and calls.count(url) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        if url.endswith("3"):
            raise urllib.error.HTTPError(url, 404, "none", None, None)
        return b'{"a": 1}'

    done = landing.land(["1", "2", "3"], lambda k: f"x/{k}", tmp_path, opener, sleep=pauses.append)
    assert (done.fetched, done.skipped, done.missing, done.errors) == (2, 0, ["3"], {})
    assert pauses == [0.1, 1.0, 2.0, 0.1, 0.1]
    assert landing.land(["1"], str, tmp_path, opener, sleep=pauses.append).skipped == 1
    (tmp_path / "0000000007.json").write_text("{}")
    assert landing.rename_plain(tmp_path) == 1 and landing.landed_keys(tmp_path) == ["0000000007"]


def test_texts_without_a_number_reach_no_cast(spark):
    """What isn't a number is null before it is cast, as a cast that fails is an exception within."""
    seen = spark.createDataFrame([("",), (" ",), ("x",), ("7.0 ",), (None,)], "t string").select("t", C._within_spaces("t", C.INTEGER).alias("i"), C.integer("t").alias("n"))
    assert [(r.i, r.n) for r in seen.collect()] == [(None, None), (None, None), (None, None), ("7", 7), (None, None)]
