import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import evidence, normalize, pit

SALES, EARNED = "SalesRevenueNet", "NetIncomeLoss"
#: Filings of an invented mill, whose year ends in March: accession, filed on, its fiscal year.
FIRST, SECOND, THIRD = ("M-1", "2015-05-20", 2015), ("M-2", "2016-05-18", 2016), ("M-3", "2017-05-24", 2017)


def year(y):
    return f"{y - 1}-04-01", f"{y}-03-31"


def entry(filing, value, span):
    accession, filed, fiscal = filing
    start, end = span
    return {"val": value, "end": end, "accn": accession, "filed": filed, "fy": fiscal, "fp": "FY", "form": "10-K"} | ({"start": start} if start else {})


def payload(concepts):
    return json.dumps({"facts": {"us-gaap": {c: {"units": {"USD": rows}} for c, rows in concepts.items()}}})


MILL = {
    SALES: [entry(FIRST, 640, year(2015)), entry(FIRST, 600, year(2014)), entry(SECOND, 655, year(2015)), entry(SECOND, 700, year(2016)), entry(THIRD, 700, year(2016)), entry(THIRD, 777, year(2017)), entry(THIRD, 210, ("2017-01-01", "2017-03-31")), entry(THIRD, 590, ("2016-04-01", "2016-12-31"))],
    EARNED: [entry(FIRST, 64, year(2015)), entry(SECOND, -35, year(2016)), entry(THIRD, 42, year(2017))],
    "Assets": [entry(THIRD, 9100, (None, "2017-03-31"))],
}


@pytest.fixture(scope="module")
def store(spark):
    return normalize.normalize(spark.createDataFrame([("MILL", payload(MILL))], "ticker string, json string")).cache()


def value(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return sorted(r["value"] for r in df.collect())


def test_normalizer(store):
    sales = store.where("metric = 'revenue'")
    got = sorted((r["accession"], r["fiscal_period"], r["fiscal_year"], r["value"]) for r in sales.collect())
    assert got == [("M-1", "FY", 2015, 640.0), ("M-2", "FY", 2015, 655.0), ("M-2", "FY", 2016, 700.0), ("M-3", "FY", 2016, 700.0), ("M-3", "FY", 2017, 777.0), ("M-3", "Q4", 2017, 210.0)]
    (assets,) = store.where("metric = 'total_assets'").collect()
    assert (assets["period_start"], assets["period_type"], assets["value"]) == (None, "instant", 9100.0)


@pytest.mark.parametrize(("days", "kind"), [(349, None), (350, "annual"), (380, "annual"), (381, None), (79, None), (80, "quarter"), (100, "quarter"), (101, None)])
def test_duration_bounds(spark, days, kind):
    end = dt.date(2020, 1, 1) + dt.timedelta(days)
    df = spark.createDataFrame([(dt.date(2020, 1, 1), end)], "a date, b date")
    assert df.select(normalize.duration_class(F.col("a"), F.col("b"))).first()[0] == kind


def test_the_earlier_alias_wins_within_a_filing(spark):
    both = {"Revenues": [entry(SECOND, 5, year(2016))], SALES: [entry(SECOND, 6, year(2016)), entry(THIRD, 7, year(2016))]}
    got = normalize.normalize(spark.createDataFrame([("T", payload(both))], "ticker string, json string"))
    assert sorted((r["accession"], r["value"]) for r in got.where("metric = 'revenue'").collect()) == [("M-2", 5.0), ("M-3", 7.0)]


@pytest.mark.parametrize(("as_of", "known"), [("2015-05-19", None), ("2015-05-20", 640.0), ("2016-05-17", 640.0), ("2016-05-18", 655.0), (None, 655.0)])
def test_what_was_known_on_a_day(store, as_of, known):
    assert value(pit.latest(store, as_of), metric="revenue", fiscal_year=2015) == ([] if known is None else [known])


def test_restatements_and_the_latest_year(store):
    (changed,) = pit.restatements(store).collect()
    assert (changed["metric"], changed["fiscal_year"], changed["first_value"], changed["last_value"], changed["n_versions"]) == ("revenue", 2015, 640.0, 655.0, 2)
    assert [pit.latest_fiscal_year(store, d).first()["fiscal_year"] for d in ("2015-12-31", "2016-12-31", None)] == [2015, 2016, 2017]


def test_ties_missing_years_and_zero(spark):
    cols = "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, filed date, value double"
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("T", "revenue", 2020, "FY", "a", d, 1.0), ("T", "revenue", 2020, "FY", "b", d, 2.0), ("T", "revenue", 2022, "FY", "c", d, 4.0), ("T", "revenue", 2023, "FY", "d", d, 0.0), ("T", "net_income", 2023, "FY", "e", d, 4.0), ("T", "revenue", 2024, "FY", "f", d, 5.0)], cols)
    assert value(pit.latest(df), fiscal_year=2020, metric="revenue") == [2.0]
    assert {r["fiscal_year"]: r["value"] for r in pit.growth(df, "revenue").collect()} == {2023: -1.0}
    assert pit.ratio(df, "net_margin").count() == 0


def test_derived(store):
    margins = {r["fiscal_year"]: (round(r["value"], 6), [x.split(":")[1] for x in r["inputs"]]) for r in pit.ratio(store, "net_margin").collect()}
    assert margins == {2015: (round(64 / 655, 6), ["net_income", "revenue"]), 2016: (-0.05, ["net_income", "revenue"]), 2017: (round(42 / 777, 6), ["net_income", "revenue"])}
    assert pit.ratio(store, "debt_to_equity").count() == 0
    growth = {r["fiscal_year"]: round(r["value"], 6) for r in pit.growth(store, "revenue").collect()}
    assert growth == {2016: round(700 / 655 - 1, 6), 2017: 0.11}
    assert [(r["fiscal_year"], r["value"], r["formula"]) for r in pit.implied_q4(store).collect()] == [(2017, 210.0, "reported")]


def test_gross_margin_and_leverage(spark):
    cols = "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, filed date, value double"
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("T", m, 2020, "FY", "a", d, v) for m, v in (("gross_profit", 30.0), ("revenue", 120.0), ("long_term_debt", 50.0), ("stockholders_equity", -20.0))], cols)
    assert [r["value"] for n in ("gross_margin", "debt_to_equity") for r in pit.ratio(df, n).collect()] == [0.25, -2.5]


def test_upsert(store):
    once = pit.upsert(None, store.withColumn("ord", F.lit(1)))
    again = pit.upsert(once, store.withColumn("ord", F.lit(1)).withColumn("value", F.lit(7.0)))
    assert again.count() == once.count() and value(again.select("value").distinct()) == [7.0]


def test_submissions(spark):
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-K", "8-K", "10-Q"], "filingDate": ["a", "b", "c"], "reportDate": ["a", "b", "c"], "acceptanceDateTime": ["a", "b", "c"], "primaryDocument": ["x", "y"]}
    df = spark.createDataFrame([("T", json.dumps({"filings": {"recent": recent}}))], "ticker string, json string")
    assert [r["accessionNumber"] for r in normalize.recent_filings(df).collect()] == ["1"]


def test_evidence_merge_keeps_last_write_and_first_place(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("a", 3, 3.0)], "id string, seq int, value double")
    assert [tuple(r) for r in evidence.merge(df).orderBy("seq").collect()] == [("a", 1, 3.0), ("b", 2, 2.0)]


def test_upsert_latest_replaces_rows(spark, sf, monkeypatch):
    from marlstone.plans import facts as plans
    from marlstone.sources.tables import facts

    seen, upsert = [], pit.upsert
    monkeypatch.setattr(pit, "upsert", lambda old, batch: seen.extend((old.count(), batch.count())) or upsert(old, batch))
    n = plans.upsert_latest(spark, sf).agg(F.sum("n")).collect()[0][0]
    total = facts(spark, sf).count()
    assert 0 < seen[0] < total and 0 < seen[1] < total and sum(seen) > total == n
