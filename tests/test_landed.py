"""Readers of landed files, the sinks beside them, and what settles a route."""

import json

from pyspark.sql import functions as F

from marlstone.functions import language
from marlstone.sources import landed


def fact(value, accession="a", metric="revenue"):
    return {"ticker": "MILL", "metric": metric, "concept": "c", "unit": "USD", "value": value, "period_type": "duration", "period_start": "2016-04-01", "period_end": "2017-03-31", "fiscal_year": 2017, "fiscal_period": "FY", "form": "10-K", "accession": accession, "filed": "2017-05-24", "fact_id": "x"}


def test_fact_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([fact(3.0), fact(4.0, "b")]))
    (tmp_path / "a.json").write_text(json.dumps([fact(1.0), fact(2.0)], indent=1))
    got = landed.facts(spark, str(tmp_path))
    assert sorted((r["accession"], r["value"], str(r["filed"])) for r in got.collect()) == [("a", 1.0, "2017-05-24"), ("b", 4.0, "2017-05-24")]
    assert "fact_id" not in got.columns and "ord" not in got.columns


def test_company_files(spark, tmp_path):
    (tmp_path / "MILL.json").write_text('{"facts": {}}')
    assert [tuple(r) for r in landed.payloads(spark, f"{tmp_path}/*.json").collect()] == [("MILL", '{"facts": {}}')]
    (tmp_path / "MILL_0001-17.html").write_text("<p>x</p>\n<p>y</p>")
    assert [tuple(r) for r in landed.documents(spark, f"{tmp_path}/*.html").collect()] == [("MILL", "0001-17", "<p>x</p>\n<p>y</p>")]


def test_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,ticker,adj_close\n2024-01-02,A,1.5\n2024-01-03,A,\n")
    assert [(str(r["date"])[:10], r["adj_close"]) for r in landed.prices(spark, f"{tmp_path}/p.csv").collect()] == [("2024-01-02", 1.5)]
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1704205800, 1704292200], "indicators": {"adjclose": [{"adjclose": [1.23456789, None]}]}}]}}
    (tmp_path / "c.json").write_text(json.dumps(chart, indent=1))
    assert [(str(r["date"])[:10], r["ticker"], r["adj_close"]) for r in landed.chart_prices(spark, f"{tmp_path}/c.json").collect()] == [("2024-01-02", "A", 1.234568)]


def test_passages_and_records(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"ticker": "A", "passage_id": str(i), "text": f"t{i}"}) for i in range(3)))
    got = landed.passages(spark, f"{tmp_path}/p.jsonl").orderBy("doc").collect()
    assert [(r["scope"], r["passage_id"]) for r in got] == [("A", "0"), ("A", "1"), ("A", "2")]
    rows = spark.createDataFrame([("2024-01-02 03:04:05", "why?", 3)], "ts string, question string, n int").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):
        landed.append_records(rows, f"{tmp_path}/audit")
    back = spark.read.json(f"{tmp_path}/audit")
    assert back.count() == 2 and back.first()["question_sha256"] == rows.select(landed.question_digest(F.col("question"))).first()[0]


def test_a_new_version_misses_the_cache(spark):
    df = spark.createDataFrame([(1, "q", None), (2, "q", None), (1, "q", ""), (1, "q", None)], "v int, q string, d string")
    keys = [r[0] for r in df.select(landed.cache_key(F.col("v"), F.col("q"), F.col("d"))).collect()]
    assert keys[0] == keys[3] and len(set(keys)) == 3


def test_fixtures(spark, tmp_path):
    row = {"start": "2018-04-01", "end": "2019-03-31", "val": 5, "accn": "M-5", "fy": 2019, "fp": "FY", "form": "10-K", "filed": "2019-05-20"}
    old = row | {"start": "2017-04-01", "end": "2018-03-31", "accn": "M-4", "fy": 2018, "filed": "2018-05-20"}
    body = json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": [old, row]}}}}})
    landed.write_fixture(spark.createDataFrame([("MILL", body)], "ticker string, json string"), f"{tmp_path}/f")
    assert [(r["fiscal_year"], r["value"]) for r in spark.read.json(f"{tmp_path}/f").collect()] == [(2019, 5.0)]


def test_a_route_is_settled(spark):
    df = spark.createDataFrame([(["market_risk", "pretrade_check"], ["A", "Z", "B", "C"]), (["market_risk"], [])], "tools array<string>, tickers array<string>")
    got = [r[0] for r in df.select(language.settle(F.col("tools"), F.col("tickers"), ["A", "B", "C"])).collect()]
    assert (got[0]["tools"], got[0]["tickers"], got[0]["weights"]) == (["pretrade_check"], ["A", "B", "C"], [0.333333] * 3)
    assert (got[1]["tools"], got[1]["weights"]) == (["market_risk"], [])
