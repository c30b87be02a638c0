import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import risk

DAY = dt.datetime(2024, 1, 1)


def pnl(spark, xs, portfolio=1):
    return spark.createDataFrame([(portfolio, DAY + dt.timedelta(i), float(x)) for i, x in enumerate(xs)], "portfolio_id int, date timestamp, pnl double")


@pytest.mark.parametrize(("n", "c", "k"), [(1000, 0.99, 10), (1000, 0.95, 50), (10, 0.99, 1)])
def test_tail_count(spark, n, c, k):
    assert spark.range(1).select(risk.tail_count(F.lit(n), c)).first()[0] == k


def test_historical(spark):
    r = risk.historical_var(pnl(spark, -np.arange(1, 1001) / 1000)).first()
    assert r["var"] == pytest.approx(0.991) and r["es"] == pytest.approx(0.9955)


def test_parametric(spark):
    x = [0.01, -0.01, 0.01, -0.01]
    assert risk.parametric_var(pnl(spark, x)).first()["var"] == pytest.approx(np.std(x, ddof=1) * 2.3263478740408408)
    assert risk.parametric_var(pnl(spark, [0.01])).count() == 0


def test_gap_takes_two_dates(spark):
    rows = [(DAY + dt.timedelta(i), t, 100.0 + i) for i in range(6) for t in "XY" if not (t == "Y" and i == 2)]
    got = risk.log_returns(spark.createDataFrame(rows, "date timestamp, ticker string, adj_close double")).select("date").distinct().orderBy("date").collect()
    assert [(r["date"] - DAY).days for r in got] == [1, 4, 5]
    with pytest.raises(KeyError):
        risk.require_prices(spark.createDataFrame(rows, "date timestamp, ticker string, adj_close double"), ["X", "Z"])


def test_rolling_matches_numpy(spark):
    x = np.random.default_rng(1).standard_t(4, 400) * 0.01
    got = risk.rolling_var(pnl(spark, x), 250).orderBy("date").toPandas()
    assert len(got) == 150
    assert np.allclose(got["var"], [-np.sort(x[t - 250 : t])[2] for t in range(250, 400)], atol=1e-15)


def test_backtest_counts_strictly(spark):
    flat = [-0.01] * 300
    for xs, n in ((flat, 0), ([*flat[:-1], -0.5], 1)):
        k = risk.kupiec(risk.rolling_var(pnl(spark, xs), 250)).first()
        assert (k["observations"], k["exceptions"]) == (50, n)
    assert risk.kupiec_p(3.841458820694124) == pytest.approx(0.05)


def test_monte_carlo(spark):
    mu, cov, w = np.zeros(2), np.array([[1e-4, 2e-5], [2e-5, 1e-4]]), np.array([0.5, 0.5])
    one, eight = (risk.monte_carlo(spark, mu, cov, w, 20_000, 1, 0, n_partitions=n).first() for n in (1, 8))
    assert one == eight
    assert one["var"] == pytest.approx(2.3263 * math.sqrt(w @ cov @ w), rel=0.05)
    with pytest.raises(np.linalg.LinAlgError):
        risk.monte_carlo(spark, mu, np.array([[1.0, 2.0], [2.0, 1.0]]), w)
    with pytest.raises(ValueError):
        risk.monte_carlo(spark, mu, cov, w, dof=2)


def test_limits(spark):
    rows = [(1, i, 0.2, f"s{i % 2}") for i in range(5)] + [(2, 1, 1.0, "s1")] + [(3, i, 0.2, "s0") for i in range(3)] + [(3, 9, 0.2, "s1")]
    got = {r["portfolio_id"]: r["decision"] for r in risk.limit_checks(spark.createDataFrame(rows, "portfolio_id int, name int, weight double, sector string")).collect()}
    assert got == {1: "APPROVE", 2: "REJECT", 3: "APPROVE"}


def market(spark, days=700, seed=3):
    r = np.random.default_rng(seed)
    x = r.multivariate_normal([0, 0, 0], [[1e-4, 5e-5, 0], [5e-5, 2e-4, 0], [0, 0, 5e-5]], days)
    rows = [(DAY + dt.timedelta(i), t, float(x[i, j])) for i in range(days) for j, t in enumerate("ABC")]
    return x, spark.createDataFrame(rows, "date timestamp_ntz, ticker string, ret double").cache()


def test_report_of_two_portfolios(spark):
    x, returns = market(spark)
    w = {1: np.array([0.5, 0.3, 0.2]), 2: np.array([0.0, -0.5, 1.5])}
    weights = spark.createDataFrame([(p, t, float(v)) for p, ws in w.items() for t, v in zip("ABC", ws)], "portfolio_id int, ticker string, weight double")
    got = {r["portfolio_id"]: r for r in risk.portfolio_risk(returns, weights, paths=20_000).collect()}
    est = x[-500:]
    for p, ws in w.items():
        pnl, r = est @ ws, got[p]
        assert r["hist_var"] == pytest.approx(-np.sort(pnl)[4]) and r["hist_es"] == pytest.approx(-np.sort(pnl)[:5].mean())
        assert r["param_var"] == pytest.approx(2.3263478740408408 * pnl.std(ddof=1) - pnl.mean())
        part = ws * (np.cov(est, rowvar=False) @ ws)
        assert [q["share"] for q in r["positions"]] == pytest.approx(list(part / part.sum()))
        assert [q["vol"] for q in r["positions"]] == pytest.approx(list(est.std(axis=0, ddof=1) * math.sqrt(252)))
        assert r["observations"] == 450 and r["risk_id"].startswith("risk:") and r["calibrated"] == (r["p_value"] >= 0.05)
        assert 2 * r["hist_var"] < r["mc_var"] < 5 * r["hist_var"]  # ten days
    assert got[1]["risk_id"] != got[2]["risk_id"]
    said = {r["portfolio_id"]: r["findings"] for r in risk.risk_findings(risk.portfolio_risk(returns, weights, paths=5000)).collect()}
    assert len(said[1]) == 4 and said[1][2].startswith("A contributes 53.5%") and said[2][0].startswith("As of 2025-11-30, the portfolio's 1-day 99% historical VaR")
    with pytest.raises(ValueError):
        risk.portfolio_risk(returns, weights, window=680)
    with pytest.raises(ValueError):
        risk.portfolio_risk(returns, weights, confidence=0.4)


def test_covariances_and_moments(spark):
    x, returns = market(spark, 60)
    order, mu, cov = risk.estimate(returns)
    assert order == list("ABC") and np.allclose(mu, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))


def test_the_tail_of_many_outcomes(spark):
    x = np.random.default_rng(5).standard_normal(60_000).round(2)  # many ties
    r = risk.historical_var(pnl(spark, x), 0.995).first()
    assert (r["n"], r["var"], r["es"]) == (60_000, pytest.approx(-np.sort(x)[299]), pytest.approx(-np.sort(x)[:300].mean()))


def test_var_limit_rows_and_findings(spark):
    positions = spark.createDataFrame([(1, "A", 0.3, "s"), (1, "B", 0.3, "t"), (2, "A", 0.8, "s"), (2, "C", -0.3, "s")], "portfolio_id int, name string, weight double, sector string")
    var = spark.createDataFrame([(1, 0.01), (2, 0.05)], "portfolio_id int, var double")
    banned = spark.createDataFrame([("C",)], "name string")
    checks = {r["portfolio_id"]: tuple(r)[1:] for r in risk.limit_checks(positions, var, banned).collect()}
    assert checks == {1: (6, 0, 0, "APPROVE"), 2: (5, 4, 1, "REJECT")}
    rows = risk.limit_rows(positions, var)
    assert {(r["portfolio_id"], r["name"]) for r in rows.where("not passed").collect()} == {(2, "single-name weight A"), (2, "sector weight s"), (2, "gross exposure"), (2, "1-day 99% historical VaR")}
    names = spark.createDataFrame([(2, ["C"])], "portfolio_id int, restricted array<string>")
    said = {r["portfolio_id"]: r["findings"] for r in risk.limit_findings(rows, risk.limit_checks(positions, var, banned), names).collect()}
    assert said[1] == ["Pre-trade decision: APPROVE.", "All 6 limits pass, including 1-day 99% VaR of 1.00% against 4.00% [limit:summary] [limit:1-day_99%_historical_VaR]."]
    assert said[2][0] == "Pre-trade decision: REJECT." and said[2][1] == "Breach: 1-day 99% historical VaR is 5.0% against a limit of 4.0% [limit:1-day_99%_historical_VaR]." and said[2][-1] == "Restricted list: C." and len(said[2]) == 6


def test_requests_out_of_bounds(spark):
    for paths, horizon in ((999, 10), (2_000_001, 10), (True, 10), (1000.0, 10), (1000, 0), (1000, 61)):
        with pytest.raises(ValueError):
            risk.require_request(paths, horizon)
    risk.require_request(1000, 1), risk.require_request(2_000_000, 60)
    many = [(9, f"T{i}", 0.01) for i in range(21)]
    rows = [(1, "A", 1.0), (1, "B", -1.0), (2, "A", 1.01), (3, "", 0.1), (4, None, 0.1), (5, "A", None), (6, "A", math.nan), (7, "A" * 11, -2.0), *many, *[(8, t, w) for _, t, w in many[:20]]]
    df = spark.createDataFrame(rows, "portfolio_id int, ticker string, weight double")
    got = sorted((x["portfolio_id"], x["reason"]) for x in risk.bad_positions(df).collect())
    assert got == [(2, "weight"), (3, "ticker"), (4, "ticker"), (5, "weight"), (6, "weight"), (7, "ticker"), (7, "weight"), (9, "more than 20 positions")]
    assert risk.bad_positions(df.where("false")).count() == 0
    good = spark.createDataFrame([(1, " aapl ", 0.5)], df.schema)
    assert [tuple(x) for x in risk.checked_positions(good).collect()] == [(1, "AAPL", 0.5)]
    for p in (2, 3, 4, 5, 6, 7):
        with pytest.raises(Exception, match=f"out of bounds in portfolio {p}"):
            risk.checked_positions(df.where(F.col("portfolio_id") == p)).collect()
    with pytest.raises(ValueError, match="portfolio"):
        risk.requested_risk(None, df)
    with pytest.raises(ValueError, match="horizon"):
        risk.requested_risk(None, good, horizon=90)


@pytest.mark.parametrize("kind", ["normal", "ties", "shifted", "signs", "tiny"])
def test_two_step_selection_equals_a_sort(spark, kind):
    """One portfolio has most rows; ties, values of one range only, both signs, zeros, infinities and nulls."""
    r = np.random.default_rng(5)
    x = {"normal": r.standard_normal(9000) * 0.01, "ties": r.integers(-3, 4, 9000) / 4, "shifted": 1000 + r.random(9000), "signs": np.concatenate([[-np.inf, np.inf, 0.0, -0.0], r.standard_cauchy(8996)]), "tiny": r.standard_normal(9000) * 1e-308}[kind]
    owner = np.where(np.arange(9000) % 9 < 7, 1, 2 + np.arange(9000) % 3)
    rows = [(int(o), i, float(v)) for i, (o, v) in enumerate(zip(owner, x))] + [(1, -1, None), (99, -2, None)]
    df = spark.createDataFrame(rows, "portfolio_id int, date long, pnl double").repartition(5)
    for confidence in (0.99, 0.7, 0.5001):
        got = {v["portfolio_id"]: v for v in risk.historical_var(df, confidence).collect()}
        assert set(got) == set(owner.tolist())
        for o, v in got.items():
            low = np.sort(x[owner == o])
            k = max(1, math.ceil((1 - confidence) * len(low) - 1e-9))
            assert v["n"] == len(low) and v["var"] == -low[k - 1] and v["es"] == pytest.approx(-low[:k].mean(), rel=1e-9)
    assert risk.historical_var(df.where("false")).count() == 0


def test_portfolios_from_a_table_equal_those_of_a_matrix(spark, monkeypatch):
    """Any cut into blocks of portfolios and ranges of paths; k above a block; repeated, unknown and missing tickers."""
    mu, cov = np.array([1e-4, 0.0, 2e-4]), np.array([[1e-4, 2e-5, 0], [2e-5, 2e-4, 0], [0, 0, 5e-5]])
    book = np.random.default_rng(2).normal(0, 0.3, (41, 3))
    book[7] = 0
    rows = [(i, t, float(v)) for i, w in enumerate(book) for t, v in zip("ABC", w) if i != 7] + [(7, "unknown", 1.0)]
    rows += [(3, "A", 0.25), (3, "A", -0.25)]
    weights = spark.createDataFrame(rows, "portfolio_id long, ticker string, weight double")
    want = {v["row"]: v for v in risk.monte_carlo(spark, mu, cov, book, 20_000, 2, confidence=0.9, block=512, n_partitions=1).collect()}
    assert len(want) == 41 and want[7]["var"] == 0
    for books, tasks in ((128, 1), (10, 1), (10, 16), (128, 50)):
        monkeypatch.setattr(risk, "BOOKS", books)
        got = {v["portfolio_id"]: v for v in risk.monte_carlo_books(weights, list("ABC"), mu, cov, 20_000, 2, confidence=0.9, block=512, n_partitions=tasks).collect()}
        assert got.keys() == want.keys()
        for i in got:
            assert (got[i]["n"], got[i]["var"], got[i]["es"]) == pytest.approx((20_000, want[i]["var"], want[i]["es"]), rel=1e-9)
