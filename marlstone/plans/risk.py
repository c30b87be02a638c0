"""Queries of the risk engine: hourly event means as prices, order contents as portfolios."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import evidence, risk
from marlstone.sources.tables import POSITIONS_SQL, PRICES_SQL, positions, prices, stored, table

WINDOW, BACK, CONF = 300, 250, 0.99
AS_OF = "2024-01-20"
#: Three fixed portfolios over the event types, in order of their names.
WEIGHTS = {1: [0.2, 0.2, 0.2, 0.2, 0.2], 2: [0.5, 0.3, 0.1, 0.1, 0.0], 3: [0.0, 0.0, 0.4, 0.4, 0.2]}
_VALUES = ", ".join(f"({p}, {i + 1}, {w}::DOUBLE)" for p, ws in WEIGHTS.items() for i, w in enumerate(ws))

_RET = f"""{PRICES_SQL},
cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM prices)),
one AS (SELECT p.date, p.ticker, ln(adj_close) - ln(lag(adj_close) OVER w) AS ret, lag(p.date) OVER w AS p_date, before FROM prices p JOIN cal ON p.date = cal.date WINDOW w AS (PARTITION BY ticker ORDER BY p.date)),
ok AS (SELECT * FROM one WHERE p_date = before),
ret AS (SELECT date, ticker, ret FROM ok WHERE date IN (SELECT date FROM ok GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM prices)))"""
_PNL = f"""{_RET},
names AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM (SELECT DISTINCT ticker FROM prices)),
weights AS (SELECT portfolio_id, ticker, weight FROM (VALUES {_VALUES}) AS v(portfolio_id, i, weight) JOIN names USING (i)),
lastd AS (SELECT DISTINCT date FROM ret ORDER BY date DESC LIMIT {WINDOW}),
retw AS (SELECT * FROM ret WHERE date IN (SELECT date FROM lastd)),
pnl_all AS (SELECT portfolio_id, date, sum(ret * weight) AS pnl FROM ret JOIN weights USING (ticker) GROUP BY 1, 2),
pnl AS (SELECT * FROM pnl_all WHERE date IN (SELECT date FROM lastd))"""
_K = f"greatest(1, least(n, ceil({1 - CONF!r}::DOUBLE * n - 1e-9)))"
_BACK = f"""{_PNL},
win AS (SELECT portfolio_id, date, pnl, count(*) OVER w AS n, list(pnl) OVER w AS xs FROM pnl_all WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)),
back AS (SELECT portfolio_id, date, pnl, -list_sort(xs)[{_K}::INT] AS var FROM win WHERE n = {BACK})"""


def _returns(s, d):
    """The aligned returns, worked out once for all queries over the same data."""
    return stored(s, d, "returns", lambda: risk.log_returns(prices(s, d)))


def _weights(spark, sf_dir):
    rows = [(p, i + 1, w) for p, ws in WEIGHTS.items() for i, w in enumerate(ws)]
    names = prices(spark, sf_dir).select("ticker").distinct().withColumn("i", F.row_number().over(Window.orderBy("ticker")))  # the event types
    return F.broadcast(names.join(spark.createDataFrame(rows, "portfolio_id int, i int, weight double"), "i").drop("i"))  # 15 rows


def _recent(s, d):
    return risk.last_dates(_returns(s, d), WINDOW)


def _pnl(s, d, window=WINDOW):
    return risk.portfolio_pnl(_recent(s, d) if window else _returns(s, d), _weights(s, d))


def _rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def monte_carlo_var(s, d):
    """Ten days of the data's own tickers, with fat tails, for all portfolios."""
    order, mu, cov = risk.estimate(_recent(s, d))
    return risk.monte_carlo(s, mu, cov, np.array([WEIGHTS[p] for p in sorted(WEIGHTS)]))


def _report(s, d):
    return risk.portfolio_risk(_returns(s, d), _weights(s, d), WINDOW, BACK, CONF)


def portfolio_risk(s, d):
    """The report without its simulated part."""
    got = _rounded(_report(s, d), "hist_var", "hist_es", "param_var", "param_es")
    top = F.array_max(F.transform("positions", lambda p: F.struct(F.round(p["share"], 6).alias("share"), p["ticker"].alias("ticker"))))
    return got.select("portfolio_id", "as_of", "hist_var", "hist_es", "param_var", "param_es", "observations", "exceptions", "expected", "calibrated", top["ticker"].alias("top"), top["share"].alias("top_share"))


def _plain_report(s, d):
    """The report with ids that name the portfolio, and figures of six places."""
    got = _rounded(_report(s, d), "hist_var", "hist_es").withColumn("risk_id", F.concat(F.lit("risk:"), F.col("portfolio_id").cast("string")))
    return got.withColumn("positions", F.transform("positions", lambda p: p.withField("share", F.round(p["share"], 6) + 0.0)))


def risk_sentences(s, d):
    """The findings but for the simulated one."""
    said = F.filter("findings", lambda x: ~F.contains(x, F.lit("Monte Carlo")))
    return risk.risk_findings(_plain_report(s, d)).select("portfolio_id", F.posexplode(said).alias("place", "finding"))


def risk_evidence(s, d):
    """Evidence of the reports, a row per value."""
    wide = _plain_report(s, d).select("risk_id", F.col("hist_var").alias("var"), F.col("hist_es").alias("es"), "observations", "exceptions", F.inline("positions"))
    return evidence.risk_evidence(wide).select("id", "label", F.explode("values").alias("key", "value"))


def _named(s, d):
    """The portfolios as positions; each ticker is a sector of its own."""
    return _weights(s, d).where("weight <> 0").select("portfolio_id", F.col("ticker").alias("name"), "weight", F.col("ticker").alias("sector"))


def pretrade_rows(s, d):
    return _rounded(risk.limit_rows(_named(s, d), risk.historical_var(_pnl(s, d), CONF)), "observed")


def pretrade_findings(s, d):
    var = risk.historical_var(_pnl(s, d), CONF)
    got = risk.limit_findings(risk.limit_rows(_named(s, d), var), risk.limit_checks(_named(s, d), var))
    return got.select("portfolio_id", "decision", F.array_join("findings", " ").alias("findings"))


def _restricted(s, d):
    return table(s, d, "supplier").where("s_acctbal < -900").select(F.col("s_suppkey").alias("name"))


def rejected_requests(s, d):
    """Customers as requests: what they bought of a supplier, in units of 100,000, is the supplier's weight."""
    line = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    bought = line.join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = bought.groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").cast("string").alias("ticker"))
    return risk.bad_positions(per.agg(F.round(F.sum("l_extendedprice") / 100_000, 6).cast("double").alias("weight")))


QUERIES = {
    "rejected_requests": rejected_requests,
    "log_returns": lambda s, d: _rounded(_returns(s, d), "ret"),
    "portfolio_pnl": lambda s, d: _rounded(_pnl(s, d), "pnl"),
    "historical_var_es": lambda s, d: _rounded(risk.historical_var(_pnl(s, d)), "var", "es"),
    "parametric_var_es": lambda s, d: _rounded(risk.parametric_var(_pnl(s, d)), "var", "es"),
    "euler_component_var": lambda s, d: _rounded(risk.euler_shares(_recent(s, d), _weights(s, d)).drop("weight"), "share"),
    "annualized_vol": lambda s, d: _rounded(risk.annualized_vol(_recent(s, d), _weights(s, d)), "vol"),
    "moments": lambda s, d: _rounded(risk.moments(_recent(s, d)), "mean", "vol", places=8),
    "covariances": lambda s, d: _rounded(risk.covariances(_recent(s, d)), "cov", places=8),
    "returns_as_of": lambda s, d: _rounded(risk.log_returns(prices(s, d), as_of=AS_OF), "ret"),
    "portfolio_risk": portfolio_risk,
    "risk_findings": lambda s, d: risk.risk_findings(_report(s, d)).select("portfolio_id", F.explode("findings").alias("finding")),
    "risk_sentences": risk_sentences,
    "risk_evidence": risk_evidence,
    "pretrade_rows": pretrade_rows,
    "pretrade_findings": pretrade_findings,
    "rolling_var_backtest": lambda s, d: _rounded(risk.rolling_var(_pnl(s, d, 0), BACK), "pnl", "var"),
    "kupiec_lr": lambda s, d: _rounded(risk.kupiec(risk.rolling_var(_pnl(s, d, 0), BACK)), "lr"),
    "monte_carlo_var": monte_carlo_var,
    "sector_exposure": lambda s, d: _rounded(risk.sector_exposure(positions(s, d)), "exposure"),
    "pretrade_checks": lambda s, d: risk.limit_checks(positions(s, d), restricted=_restricted(s, d)),
    "order_value_var": lambda s, d: _rounded(risk.historical_var(table(s, d, "orders").select(F.col("o_orderpriority").alias("portfolio_id"), F.col("o_orderkey").alias("date"), F.col("o_totalprice").alias("pnl"))), "var", "es", places=2),
}

_Z = NormalDist().inv_cdf(1 - CONF)
_PHI = NormalDist().pdf(_Z)
_HIST = f"r AS (SELECT portfolio_id, pnl, row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl, date) AS rn, count(*) OVER (PARTITION BY portfolio_id) AS n FROM pnl)"
SQL = {
    "rejected_requests": """WITH w AS (SELECT o_custkey AS portfolio_id, l_suppkey AS ticker, round(sum(l_extendedprice) / 100000, 6) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT portfolio_id, 'more than 20 positions' AS reason FROM w GROUP BY 1 HAVING count(*) > 20
UNION ALL SELECT portfolio_id, 'weight' FROM w GROUP BY 1 HAVING bool_or(abs(weight) > 1)""",
    "log_returns": f"WITH {_RET} SELECT date, ticker, round(ret, 6) AS ret FROM ret",
    "portfolio_pnl": f"WITH {_PNL} SELECT portfolio_id, date, round(pnl, 6) AS pnl FROM pnl",
    "historical_var_es": f"WITH {_PNL}, {_HIST} SELECT portfolio_id, max(n) AS n, round(-max(pnl), 6) AS var, round(-avg(pnl), 6) AS es FROM r WHERE rn <= {_K} GROUP BY 1",
    "parametric_var_es": f"WITH {_PNL} SELECT portfolio_id, round(-(avg(pnl) + stddev_samp(pnl) * ({_Z!r}::DOUBLE)), 6) AS var, round(-avg(pnl) + stddev_samp(pnl) * {_PHI!r}::DOUBLE / {1 - CONF!r}::DOUBLE, 6) AS es FROM pnl GROUP BY 1",
    "euler_component_var": f"WITH {_PNL}, c AS (SELECT w.portfolio_id, retw.ticker, any_value(weight) * covar_samp(ret, pnl) AS part FROM retw JOIN weights w USING (ticker) JOIN pnl ON pnl.portfolio_id = w.portfolio_id AND pnl.date = retw.date GROUP BY 1, 2) SELECT portfolio_id, ticker, round(part / sum(part) OVER (PARTITION BY portfolio_id), 6) + 0.0 AS share FROM c",
    "annualized_vol": f"WITH {_PNL} SELECT portfolio_id, ticker, round(stddev_samp(ret) * sqrt(252), 6) AS vol FROM retw JOIN weights USING (ticker) GROUP BY 1, 2",
    "moments": f"WITH {_PNL} SELECT ticker, count(ret) AS n, round(avg(ret), 8) AS mean, round(stddev_samp(ret) * sqrt(252), 8) AS vol FROM retw GROUP BY 1",
    "covariances": f"WITH {_PNL} SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret), 8) AS cov FROM retw x JOIN retw y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2",
    "returns_as_of": f"WITH {_RET.replace('FROM events WHERE value > 0', f"FROM events WHERE value > 0 AND date_trunc('hour', ts) < DATE '{AS_OF}' + INTERVAL 1 DAY")} SELECT date, ticker, round(ret, 6) AS ret FROM ret",
    "portfolio_risk": f"""WITH {_BACK}, {_HIST},
h AS (SELECT portfolio_id, round(-max(pnl), 6) AS hist_var, round(-avg(pnl), 6) AS hist_es FROM r WHERE rn <= {_K} GROUP BY 1),
p AS (SELECT portfolio_id, round(-(avg(pnl) + stddev_samp(pnl) * ({_Z!r}::DOUBLE)), 6) AS param_var, round(-avg(pnl) + stddev_samp(pnl) * {_PHI!r}::DOUBLE / {1 - CONF!r}::DOUBLE, 6) AS param_es FROM pnl GROUP BY 1),
recent AS (SELECT DISTINCT date FROM ret ORDER BY date DESC LIMIT {WINDOW + BACK}),
pnl_r AS (SELECT * FROM pnl_all WHERE date IN (SELECT date FROM recent)),
win_r AS (SELECT portfolio_id, pnl, count(*) OVER w AS n, list(pnl) OVER w AS xs FROM pnl_r WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)),
k AS (SELECT portfolio_id, count(*) AS n, count(*) FILTER (WHERE pnl < list_sort(xs)[{_K}::INT]) AS x FROM win_r WHERE n = {BACK} GROUP BY 1),
c AS (SELECT w.portfolio_id, retw.ticker, any_value(weight) * covar_samp(ret, pnl) AS part FROM retw JOIN weights w USING (ticker) JOIN pnl ON pnl.portfolio_id = w.portfolio_id AND pnl.date = retw.date GROUP BY 1, 2),
e AS (SELECT portfolio_id, ticker, round(part / sum(part) OVER (PARTITION BY portfolio_id), 6) + 0.0 AS share FROM c),
t AS (SELECT portfolio_id, ticker AS top, share AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY share DESC, ticker DESC) AS i FROM e) WHERE i = 1)
SELECT h.portfolio_id, (SELECT max(date)::DATE::VARCHAR FROM ret) AS as_of, hist_var, hist_es, param_var, param_es, n AS observations, x AS exceptions, round(n * {1 - CONF!r}::DOUBLE, 1) AS expected,
  greatest(0.0, -2 * ((n - x) * ln({CONF}::DOUBLE) + x * ln({1 - CONF!r}::DOUBLE) - (CASE WHEN n = x THEN 0 ELSE (n - x) * ln(CASE WHEN n = x THEN 1 ELSE 1 - x / n END) END) - (CASE WHEN x = 0 THEN 0 ELSE x * ln(CASE WHEN x = 0 THEN 1 ELSE x / n END) END))) <= 3.841458820694124 AS calibrated, top, top_share
FROM h JOIN p USING (portfolio_id) JOIN k USING (portfolio_id) JOIN t USING (portfolio_id)""",
    "pretrade_rows": f"""WITH {_PNL}, {_HIST}, w AS (SELECT * FROM weights WHERE weight <> 0),
o AS (SELECT portfolio_id, 'single-name weight ' || ticker AS name, abs(weight) AS observed, 0.35::DOUBLE AS "limit" FROM w
  UNION ALL SELECT portfolio_id, 'sector weight ' || ticker, abs(weight), 0.6::DOUBLE FROM w
  UNION ALL SELECT portfolio_id, 'gross exposure', round(sum(abs(weight)), 12), 1.0::DOUBLE FROM w GROUP BY 1
  UNION ALL SELECT portfolio_id, '1-day 99% historical VaR', -max(pnl), 0.04::DOUBLE FROM r WHERE rn <= {_K} GROUP BY 1)
SELECT portfolio_id, name, round(observed, 6) AS observed, "limit", observed <= "limit" + CASE WHEN name = 'gross exposure' THEN 1e-9 ELSE 0 END AS passed FROM o""",
    "rolling_var_backtest": f"WITH {_BACK} SELECT portfolio_id, date, round(pnl, 6) AS pnl, round(var, 6) AS var FROM back",
    "kupiec_lr": f"""WITH {_BACK}, k AS (SELECT portfolio_id, count(*) AS n, count(*) FILTER (WHERE pnl < -var) AS x FROM back GROUP BY 1)
SELECT portfolio_id, n AS observations, x AS exceptions, round(greatest(0.0, -2 * ((n - x) * ln({CONF}::DOUBLE) + x * ln({1 - CONF!r}::DOUBLE)
  - (CASE WHEN n = x THEN 0 ELSE (n - x) * ln(CASE WHEN n = x THEN 1 ELSE 1 - x / n END) END) - (CASE WHEN x = 0 THEN 0 ELSE x * ln(CASE WHEN x = 0 THEN 1 ELSE x / n END) END))), 6) AS lr FROM k""",
    "sector_exposure": f"WITH {POSITIONS_SQL} SELECT portfolio_id, sector, round(round(sum(abs(weight)), 12), 6) AS exposure FROM positions GROUP BY 1, 2",
    "pretrade_checks": f"""WITH {POSITIONS_SQL},
s AS (SELECT portfolio_id, sector, round(sum(abs(weight)), 12) AS e FROM positions GROUP BY 1, 2),
a AS (SELECT portfolio_id, count(*) + 1 AS c, count(*) FILTER (WHERE abs(weight) > 0.35) + (round(sum(abs(weight)), 12) > 1.0 + 1e-9)::INT AS b FROM positions GROUP BY 1
  UNION ALL SELECT portfolio_id, count(*), count(*) FILTER (WHERE e > 0.6) FROM s GROUP BY 1),
t AS (SELECT portfolio_id, sum(c)::BIGINT AS n_checks, sum(b)::BIGINT AS n_breaches FROM a GROUP BY 1),
h AS (SELECT portfolio_id, count(*) AS k FROM positions WHERE name IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < -900) GROUP BY 1)
SELECT t.portfolio_id, n_checks, n_breaches, coalesce(k, 0)::BIGINT AS n_restricted, CASE WHEN n_breaches = 0 AND k IS NULL THEN 'APPROVE' ELSE 'REJECT' END AS decision FROM t LEFT JOIN h USING (portfolio_id)""",
    "order_value_var": f"WITH pnl AS (SELECT o_orderpriority AS portfolio_id, o_orderkey AS date, o_totalprice AS pnl FROM orders), {_HIST} SELECT portfolio_id, max(n) AS n, round(-max(pnl), 2) AS var, round(-avg(pnl), 2) AS es FROM r WHERE rn <= {_K} GROUP BY 1",
}

_LAST = "SELECT h.portfolio_id, (SELECT max(date)"
_PARTS, _, _REPORT = SQL["portfolio_risk"].partition(_LAST)
_PERCENT = lambda x, places=1: f"printf('%.{places}f%%', ({x}) * 100)"
SQL["risk_evidence"] = f"""{_PARTS} SELECT 'risk:' || portfolio_id || ':var' AS id, 'Portfolio VaR' AS label, unnest(['var', 'es']) AS key, unnest([hist_var, hist_es]) AS value FROM h
UNION ALL SELECT 'risk:' || portfolio_id || ':backtest', 'Historical VaR backtest (Kupiec POF)', unnest(['observations', 'exceptions']), unnest([n::DOUBLE, x::DOUBLE]) FROM k
UNION ALL SELECT 'risk:' || portfolio_id || ':' || ticker, ticker || ' position risk', unnest(['weight', 'share']), unnest([weight, share]) FROM e JOIN weights USING (portfolio_id, ticker)"""
SQL["risk_sentences"] = f"""{_PARTS.rstrip()},
q AS ({_LAST}{_REPORT}),
m AS (SELECT portfolio_id, ticker, share, weight, row_number() OVER (PARTITION BY portfolio_id ORDER BY share DESC, ticker) AS i FROM e JOIN weights USING (portfolio_id, ticker))
SELECT q.portfolio_id, unnest([0, 1, 2]) AS place, unnest([
  'As of ' || as_of || ', the portfolio''s 1-day {CONF * 100:.0f}% historical VaR is ' || {_PERCENT("hist_var", 2)} || ' of capital (expected shortfall ' || {_PERCENT("hist_es", 2)} || '), using {WINDOW} trading days [risk:' || q.portfolio_id || ':var].',
  ticker || ' contributes ' || {_PERCENT("share")} || ' of portfolio VaR at a ' || {_PERCENT("weight")} || ' weight [risk:' || q.portfolio_id || ':' || ticker || '].',
  'Backtest: ' || exceptions || ' VaR exceptions in ' || observations || ' days against ' || expected || ' expected, ' || CASE WHEN calibrated THEN 'consistent with' ELSE 'rejected by' END || ' the Kupiec test at the 5% level [risk:' || q.portfolio_id || ':backtest].']) AS finding
FROM q JOIN m ON m.portfolio_id = q.portfolio_id AND i = 1"""
SQL["pretrade_findings"] = f"""WITH c AS ({SQL["pretrade_rows"]}),
d AS (SELECT portfolio_id, count(*) AS n, CASE WHEN bool_and(passed) THEN 'APPROVE' ELSE 'REJECT' END AS decision, max(observed) FILTER (WHERE name LIKE '%VaR') AS var,
  string_agg('Breach: ' || name || ' is ' || {_PERCENT("observed")} || ' against a limit of ' || {_PERCENT('"limit"')} || ' [limit:' || replace(name, ' ', '_') || '].', ' ' ORDER BY name) FILTER (WHERE NOT passed) AS breaches FROM c GROUP BY 1)
SELECT portfolio_id, decision, 'Pre-trade decision: ' || decision || '.' || coalesce(' ' || breaches, '') || CASE WHEN decision = 'APPROVE' THEN ' All ' || n || ' limits pass'
  || coalesce(', including 1-day 99% VaR of ' || {_PERCENT("var", 2)} || ' against ' || {_PERCENT("0.04", 2)} || ' [limit:summary] [limit:1-day_99%_historical_VaR].', ' [limit:summary].') ELSE '' END AS findings FROM d"""
