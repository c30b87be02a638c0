"""Portfolio risk over long tables: returns, P&L, VaR and expected shortfall, attribution, rolling backtest, limits.

Prices are (date, ticker, adj_close), weights (portfolio_id, ticker, weight). Every operator works on many portfolios at once; the
tail statistics sort each portfolio's P&L once.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources.tables import saved

TRADING_DAYS = 252
OCTAVE, SLICES, FEW = 32, 1024, 10_000  # ranges to a doubling, parts of a range, rows that may be broadcast
BOOKS = 128  # portfolios that a task simulates at once


def require_prices(prices: DataFrame, tickers: list[str]) -> None:
    """KeyError if there is no price at all of some of the request's own tickers."""
    known = {r[0] for r in prices.where(F.col("ticker").isin(tickers)).select("ticker").distinct().collect()}  # as many as asked for
    if missing := sorted(set(tickers) - known):
        raise KeyError(f"no prices for {missing}")


def log_returns(prices: DataFrame, tickers: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """(date, ticker, ret) on dates where every ticker has a return, up to the day as_of. The calendar holds every date of any ticker; a
    missing price takes away its own date and the next one and is never bridged."""
    if tickers is not None:
        prices = prices.where(F.col("ticker").isin(tickers))
    if as_of is not None:
        prices = prices.where(F.col("date") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz"))
    # no cross product of dates and tickers: the date before in the calendar must be the ticker's own date before
    calendar = prices.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date")))  # one row per date
    n = prices.select("ticker").distinct().agg(F.count(F.lit(1)).alias("n_tickers"))
    own = Window.partitionBy("ticker").orderBy("date")
    ret = (
        prices.join(calendar, "date").withColumn("p_date", F.lag("date").over(own)).withColumn("p", F.lag("adj_close").over(own))
        .where(F.col("p_date").eqNullSafe(F.col("before")) & F.col("before").isNotNull())
        .select("date", "ticker", (F.ln("adj_close") - F.ln("p")).alias("ret"))
    )
    whole = ret.groupBy("date").agg(F.count("ret").alias("k")).join(F.broadcast(n)).where("k = n_tickers").select("date")
    return ret.join(whole, "date")


def last_dates(returns: DataFrame, window: int) -> DataFrame:
    """The rows of the last `window` dates."""
    dates = returns.select("date").distinct().orderBy(F.desc("date")).limit(window)
    return returns.join(F.broadcast(dates), "date")  # window rows


def portfolio_pnl(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio_id, date, pnl)."""
    return returns.join(weights, "ticker").groupBy("portfolio_id", "date").agg(F.sum(F.col("ret") * F.col("weight")).alias("pnl"))


def tail_count(n: Column, confidence: float) -> Column:
    """How many outcomes make the tail, at least one; the guard keeps 0.01 * 1000 at 10."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(1 - confidence) * n - F.lit(1e-9)))).cast("int")


def _octave(x: Column) -> Column:
    """A whole number that never falls as x grows: OCTAVE of them to a doubling, on either side of zero. Infinity and NaN come last."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * OCTAVE) + OCTAVE * 1100
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def _few(df: DataFrame) -> DataFrame:
    """df worked out once and broadcast if it has FEW rows at most, else df as it is."""
    rows = df.limit(FEW + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= FEW else df


def _edge(counted: DataFrame, by: str) -> DataFrame:
    """Of counts and sums (c, s) of ranges `by` per portfolio, after `below` outcomes of sum `less`: the range that has the k-th."""
    before = Window.partitionBy("portfolio_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    cum = counted.withColumns({"below": F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)), "less": F.col("less") + F.coalesce(F.sum("s").over(before), F.lit(0.0))})
    return cum.where((F.col("below") < F.col("k")) & (F.col("k") <= F.col("below") + F.col("c")))


def historical_var(pnl: DataFrame, confidence: float = 0.99) -> DataFrame:
    """(portfolio_id, n, var, es): minus the k-th smallest outcome, minus the mean of the k smallest; null outcomes don't count.

    Exact selection in two steps. First, counts and sums over ranges of values (OCTAVE to a doubling) name the range with the k-th
    outcome; ranges below it need no second look. Then only that range's outcomes are read, cut into SLICES equal parts, and the
    different values of the part with the k-th are put in order. A portfolio with most of the rows sends counts, not rows."""
    known = pnl.where(F.col("pnl").isNotNull()).select("portfolio_id", "pnl", _octave(F.col("pnl")).alias("range"))
    counted = known.groupBy("portfolio_id", "range").agg(F.count(F.lit(1)).alias("c"), F.sum("pnl").alias("s"), F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    counted = counted.withColumn("n", F.sum("c").over(Window.partitionBy("portfolio_id"))).withColumns({"k": tail_count(F.col("n"), confidence), "below": F.lit(0).cast("long"), "less": F.lit(0.0)})
    head = ["portfolio_id", "n", "k", "below", "less"]
    part = F.coalesce(F.floor(F.try_divide(F.col("pnl") - F.col("lo"), F.col("hi") - F.col("lo")) * SLICES), F.lit(0))
    inside = known.join(_few(_edge(counted, "range").select(*head, "range", "lo", "hi")), ["portfolio_id", "range"]).withColumn("part", part)
    values = inside.groupBy(*head, "part", "pnl").agg(F.count(F.lit(1)).alias("c"))
    parts = values.groupBy(*head, "part").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("pnl")).alias("s"))
    last = values.select("portfolio_id", "part", "pnl", "c").join(_edge(parts, "part").select(*head, "part"), ["portfolio_id", "part"])
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("portfolio_id").orderBy("pnl"))
    taken = last.withColumn("take", F.least("c", F.col("k") - (upto - F.col("c")))).where("take > 0")
    return taken.groupBy("portfolio_id", "n", "k", "less").agg((-F.max("pnl")).alias("var"), F.sum(F.col("take") * F.col("pnl")).alias("_s")).select("portfolio_id", "n", "var", (-(F.col("less") + F.col("_s")) / F.col("k")).alias("es"))


def parametric_var(pnl: DataFrame, confidence: float = 0.99) -> DataFrame:
    """(portfolio_id, var, es) of the normal distribution with the sample's mean and deviation; none below two outcomes."""
    a = 1 - confidence
    z = NormalDist().inv_cdf(a)
    phi = NormalDist().pdf(z)
    per = pnl.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s")).where("n > 1")
    return per.select("portfolio_id", (-(F.col("m") + F.col("s") * z)).alias("var"), (-F.col("m") + F.col("s") * phi / a).alias("es"))


def moments(returns: DataFrame) -> DataFrame:
    """(ticker, n, mean, vol): vol is the sample deviation of a year."""
    return returns.groupBy("ticker").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), (F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("vol"))


def covariances(returns: DataFrame) -> DataFrame:
    """(a, b, cov) of each two tickers, a <= b: the returns of a date meet as one array, so each is moved once."""
    day = returns.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("r"))  # a row per ticker
    pairs = day.select(F.explode("r").alias("x"), "r").select("x", F.explode(F.filter("r", lambda y: y["ticker"] >= F.col("x.ticker"))).alias("y"))
    return pairs.groupBy(F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b")).agg(F.covar_samp("x.ret", "y.ret").alias("cov"))


def euler_shares(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio_id, ticker, weight, share): each position's part of the portfolio's deviation, from its covariance with the P&L. A date's
    positions meet once, and their sum is the P&L beside them."""
    day = returns.join(weights, "ticker").groupBy("portfolio_id", "date").agg(F.collect_list(F.struct("ticker", "weight", "ret")).alias("p"))  # a row per position
    pnl = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["weight"] * x["ret"])
    each = day.select("portfolio_id", pnl.alias("pnl"), F.inline("p"))
    per = each.groupBy("portfolio_id", "ticker").agg(F.first("weight").alias("weight"), F.covar_samp("ret", "pnl").alias("c")).withColumn("part", F.col("weight") * F.col("c"))
    total = F.sum("part").over(Window.partitionBy("portfolio_id"))
    return per.select("portfolio_id", "ticker", "weight", F.coalesce(F.try_divide("part", total), F.lit(0.0)).alias("share"))


def annualized_vol(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio_id, ticker, vol) of each position."""
    return weights.join(moments(returns), "ticker").select("portfolio_id", "ticker", "vol")


def rolling_var(pnl: DataFrame, window: int = 250, confidence: float = 0.99) -> DataFrame:
    """(portfolio_id, date, pnl, var): VaR of the `window` outcomes before each date, where there are as many. Each portfolio's
    series is one Arrow group; a partition in place of a sort of every window."""
    k = max(1, min(window, math.ceil((1 - confidence) * window - 1e-9)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        x = pdf["pnl"].to_numpy()
        if len(x) <= window:
            return pdf.iloc[:0].assign(var=pd.Series(dtype=float))[["portfolio_id", "date", "pnl", "var"]]
        view = np.lib.stride_tricks.sliding_window_view(x, window)[:-1]
        step = max(1, (1 << 22) // window)  # windows copied at once
        low = np.concatenate([np.partition(view[i : i + step], k - 1, axis=1)[:, k - 1] for i in range(0, len(view), step)])
        return pdf.iloc[window:].assign(var=-low)[["portfolio_id", "date", "pnl", "var"]]

    return pnl.groupBy("portfolio_id").applyInPandas(run, pnl.select("portfolio_id", "date", "pnl").withColumn("var", F.lit(0.0)).schema)


def kupiec(backtest: DataFrame, confidence: float = 0.99) -> DataFrame:
    """(portfolio_id, observations, exceptions, lr): likelihood ratio of the share of outcomes worse than -VaR; 0 * ln 0 = 0."""
    p = 1 - confidence
    per = backtest.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("pnl") < -F.col("var")).alias("exceptions"))
    n, x = F.col("observations"), F.col("exceptions")
    term = lambda k, q: F.when(k == 0, 0.0).otherwise(k * F.ln(q))
    rate = x / n
    lr = -2 * (term(n - x, F.lit(1 - p)) + term(x, F.lit(p)) - term(n - x, 1 - rate) - term(x, rate))
    return per.withColumn("lr", F.greatest(F.lit(0.0), lr))


def kupiec_p(lr: float) -> float:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return math.erfc(math.sqrt(lr / 2))


kupiec_p_udf = F.pandas_udf(lambda lr: lr.map(kupiec_p), T.DoubleType())

# Pre-trade limits and what allocations are tested by.
LIMITS = {"single_name": 0.35, "sector": 0.6, "gross": 1.0, "var": 0.04}
SIGNIFICANCE = 0.05


def _by_sector(positions: DataFrame, limits: dict, restricted: DataFrame | None) -> DataFrame:
    """(portfolio_id, sector, exposure, names, over, banned) in one aggregate of the positions."""
    if restricted is not None:
        positions = positions.join(restricted.select("name", F.lit(True).alias("_banned")).distinct(), "name", "left")
    banned = F.lit(False) if restricted is None else F.coalesce("_banned", F.lit(False))
    size = F.abs("weight")
    return positions.groupBy("portfolio_id", "sector").agg(F.round(F.sum(size), 12).alias("exposure"), F.count(F.lit(1)).alias("names"), F.count_if(size > limits["single_name"]).alias("over"), F.count_if(banned).alias("banned"))


def limit_checks(positions: DataFrame, var: DataFrame | None = None, restricted: DataFrame | None = None, limits: dict = LIMITS) -> DataFrame:
    """(portfolio_id, n_checks, n_breaches, n_restricted, decision). Sums are rounded to 12 places before they are compared, so that
    their order does not matter; only the gross limit has a slack. Names on the restricted list reject but are no breach. Positions
    move once, by portfolio and sector."""
    per = _by_sector(positions, limits, restricted).groupBy("portfolio_id").agg(
        (F.sum("names") + F.count(F.lit(1)) + 1).alias("n_checks"),
        (F.sum("over") + F.count_if(F.col("exposure") > limits["sector"]) + (F.round(F.sum("exposure"), 12) > limits["gross"] + 1e-9).cast("long")).alias("n_breaches"),
        F.sum("banned").alias("n_restricted"),
    )
    if var is not None:
        per = per.join(var.select("portfolio_id", (F.col("var") > limits["var"]).cast("long").alias("_over")), "portfolio_id", "left")
        per = per.select("portfolio_id", (F.col("n_checks") + F.col("_over").isNotNull().cast("long")).alias("n_checks"), (F.col("n_breaches") + F.coalesce("_over", F.lit(0))).alias("n_breaches"), "n_restricted")
    return per.withColumn("decision", F.when((F.col("n_breaches") == 0) & (F.col("n_restricted") == 0), "APPROVE").otherwise("REJECT"))


def limit_rows(positions: DataFrame, var: DataFrame | None = None, limits: dict = LIMITS) -> DataFrame:
    """(portfolio_id, name, observed, limit, passed): a row per check, the evidence of a decision."""
    row = lambda name, seen, kind, slack=0.0: (name.alias("name"), seen.alias("observed"), F.lit(limits[kind]).alias("limit"), (seen <= limits[kind] + slack).alias("passed"))
    single = positions.select("portfolio_id", *row(F.concat(F.lit("single-name weight "), F.col("name").cast("string")), F.abs("weight"), "single_name"))
    sectors = sector_exposure(positions)
    gross = sectors.groupBy("portfolio_id").agg(F.round(F.sum("exposure"), 12).alias("g")).select("portfolio_id", *row(F.lit("gross exposure"), F.col("g"), "gross", 1e-9))
    out = single.unionByName(sectors.select("portfolio_id", *row(F.concat(F.lit("sector weight "), "sector"), F.col("exposure"), "sector"))).unionByName(gross)
    return out if var is None else out.unionByName(var.select("portfolio_id", *row(F.lit(VAR_CHECK), F.col("var"), "var")))


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", x * 100), F.lit("%"))


def sector_exposure(positions: DataFrame) -> DataFrame:
    return positions.groupBy("portfolio_id", "sector").agg(F.round(F.sum(F.abs("weight")), 12).alias("exposure"))


#: Bounds of a request, fixed values.
PATHS, HORIZON, POSITIONS, TICKER_CHARS, GROSS = (1_000, 2_000_000), (1, 60), 20, 10, 1.0


def require_request(paths: int, horizon: int) -> None:
    """ValueError unless the number of paths and the horizon in days are within their bounds."""
    for name, got, (low, high) in (("paths", paths, PATHS), ("horizon", horizon, HORIZON)):
        if isinstance(got, bool) or not isinstance(got, int) or not low <= got <= high:
            raise ValueError(f"{name} must be a whole number between {low} and {high}, not {got!r}")


def bad_positions(weights: DataFrame) -> DataFrame:
    """(portfolio_id, reason): what is wrong with requests (portfolio_id, ticker, weight), a row for each portfolio and reason. Tickers
    have 1 to 10 characters, weights are in [-1, 1] (so neither null nor NaN), a portfolio has 20 positions at most."""
    ticker, weight = F.coalesce(F.char_length("ticker"), F.lit(0)), F.col("weight")
    wrong = {
        f"more than {POSITIONS} positions": F.count(F.lit(1)) > POSITIONS,
        "ticker": F.coalesce(F.bool_or(~ticker.between(1, TICKER_CHARS)), F.lit(False)),
        "weight": F.bool_or(F.coalesce(F.isnan(weight) | (F.abs(weight) > GROSS), F.lit(True))),
    }
    reasons = F.array(*[F.when(test, F.lit(reason)) for reason, test in wrong.items()])
    return weights.groupBy("portfolio_id").agg(F.array_compact(reasons).alias("_r")).select("portfolio_id", F.explode("_r").alias("reason"))


def checked_positions(weights: DataFrame) -> DataFrame:
    """weights with tickers as prices have them (without blanks around, upper case); a job that reads a row whose ticker or weight is
    out of bounds fails and names the portfolio."""
    clean = weights.withColumn("ticker", F.upper(F.trim("ticker")))
    fine = F.char_length("ticker").between(1, TICKER_CHARS) & ~F.isnan("weight") & (F.abs("weight") <= GROSS)
    said = F.concat(F.lit("position out of bounds in portfolio "), F.coalesce(F.col("portfolio_id").cast("string"), F.lit("null")))
    return clean.withColumn("weight", F.when(F.coalesce(fine, F.lit(False)), F.col("weight")).otherwise(F.raise_error(said).cast("double")))


def portfolio_risk(returns: DataFrame, weights: DataFrame, window: int = 500, back: int = 250, confidence: float = 0.99, horizon: int = 10, paths: int = 100_000, seed: int = 7) -> DataFrame:
    """A row per portfolio: risk_id, as_of, historical, parametric and simulated VaR and ES, the backtest with its p-value, and
    positions (ticker, weight, vol, share). The returns of the last window + back dates are read; give a table, not a plan. Returns
    of fewer than window + 30 dates are an error. risk_id names the request: the portfolio's weights and all parameters."""
    if not 0.5 < confidence < 1 or not 30 <= window <= 2000:
        raise ValueError("confidence must be in (0.5, 1) and window between 30 and 2000")
    n, until = returns.agg(F.countDistinct("date"), F.max("date")).collect()[0]
    if n < window + 30:
        raise ValueError(f"only {n} dates with all returns, {window + 30} are needed")
    recent = last_dates(returns, window + back)
    pnl = saved(portfolio_pnl(recent, weights))
    newest = last_dates(recent, window)
    own = pnl.join(F.broadcast(newest.select("date").distinct()), "date")  # window rows
    test = kupiec(rolling_var(pnl, back, confidence), confidence).select("portfolio_id", "observations", "exceptions", F.round(F.col("observations") * (1 - confidence), 1).alias("expected"), kupiec_p_udf("lr").alias("p_value"))
    order, mu, cov = estimate(newest)
    asked = F.struct(F.array_sort(F.collect_list(F.struct("ticker", "weight"))), *[F.lit(v) for v in (str(until), window, back, confidence, horizon, paths, seed)])  # a request's positions
    out = weights.groupBy("portfolio_id").agg(F.concat(F.lit("risk:"), F.substring(F.sha2(F.to_json(asked), 256), 1, 12)).alias("risk_id"))
    kinds = (("hist", historical_var(own, confidence)), ("param", parametric_var(own, confidence)), ("mc", monte_carlo_books(weights, order, mu, cov, paths, horizon, 5.0, confidence, seed)))
    for kind, got in kinds:
        out = out.join(got.select("portfolio_id", F.col("var").alias(f"{kind}_var"), F.col("es").alias(f"{kind}_es")), "portfolio_id", "left")
    places = euler_shares(newest, weights).join(annualized_vol(newest, weights), ["portfolio_id", "ticker"]).groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("ticker", "weight", "vol", "share"))).alias("positions"))
    out = out.join(test, "portfolio_id", "left").join(places, "portfolio_id", "left")
    return out.withColumns({"as_of": F.lit(str(until)[:10]), "window": F.lit(window), "horizon": F.lit(horizon), "confidence": F.lit(confidence), "calibrated": F.col("p_value") >= SIGNIFICANCE})


def requested_risk(returns: DataFrame, weights: DataFrame, paths: int = 100_000, horizon: int = 10, **rest) -> DataFrame:
    """portfolio_risk of a request from outside: ValueError if it is out of bounds, before anything is simulated."""
    require_request(paths, horizon)
    if wrong := bad_positions(weights).limit(1).collect():
        raise ValueError(f"portfolio {wrong[0]['portfolio_id']}: {wrong[0]['reason']}")
    return portfolio_risk(returns, checked_positions(weights), paths=paths, horizon=horizon, **rest)


def estimate(returns: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, mean vector, covariance matrix) of the returns, for simulations: as many numbers as the matrix has cells."""
    mean = {r["ticker"]: r["mean"] for r in moments(returns).collect()}
    order = sorted(mean)
    at, cov = {t: i for i, t in enumerate(order)}, np.zeros((len(order), len(order)))
    for r in covariances(returns).collect():
        cov[at[r["a"]], at[r["b"]]] = cov[at[r["b"]], at[r["a"]]] = r["cov"]
    return order, np.array([mean[t] for t in order]), cov


# The sentences of findings.
RISK_SENTENCES = [
    "As of %s, the portfolio's 1-day %s historical VaR is %s of capital (expected shortfall %s), using %s trading days [%s:var].",
    "The %s-day %s Monte Carlo VaR with fat-tailed (Student-t) shocks is %s (expected shortfall %s) [%s:var].",
    "%s contributes %s of portfolio VaR at a %s weight [%s:%s].",
    "Backtest: %s VaR exceptions in %s days against %s expected, %s the Kupiec test at the 5%% level [%s:backtest].",
]
DECISION_SENTENCES = {
    "decision": "Pre-trade decision: %s.",
    "breach": "Breach: %s is %s against a limit of %s [limit:%s].",
    "restricted": "Restricted list: %s.",
    "approved": "All %s limits pass, including 1-day 99%% VaR of %s against %s [limit:summary] [limit:1-day_99%%_historical_VaR].",
    "approved without VaR": "All %s limits pass [limit:summary].",
}
VAR_CHECK = "1-day 99% historical VaR"


def risk_findings(report: DataFrame) -> DataFrame:
    """(portfolio_id, findings): VaR, simulated VaR, the top contributor, the backtest."""
    top = F.array_min(F.transform("positions", lambda p: F.struct((-p["share"]).alias("_less"), p["ticker"].alias("ticker"), p["share"].alias("share"), p["weight"].alias("weight"))))  # the first of equals
    conf, verdict = F.format_string("%.0f%%", F.col("confidence") * 100), F.when(F.col("calibrated"), "consistent with").otherwise("rejected by")
    rid = F.col("risk_id")
    filled = [
        ("as_of", conf, percent(F.col("hist_var"), 2), percent(F.col("hist_es"), 2), F.col("window").cast("string"), rid),
        (F.col("horizon").cast("string"), conf, percent(F.col("mc_var"), 2), percent(F.col("mc_es"), 2), rid),
        ("_top.ticker", percent(F.col("_top.share")), percent(F.col("_top.weight")), rid, "_top.ticker"),
        (F.col("exceptions").cast("string"), F.col("observations").cast("string"), F.col("expected").cast("string"), verdict, rid),
    ]
    said = [F.format_string(sentence, *values) for sentence, values in zip(RISK_SENTENCES, filled)]
    return report.withColumn("_top", top).select("portfolio_id", F.array(*said).alias("findings"))


def limit_findings(rows: DataFrame, decisions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(portfolio_id, decision, findings): the decision, a sentence per breach in order of its name, the restricted names
    (portfolio_id, restricted: array) and, where all passes, how many limits do."""
    breach = F.format_string(DECISION_SENTENCES["breach"], "name", percent(F.col("observed")), percent(F.col("limit")), F.replace("name", F.lit(" "), F.lit("_")))
    var = F.max(F.when(F.col("name") == VAR_CHECK, F.struct("observed", "limit")))
    per = rows.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), breach))).alias("b"), var.alias("v"))  # one per check
    out = decisions.join(per, "portfolio_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("restricted", none) if names is None else out.join(names.select("portfolio_id", "restricted"), "portfolio_id", "left")
    say = lambda kind, *values: F.array(F.format_string(DECISION_SENTENCES[kind], *values))
    n = F.col("n_checks").cast("string")
    passed = F.when(F.col("decision") != "APPROVE", none).when(F.col("v").isNull(), say("approved without VaR", n)).otherwise(say("approved", n, percent(F.col("v.observed"), 2), percent(F.col("v.limit"), 2)))
    banned = F.when(F.size("restricted") > 0, say("restricted", F.array_join("restricted", ", "))).otherwise(none)
    return out.select("portfolio_id", "decision", F.concat(say("decision", "decision"), F.coalesce("b", none), banned, passed).alias("findings"))


def _simulated(books: DataFrame, n_books: int, mu: np.ndarray, cov: np.ndarray, paths: int, horizon: int, dof: float, confidence: float, seed: int, block: int, tasks: int | None) -> DataFrame:
    """(portfolio_id, n, var, es) of books (portfolio_id, at, w: places and weights of their positions)."""
    if paths <= 0 or horizon <= 0 or not (dof == 0 or dof > 2):
        raise ValueError("paths and horizon must be positive, dof 0 or above 2")
    chol, blocks = np.linalg.cholesky(cov), -(-paths // block)
    k = max(1, min(paths, math.ceil((1 - confidence) * paths - 1e-9)))
    groups = max(1, -(-n_books // BOOKS))
    ranges = max(1, min(blocks, -(-(tasks or books.sparkSession.sparkContext.defaultParallelism) // groups)))

    def outcomes(b: int, book: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([seed, b])
        n = min(block, paths - b * block)
        total = np.zeros((n, len(mu)))
        for _ in range(horizon):
            z = rng.standard_normal((n, len(mu)))
            if dof:
                z *= np.sqrt((dof - 2) / rng.chisquare(dof, (n, 1)))
            total += z
        return np.expm1(horizon * mu + total @ chol.T) @ book.T

    def lowest(parts: list) -> np.ndarray:
        low = np.concatenate(parts)
        return np.partition(low, k - 1, axis=0)[:k] if k < len(low) else low

    def run(batches):
        for pdf in batches:
            for r, of_range in pdf.groupby("range"):
                for i in range(0, len(of_range), BOOKS):
                    some = of_range.iloc[i : i + BOOKS]
                    book = np.zeros((len(some), len(mu)))
                    for row, at, w in zip(book, some["at"], some["w"]):
                        row[np.asarray(at, int)] = w
                    kept, n = [], 0
                    for b in range(int(r) * blocks // ranges, (int(r) + 1) * blocks // ranges):
                        kept.append(outcomes(b, book))
                        n += len(kept[-1])
                        if n > k + 8 * block:
                            kept = [lowest(kept)]
                            n = len(kept[0])
                    yield pd.DataFrame({"portfolio_id": some["portfolio_id"], "low": list(np.sort(lowest(kept), axis=0).T)})

    schema = T.StructType([books.schema["portfolio_id"], T.StructField("low", T.ArrayType(T.DoubleType()))])
    place = F.pmod(F.xxhash64("portfolio_id"), F.lit(groups)) * ranges + F.col("range")
    dealt = books.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).repartitionById(groups * ranges, place.cast("int"))
    low = dealt.select("portfolio_id", "range", "at", "w").mapInPandas(run, schema)
    if ranges > 1:  # a portfolio's tails of all ranges: paths at most
        low = low.groupBy("portfolio_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("low"))), 1, k).alias("low"))
    return low.select("portfolio_id", F.lit(paths).cast("long").alias("n"), (-F.element_at("low", -1)).alias("var"), (-F.aggregate("low", F.lit(0.0), lambda a, x: a + x) / k).alias("es"))


def monte_carlo(spark, mu: np.ndarray, cov: np.ndarray, weights: np.ndarray, paths: int = 100_000, horizon: int = 10, dof: float = 5.0, confidence: float = 0.99, seed: int = 0, block: int = 4096, n_partitions: int | None = None) -> DataFrame:
    """(row, n, var, es) of simulated P&L for each row of weights (a portfolio; one vector is one row). Paths come in blocks with a
    stream of random numbers each, so the result does not depend on partitions, and all portfolios see the same shocks. Tasks take
    blocks of portfolios times ranges of paths; a task gives the k lowest outcomes of each of its portfolios at most. dof 0 is the
    normal distribution."""
    book = np.atleast_2d(np.asarray(weights, float))
    rows = [(i, [int(j) for j in np.flatnonzero(w)], w[np.flatnonzero(w)].tolist()) for i, w in enumerate(book)]
    books = spark.createDataFrame(rows, "portfolio_id long, at array<int>, w array<double>")
    return _simulated(books, len(rows), mu, cov, paths, horizon, dof, confidence, seed, block, n_partitions).withColumnRenamed("portfolio_id", "row")


def monte_carlo_books(weights: DataFrame, order: list[str], mu: np.ndarray, cov: np.ndarray, paths: int = 100_000, horizon: int = 10, dof: float = 5.0, confidence: float = 0.99, seed: int = 0, block: int = 4096, n_partitions: int | None = None) -> DataFrame:
    """monte_carlo for a table of any number of portfolios (portfolio_id, ticker, weight), which never pass through the driver; order
    names the tickers of mu and cov. Weights of a repeated ticker add up, a ticker that is not in order moves nothing."""
    at = (F.array_position(F.array(*[F.lit(t) for t in order]), F.col("ticker")) - 1).cast("int")
    summed = weights.groupBy("portfolio_id", "ticker").agg(F.sum("weight").alias("weight"))
    placed = summed.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.when(at >= 0, F.struct(at.alias("at"), "weight")))).alias("_v"))  # as many as order has
    books = placed.select("portfolio_id", F.col("_v.at").alias("at"), F.coalesce("_v.weight", F.array()).cast("array<double>").alias("w"))
    return _simulated(books, weights.select("portfolio_id").distinct().count(), mu, cov, paths, horizon, dof, confidence, seed, block, n_partitions)
