"""Queries over the point-in-time fact store."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import normalize, pit
from marlstone.sources.tables import facts, facts_sql, table

AS_OF = "1997-06-30"
_R = 6

_LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, fiscal_period, fiscal_year ORDER BY filed DESC, accession DESC) AS rn
  FROM facts{where}) WHERE rn = 1),
ids AS (SELECT *, ticker || ':' || metric || ':' || fiscal_period || fiscal_year || ':' || accession AS id FROM latest)"""


def _with(quarters: bool = False, as_of: str | None = None) -> str:
    return f"WITH {facts_sql(quarters)},\n" + _LATEST.format(where=f" WHERE filed <= DATE '{as_of}'" if as_of else "")


def _flat(df):
    """Derived rows with inputs as text, to compare."""
    return df.select("ticker", "name", "fiscal_year", "fiscal_period", F.round("value", _R).alias("value"), "unit", "formula", F.array_join("inputs", "|").alias("inputs"))


def _pair_sql(name: str, a: str, b: str, value: str, unit: str, formula: str, first: str | None = None) -> str:
    return f"""{first or _with()}
SELECT a.ticker, '{name}' AS name, a.fiscal_year, 'FY' AS fiscal_period, round({value}, {_R}) AS value, '{unit}' AS unit, '{formula}' AS formula, a.id || '|' || b.id AS inputs
FROM ids a JOIN ids b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year AND a.metric = '{a}' AND b.metric = '{b}'"""


def _growth_sql(metric: str) -> str:
    return f"""{_with()}
SELECT a.ticker, '{metric}_growth_yoy' AS name, a.fiscal_year, 'FY' AS fiscal_period, round(a.value / b.value - 1, {_R}) AS value, 'ratio' AS unit,
  '{metric}[FY' || a.fiscal_year || '] / {metric}[FY' || (a.fiscal_year - 1) || '] - 1' AS formula, a.id || '|' || b.id AS inputs
FROM ids a JOIN ids b ON a.ticker = b.ticker AND b.fiscal_year = a.fiscal_year - 1 AND a.metric = '{metric}' AND b.metric = '{metric}' WHERE b.value <> 0"""


#: The stand-in has neither gross profit nor a balance sheet: other metrics play them.
OTHER = {"operating_income": "gross_profit", "operating_cash_flow": "long_term_debt", "capex": "stockholders_equity"}


def _others(s, d):
    return facts(s, d).replace(OTHER, subset="metric")


_OTHER_SQL = _with().replace("facts AS (", "stand_in AS (", 1).replace("latest AS (", f"""facts AS (SELECT * REPLACE (CASE metric {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in OTHER.items())} ELSE metric END AS metric) FROM stand_in),
latest AS (""", 1)


def upsert_latest(spark, sf_dir):
    """The facts filed before mid-1998, then those filed from 1997 on with changed values, written over them."""
    f = facts(spark, sf_dir).withColumn("value", F.round("value", 2))
    old = f.where(F.col("filed") < F.lit("1998-07-01").cast("date"))
    batch = f.where(F.col("filed") >= F.lit("1997-01-01").cast("date")).withColumn("value", F.col("value") + 1.0).withColumn("ord", F.col("accession"))
    return pit.upsert(old, batch).groupBy("ticker", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


#: How orders stand in a company's payload, by priority: concept, first day and last day of the year's part, period, form. The fourth
#: kind is of no wanted form, the fifth a year to date.
KINDS = {
    "1-URGENT": ("RevenueFromContractWithCustomerExcludingAssessedTax", "01-01", "12-31", "FY", "10-K"),
    "2-HIGH": ("Revenues", "01-01", "12-31", "FY", "10-K/A"),
    "3-MEDIUM": ("NetIncomeLoss", "10-01", "12-31", "FY", "10-K"),
    "4-NOT SPECIFIED": ("NetIncomeLoss", "01-01", "12-31", "FY", "8-K"),
    "5-LOW": ("NetIncomeLoss", "04-01", "12-31", "FY", "10-K"),
}


def _orders(s, d):
    customer = table(s, d, "customer").select("c_custkey", "c_nationkey")
    nation = F.broadcast(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("ticker")))  # 25 rows
    return table(s, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def payloads(s, d):
    """(ticker, json): the orders of a nation as one company's facts."""
    kind = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("o_orderpriority")]
    year = F.year("o_orderdate").cast("string")
    row = F.struct(F.concat(year, F.lit("-"), kind[1]).alias("start"), F.concat(year, F.lit("-"), kind[2]).alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), year.alias("fy"), kind[3].alias("fp"), kind[4].alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    rows = _orders(s, d).select("ticker", kind[0].alias("concept"), row.alias("r")).groupBy("ticker", "concept").agg(F.collect_list("r").alias("USD"))
    gaap = F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.struct("USD").alias("units")))))
    return rows.groupBy("ticker").agg(gaap.alias("g")).select("ticker", F.to_json(F.struct(F.struct(F.col("g").alias("us-gaap")).alias("facts"))).alias("json"))


def normalize_facts(s, d):
    got = normalize.normalize(payloads(s, d))
    return got.select("ticker", "metric", "concept", "unit", "value", "period_type", "period_start", "period_end", "fiscal_year", "fiscal_period", "form", "accession", "filed")


def newest_filings(s, d):
    """The four newest annual and quarterly reports of each company, from parallel arrays of which one is shorter."""
    listed = _orders(s, d).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_orderkey")).alias("k"), "o_orderdate", "o_orderpriority"))).alias("l"))
    form = lambda x: F.when(x["o_orderpriority"] == "1-URGENT", "10-K").when(x["o_orderpriority"] == "2-HIGH", "10-Q").otherwise("8-K")
    day = F.transform("l", lambda x: F.date_format(x["o_orderdate"], "yyyy-MM-dd"))
    recent = F.struct(F.transform("l", lambda x: (-x["k"]).cast("string")).alias("accessionNumber"), F.transform("l", form).alias("form"), day.alias("filingDate"), day.alias("reportDate"), day.alias("acceptanceDateTime"), F.slice(day, F.lit(1), F.size("l") - 1).alias("primaryDocument"))
    rows = listed.select("ticker", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return normalize.newest(normalize.recent_filings(rows)).select("ticker", F.col("accessionNumber").alias("accession"), "form", "filingDate")


QUERIES = {
    "normalize_facts": normalize_facts,
    "newest_filings": newest_filings,
    "pit_fiscal_year": lambda s, d: pit.latest(facts(s, d), AS_OF, 1996),
    "pit_latest": lambda s, d: pit.latest(facts(s, d)),
    "pit_as_of": lambda s, d: pit.latest(facts(s, d), AS_OF),
    "pit_history": lambda s, d: pit.history(facts(s, d), 3, AS_OF),
    "fact_versions": lambda s, d: pit.versions(facts(s, d)).select("ticker", "metric", "fiscal_year", "accession", "filed", "value", F.col("version").cast("long").alias("version")),
    "fact_count": lambda s, d: facts(s, d).agg(F.count(F.lit(1)).alias("n")),
    "fact_tickers": lambda s, d: facts(s, d).select("ticker").distinct(),
    "fact_ids": lambda s, d: facts(s, d).select(pit.fact_id().alias("fact_id"), "value"),
    "restatements": lambda s, d: pit.restatements(facts(s, d)),
    "restated_from": lambda s, d: pit.restated_from(facts(s, d), AS_OF).drop("fiscal_period"),
    "latest_fiscal_year": lambda s, d: pit.latest_fiscal_year(facts(s, d), AS_OF),
    "derived_net_margin": lambda s, d: _flat(pit.ratio(facts(s, d), "net_margin")),
    "derived_operating_margin": lambda s, d: _flat(pit.ratio(facts(s, d), "operating_margin")),
    "derived_gross_margin": lambda s, d: _flat(pit.ratio(_others(s, d), "gross_margin")),
    "derived_debt_to_equity": lambda s, d: _flat(pit.ratio(_others(s, d), "debt_to_equity")),
    "yoy_growth_revenue": lambda s, d: _flat(pit.growth(facts(s, d), "revenue")),
    "yoy_growth_net_income": lambda s, d: _flat(pit.growth(facts(s, d), "net_income")),
    "free_cash_flow": lambda s, d: _flat(pit.free_cash_flow(facts(s, d))),
    "implied_q4": lambda s, d: _flat(pit.implied_q4(facts(s, d, True))),
    "upsert_latest": upsert_latest,
}

_COLS = "ticker, metric, value, fiscal_year, fiscal_period, accession, filed"
_ORDERS = "o AS (SELECT *, n_name AS ticker, year(o_orderdate)::INT AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
SQL = {
    "normalize_facts": f"""WITH {_ORDERS} SELECT ticker, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'net_income' ELSE 'revenue' END AS metric,
  CASE o_orderpriority WHEN '1-URGENT' THEN '{KINDS["1-URGENT"][0]}' WHEN '2-HIGH' THEN 'Revenues' ELSE 'NetIncomeLoss' END AS concept, 'USD' AS unit, o_totalprice AS value, 'duration' AS period_type,
  make_date(y, CASE o_orderpriority WHEN '3-MEDIUM' THEN 10 ELSE 1 END, 1) AS period_start, make_date(y, 12, 31) AS period_end, y AS fiscal_year, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'Q4' ELSE 'FY' END AS fiscal_period,
  CASE o_orderpriority WHEN '2-HIGH' THEN '10-K/A' ELSE '10-K' END AS form, o_orderkey::VARCHAR AS accession, o_orderdate::DATE AS filed FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "newest_filings": f"""WITH {_ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY o_orderkey DESC) AS i, count(*) OVER (PARTITION BY ticker) AS c FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i) AS k FROM n WHERE i < c AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT ticker, o_orderkey::VARCHAR AS accession, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' ELSE '10-Q' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS "filingDate" FROM f WHERE k <= 4""",
    "pit_fiscal_year": f"{_with(as_of=AS_OF)}\nSELECT {_COLS} FROM latest WHERE fiscal_year = 1996",
    "pit_latest": f"{_with()}\nSELECT {_COLS} FROM latest",
    "pit_as_of": f"{_with(as_of=AS_OF)}\nSELECT {_COLS} FROM latest",
    "pit_history": f"{_with(as_of=AS_OF)}\nSELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, fiscal_period ORDER BY fiscal_year DESC) AS k FROM latest) WHERE k <= 3",
    "fact_versions": f"WITH {facts_sql()}\nSELECT ticker, metric, fiscal_year, accession, filed, value, row_number() OVER (PARTITION BY ticker, metric, fiscal_period, fiscal_year ORDER BY filed, accession) AS version FROM facts",
    "fact_count": f"WITH {facts_sql()}\nSELECT count(*) AS n FROM facts",
    "fact_tickers": f"WITH {facts_sql()}\nSELECT DISTINCT ticker FROM facts",
    "fact_ids": f"WITH {facts_sql()}\nSELECT ticker || ':' || metric || ':' || fiscal_period || fiscal_year || ':' || accession AS fact_id, value FROM facts",
    "restatements": f"""WITH {facts_sql()}
SELECT ticker, metric, fiscal_period, fiscal_year, count(DISTINCT value) AS n_values, count(*) AS n_versions, arg_min(value, ROW(filed, accession)) AS first_value, arg_max(value, ROW(filed, accession)) AS last_value
FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1""",
    "restated_from": f"""{_with(as_of=AS_OF)},
p AS (SELECT l.ticker, l.metric, l.fiscal_year, f.value, f.accession, row_number() OVER (PARTITION BY l.ticker, l.metric, l.fiscal_year ORDER BY f.filed, f.accession) AS k
  FROM latest l JOIN facts f ON f.ticker = l.ticker AND f.metric = l.metric AND f.fiscal_year = l.fiscal_year AND f.filed < l.filed AND f.value <> l.value)
SELECT l.ticker, l.metric, l.fiscal_year, l.accession, l.value, p.value AS from_value, p.accession AS from_accession
FROM latest l LEFT JOIN p ON p.ticker = l.ticker AND p.metric = l.metric AND p.fiscal_year = l.fiscal_year AND p.k = 1""",
    "latest_fiscal_year": f"""WITH {facts_sql()}
SELECT ticker, coalesce(max(fiscal_year) FILTER (WHERE metric = 'revenue'), max(fiscal_year) FILTER (WHERE metric = 'net_income')) AS fiscal_year FROM facts WHERE filed <= DATE '{AS_OF}' GROUP BY ticker""",
    "derived_net_margin": _pair_sql("net_margin", "net_income", "revenue", "a.value / b.value", "ratio", "net_income / revenue"),
    "derived_operating_margin": _pair_sql("operating_margin", "operating_income", "revenue", "a.value / b.value", "ratio", "operating_income / revenue"),
    "derived_gross_margin": _pair_sql("gross_margin", "gross_profit", "revenue", "a.value / b.value", "ratio", "gross_profit / revenue", _OTHER_SQL),
    "derived_debt_to_equity": _pair_sql("debt_to_equity", "long_term_debt", "stockholders_equity", "a.value / b.value", "ratio", "long_term_debt / stockholders_equity", _OTHER_SQL),
    "yoy_growth_revenue": _growth_sql("revenue"),
    "yoy_growth_net_income": _growth_sql("net_income"),
    "free_cash_flow": _pair_sql("free_cash_flow", "operating_cash_flow", "capex", "a.value - b.value", "USD", "operating_cash_flow - capex"),
    "implied_q4": f"""{_with(True)},
w AS (SELECT ticker, metric, fiscal_year, {', '.join(f"max(value) FILTER (WHERE fiscal_period = '{p}') AS v{p}, max(id) FILTER (WHERE fiscal_period = '{p}') AS i{p}" for p in ('FY', 'Q1', 'Q2', 'Q3', 'Q4'))} FROM ids GROUP BY ALL)
SELECT ticker, metric || '_q4' AS name, fiscal_year, 'Q4' AS fiscal_period, round(CASE WHEN vQ4 IS NOT NULL THEN vQ4 ELSE vFY - vQ1 - vQ2 - vQ3 END, {_R}) AS value, 'USD' AS unit,
  CASE WHEN vQ4 IS NOT NULL THEN 'reported' ELSE 'FY - Q1 - Q2 - Q3' END AS formula, CASE WHEN vQ4 IS NOT NULL THEN iQ4 ELSE iFY || '|' || iQ1 || '|' || iQ2 || '|' || iQ3 END AS inputs
FROM w WHERE vQ4 IS NOT NULL OR (vFY IS NOT NULL AND vQ1 IS NOT NULL AND vQ2 IS NOT NULL AND vQ3 IS NOT NULL)""",
    "upsert_latest": f"""WITH {facts_sql()},
u AS (SELECT ticker, metric, round(value, 2) AS value FROM facts WHERE filed < DATE '1997-01-01' UNION ALL SELECT ticker, metric, round(value, 2) + 1.0 AS value FROM facts WHERE filed >= DATE '1997-01-01')
SELECT ticker, metric, count(*) AS n, round(sum(value), 2) AS total FROM u GROUP BY 1, 2""",
}
