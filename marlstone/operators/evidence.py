"""Evidence: facts, derived metrics and risk reports as rows with an id, values and a source; findings and gaps as text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import format_value
from marlstone.operators import pit
from marlstone.operators.normalize import LABELS


def label_case(label: Column) -> Column:
    """Words in lower case, but for those with capitals after their first letter."""
    return F.array_join(F.transform(F.split(label, " "), lambda w: F.when(F.substr(w, F.lit(2)).rlike("[A-Z]"), w).otherwise(F.lower(w))), " ")


def filing_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"))


# Derived metrics and how answers name them.
DERIVED_LABELS = {
    "net_margin": "Net margin", "operating_margin": "Operating margin", "gross_margin": "Gross margin", "debt_to_equity": "Long-term debt to equity",
    "revenue_growth_yoy": "Revenue growth YoY", "net_income_growth_yoy": "Net income growth YoY", "free_cash_flow": "Free cash flow",
}


def _label(labels: dict[str, str], metric="metric"):
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(metric)]


def _unit(facts: DataFrame):
    return F.col("unit") if "unit" in facts.columns else F.lit("USD")


def company(companies: DataFrame | None = None):
    """What to join and how to call a company: its name and ticker, or the ticker alone."""
    return F.col("ticker") if companies is None else F.when(F.col("name").isNotNull(), F.concat("name", F.lit(" ("), "ticker", F.lit(")"))).otherwise(F.col("ticker"))


def fact_evidence(facts: DataFrame, as_of: str | None = None, companies: DataFrame | None = None) -> DataFrame:
    """(id, ticker, metric, fiscal_year, label, values, unit, finding, restated_from[, url]) of each latest fact; values hold what it was
    restated from, restated_from the accession of that. companies: (ticker, name, cik)."""
    now = pit.restated_from(facts, as_of)
    units = pit.latest(facts, as_of).select(*pit.PERIOD, _unit(facts).alias("unit"))
    rows = now.join(units, pit.PERIOD) if "unit" in facts.columns else now.withColumn("unit", F.lit("USD"))
    if companies is not None:
        rows = rows.join(companies.select("ticker", "name", "cik"), "ticker", "left")
    name, was = _label(LABELS), F.col("from_value")
    period = F.concat("fiscal_period", F.lit(" "), F.col("fiscal_year").cast("string"))
    one = F.create_map(F.lit("value"), F.col("value"))
    values = F.when(was.isNull(), one).otherwise(F.map_concat(one, F.create_map(F.lit("originally_reported"), was)))
    note = F.when(was.isNull(), "").otherwise(F.concat(F.lit(" (restated; originally reported as "), format_value(was, F.col("unit")), F.lit(")")))
    line = F.concat(company(companies), F.lit(" "), label_case(name), F.lit(" for "), period, F.lit(" was "), format_value(F.col("value"), F.col("unit")), note, F.lit(" ["), pit.fact_id(), F.lit("]."))
    out = rows.select(pit.fact_id().alias("id"), "ticker", "metric", "fiscal_year", "fiscal_period", F.concat(name, F.lit(", "), period).alias("label"), values.alias("values"), "unit", line.alias("finding"), F.col("from_accession").alias("restated_from"), *([filing_url(F.col("cik"), F.col("accession")).alias("url")] if companies is not None else []))
    return out


def derived_facts(facts: DataFrame, metrics: list[str], as_of: str | None = None) -> DataFrame:
    """The derived metrics of this list that can be worked out, one row each."""
    make = {m: (lambda m=m: pit.ratio(facts, m, as_of)) for m in pit.RATIOS} | {f"{m}_growth_yoy": (lambda m=m: pit.growth(facts, m, as_of)) for m in ("revenue", "net_income")} | {"free_cash_flow": lambda: pit.free_cash_flow(facts, as_of)}
    parts = [make[m]() for m in metrics if m in make]
    out = parts[0] if parts else pit.free_cash_flow(facts.where("false"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def derived_evidence(facts: DataFrame, metrics: list[str], as_of: str | None = None, companies: DataFrame | None = None) -> DataFrame:
    """(id, ticker, metric, fiscal_year, label, values, unit, finding, inputs). A formula with numbers in it stays out of the sentence."""
    rows = derived_facts(facts, metrics, as_of).withColumnRenamed("name", "metric").withColumn("unit", F.when(F.col("metric") == "debt_to_equity", "ratio_x").otherwise(F.col("unit")))
    if companies is not None:
        rows = rows.join(companies.select("ticker", "name"), "ticker", "left")
    name, year = _label(DERIVED_LABELS), F.col("fiscal_year").cast("string")
    did = F.concat_ws(":", "ticker", "metric", F.concat(F.lit("FY"), year))
    formula = F.when(F.regexp_replace("formula", "FY", "").rlike(r"\d"), "").otherwise(F.concat(F.lit(" ("), "formula", F.lit(")")))
    line = F.concat(company(companies), F.lit(" "), label_case(name), F.lit(" for FY "), year, F.lit(" was "), format_value(F.col("value"), F.col("unit")), formula, F.lit(" ["), did, F.lit("]."))
    return rows.select(did.alias("id"), "ticker", "metric", "fiscal_year", F.concat(name, F.lit(", FY "), year).alias("label"), F.create_map(F.lit("value"), F.col("value")).alias("values"), "unit", line.alias("finding"), "inputs")


def fundamentals(facts: DataFrame, asked: DataFrame, metrics: list[str], as_of: str | None = None, companies: DataFrame | None = None) -> DataFrame:
    """(ticker, metric, fiscal_year, id, finding, gap) for each of asked (ticker, fiscal_year) and each metric: a finding or, where there
    is nothing to find, a gap. Without a fiscal year the latest one with revenue is meant; a company without filings has one gap, its
    metric null."""
    year = pit.latest_fiscal_year(facts, as_of).withColumnRenamed("fiscal_year", "_latest")
    who = asked.join(year, "ticker", "left").select("ticker", F.coalesce("fiscal_year", "_latest").alias("fiscal_year"))
    if companies is not None:
        who = who.join(companies.select("ticker", "name"), "ticker", "left")
    who = who.withColumn("_who", company(companies)).select("ticker", "fiscal_year", "_who")
    wanted = who.where("fiscal_year is not null").withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    reported = [m for m in metrics if m in LABELS]
    known = fact_evidence(facts, as_of, companies).where((F.col("fiscal_period") == "FY") & F.col("metric").isin(reported)).select("ticker", "metric", "fiscal_year", "id", "finding")
    known = known.unionByName(derived_evidence(facts, metrics, as_of, companies).select("ticker", "metric", "fiscal_year", "id", "finding"))
    name, fy = _label(LABELS | DERIVED_LABELS), F.col("fiscal_year").cast("string")
    missing = F.when(F.col("metric").isin(reported), F.concat("_who", F.lit(" does not report "), label_case(name), F.lit(" for FY "), fy, F.lit("."))).otherwise(F.concat(name, F.lit(" is not computable for "), "_who", F.lit(" FY "), fy, F.lit(" (an input is not reported).")))
    out = wanted.join(known, ["ticker", "metric", "fiscal_year"], "left").select("ticker", "metric", "fiscal_year", "id", "finding", F.when(F.col("id").isNull(), missing).alias("gap"))
    none = who.where("fiscal_year is null").select("ticker", F.lit(None).cast("string").alias("metric"), "fiscal_year", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("finding"), F.concat(F.lit("No filings for "), "ticker", F.lit(f" on or before {as_of}." if as_of else ".")).alias("gap"))
    return out.unionByName(none)


def gaps(facts: DataFrame, tickers: DataFrame, metrics: list[str], fiscal_year: int, as_of: str | None = None) -> DataFrame:
    """(ticker, metric, gap): what was asked for and isn't reported; tickers and metrics are the question's own."""
    have = pit.known(facts, as_of).where((F.col("fiscal_year") == fiscal_year) & (F.col("fiscal_period") == "FY")).select("ticker", "metric").distinct()
    asked = tickers.select("ticker", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    return asked.join(have, ["ticker", "metric"], "left_anti").select("ticker", "metric", F.concat("ticker", F.lit(" does not report "), label_case(_label(LABELS)), F.lit(f" for FY {fiscal_year}.")).alias("gap"))


def risk_evidence(report: DataFrame) -> DataFrame:
    """Long rows (id, label, values) from a wide report (risk_id, var, es, observations, exceptions, ticker, weight, share), one row
    per position: one row of VaR, one of the backtest, one per position."""
    head = report.groupBy("risk_id").agg(*[F.first(c).alias(c) for c in ("var", "es", "observations", "exceptions")])
    num = lambda *cs: F.create_map(*[x for c in cs for x in (F.lit(c), F.col(c).cast("double"))])
    two = head.select(F.explode(F.array(F.struct(F.concat("risk_id", F.lit(":var")).alias("id"), F.lit("Portfolio VaR").alias("label"), num("var", "es").alias("values")), F.struct(F.concat("risk_id", F.lit(":backtest")).alias("id"), F.lit("Historical VaR backtest (Kupiec POF)").alias("label"), num("observations", "exceptions").alias("values")))).alias("e")).select("e.*")
    return two.unionByName(report.select(F.concat_ws(":", "risk_id", "ticker").alias("id"), F.concat("ticker", F.lit(" position risk")).alias("label"), num("weight", "share").alias("values")))


def merge(evidence: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per id: the last one written, at the place of the first."""
    rest = [c for c in evidence.columns if c not in (key, order)]
    return evidence.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("_v")).select(key, order, "_v.*")


# What a row of evidence holds.
EVIDENCE = {"id": "string", "label": "string", "unit": "string", "values": "map<string,double>", "excerpt": "string"}


def appended(*tools: DataFrame) -> DataFrame:
    """(tool_order, id, label, unit, values, excerpt): the evidence of tools one after the other. What a tool does not give is null; ids
    are unique within a tool."""
    parts = [df.select(F.lit(i).alias("tool_order"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EVIDENCE.items()]) for i, df in enumerate(tools)]
    return reduce(DataFrame.unionByName, parts)


def merged(evidence: DataFrame) -> DataFrame:
    """appended() with one row per id: what the last tool says of it, at the place of the first (tool_order, then id)."""
    out = merge(evidence.withColumn("seq", F.struct("tool_order", "id")).drop("tool_order"))
    return out.select(F.col("seq")["tool_order"].alias("tool_order"), *EVIDENCE)


@F.pandas_udf(T.StringType())
def _six_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda pairs: ", ".join(f"{k}={v:.6g}" for k, v in dict(pairs or {}).items()))


def digest(evidence: DataFrame, most: int = 300) -> DataFrame:
    """(id, line): evidence (id, label, unit, values, excerpt) as a line of a prompt; values have six digits, excerpts `most` characters."""
    quote = F.when(F.length("excerpt") > 0, F.concat(F.lit(' excerpt="'), F.substring("excerpt", 1, most), F.lit('"'))).otherwise("")
    line = F.concat(F.lit("- ["), "id", F.lit("] "), "label", F.lit(" ("), F.coalesce("unit", F.lit("")), F.lit(") "), _six_digits("values"), quote)
    return evidence.select("id", line.alias("line"))


def answer(findings: DataFrame) -> DataFrame:
    """(question, answer): findings (question, tool_order, position, text) joined in order."""
    return findings.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool_order", "position", "text"))), lambda x: x["text"]), " ").alias("answer"))
