"""Point-in-time facts: every filed version of a value, and what was known on a date.

A fact has ticker, metric, fiscal_year, fiscal_period, accession, filed and value. The latest version is that filed last, the
larger accession where two were filed on one day. `as_of` is inclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD = ["ticker", "metric", "fiscal_period", "fiscal_year"]

# Metrics whose fourth quarter is the year less the other three.
FLOW_METRICS = ["revenue", "net_income", "operating_income", "gross_profit", "operating_cash_flow", "capex"]

# Ratios of two metrics.
RATIOS = {
    "net_margin": ("net_income", "revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "gross_margin": ("gross_profit", "revenue"),
    "debt_to_equity": ("long_term_debt", "stockholders_equity"),
}

#: What names a fact.
FACT_KEY = ["ticker", "metric", "fiscal_year", "fiscal_period", "accession"]


def fact_id(c: str = ""):
    """ticker:metric:period:accession, the id that citations use."""
    col = lambda x: F.col(f"{c}{x}")
    return F.concat_ws(":", col("ticker"), col("metric"), F.concat(col("fiscal_period"), col("fiscal_year").cast("string")), col("accession"))


def known(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    return facts if as_of is None else facts.where(F.col("filed") <= F.lit(as_of).cast("date"))


def latest(facts: DataFrame, as_of: str | None = None, fiscal_year: int | None = None) -> DataFrame:
    """The latest version of each period's value, of one fiscal year if it is given, without a sort: the maximum of (filed, accession)
    carries its row along."""
    facts = facts if fiscal_year is None else facts.where(F.col("fiscal_year") == fiscal_year)
    others = [c for c in facts.columns if c not in PERIOD]
    newest = F.max_by(F.struct(*others), F.struct("filed", "accession"))
    return known(facts, as_of).groupBy(*PERIOD).agg(newest.alias("_v")).select(*PERIOD, "_v.*").select(*facts.columns)


def history(facts: DataFrame, n: int = 5, as_of: str | None = None) -> DataFrame:
    """The n latest fiscal years of each (ticker, metric, period)."""
    w = Window.partitionBy("ticker", "metric", "fiscal_period").orderBy(F.desc("fiscal_year"))
    return latest(facts, as_of).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def versions(facts: DataFrame) -> DataFrame:
    """All versions with their order of filing."""
    w = Window.partitionBy(*PERIOD).orderBy("filed", "accession")
    return facts.withColumn("version", F.row_number().over(w))


def restatements(facts: DataFrame) -> DataFrame:
    """Periods with more than one distinct value."""
    return facts.groupBy(*PERIOD).agg(F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_versions"), F.min_by("value", F.struct("filed", "accession")).alias("first_value"), F.max_by("value", F.struct("filed", "accession")).alias("last_value")).where("n_values > 1")


def restated_from(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """The latest version of each period and, where there is one, its earliest prior version of another value."""
    now = latest(facts, as_of)
    prior = facts.select(*PERIOD, F.col("filed").alias("p_filed"), F.col("accession").alias("p_accession"), F.col("value").alias("p_value"))
    first = (
        now.join(prior, PERIOD).where((F.col("p_filed") < F.col("filed")) & (F.col("p_value") != F.col("value")))
        .groupBy(*PERIOD).agg(F.min_by(F.struct("p_value", "p_accession"), F.struct("p_filed", "p_accession")).alias("p"))
    )
    return now.join(first, PERIOD, "left").select(*PERIOD, "accession", "value", F.col("p.p_value").alias("from_value"), F.col("p.p_accession").alias("from_accession"))


def latest_fiscal_year(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per ticker the last fiscal year with revenue, or without any the last with net income."""
    year = lambda m: F.max(F.when((F.col("metric") == m) & (F.col("fiscal_period") == "FY"), F.col("fiscal_year")))
    return known(facts, as_of).groupBy("ticker").agg(F.coalesce(year("revenue"), year("net_income")).alias("fiscal_year"))


def _wide(facts: DataFrame, by: list[str], key: str, names: list[str], as_of: str | None) -> DataFrame:
    """One row per group with (value, fact_id) of each name: conditional aggregation instead of self-joins."""
    now = latest(facts, as_of).withColumn("_f", F.struct("value", fact_id().alias("id")))
    return now.where(F.col(key).isin(names)).groupBy(*by).agg(*[F.max(F.when(F.col(key) == n, F.col("_f"))).alias(n) for n in names])


def _derived(df: DataFrame, name: str, value, unit: str, formula, inputs: list, period: str = "FY") -> DataFrame:
    out = df.select("ticker", F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), "fiscal_year", F.lit(period).alias("fiscal_period"), value.alias("value"), F.lit(unit).alias("unit"), (F.lit(formula) if isinstance(formula, str) else formula).alias("formula"), F.array(*inputs).alias("inputs"))
    return out.where(F.col("value").isNotNull())


def ratio(facts: DataFrame, name: str, as_of: str | None = None) -> DataFrame:
    """One of RATIOS per ticker and fiscal year; none where an input is missing or the denominator is zero."""
    a, b = RATIOS[name]
    w = _wide(facts.where("fiscal_period = 'FY'"), ["ticker", "fiscal_year"], "metric", [a, b], as_of)
    return _derived(w, name, F.try_divide(F.col(a)["value"], F.col(b)["value"]), "ratio", f"{a} / {b}", [F.col(a)["id"], F.col(b)["id"]])


def growth(facts: DataFrame, metric: str, as_of: str | None = None) -> DataFrame:
    """Change on the fiscal year before; a missing year is not bridged."""
    now = latest(facts.where((F.col("metric") == metric) & (F.col("fiscal_period") == "FY")), as_of).select("ticker", "fiscal_year", "value", fact_id().alias("id"))
    before = now.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("p_value"), F.col("id").alias("p_id"))
    year = F.col("fiscal_year").cast("string")
    formula = F.concat(F.lit(f"{metric}[FY"), year, F.lit(f"] / {metric}[FY"), (F.col("fiscal_year") - 1).cast("string"), F.lit("] - 1"))
    return _derived(now.join(before, ["ticker", "fiscal_year"]), f"{metric}_growth_yoy", F.try_divide("value", "p_value") - 1, "ratio", formula, [F.col("id"), F.col("p_id")])


def free_cash_flow(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    a, b = "operating_cash_flow", "capex"
    w = _wide(facts.where("fiscal_period = 'FY'"), ["ticker", "fiscal_year"], "metric", [a, b], as_of)
    return _derived(w, "free_cash_flow", F.col(a)["value"] - F.col(b)["value"], "USD", f"{a} - {b}", [F.col(a)["id"], F.col(b)["id"]])


def implied_q4(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """The reported fourth quarter of a flow metric, or the year less the other quarters where all four are known."""
    flows = facts.where(F.col("metric").isin(FLOW_METRICS))
    w = _wide(flows, ["ticker", "metric", "fiscal_year"], "fiscal_period", ["FY", "Q1", "Q2", "Q3", "Q4"], as_of)
    v = lambda p: F.col(p)["value"]
    direct = F.col("Q4").isNotNull()
    out = w.select(
        "ticker", F.concat("metric", F.lit("_q4")).alias("name"), "fiscal_year", F.lit("Q4").alias("fiscal_period"), F.when(direct, v("Q4")).otherwise(v("FY") - v("Q1") - v("Q2") - v("Q3")).alias("value"),
        F.lit("USD").alias("unit"), F.when(direct, "reported").otherwise("FY - Q1 - Q2 - Q3").alias("formula"),
        F.when(direct, F.array(F.col("Q4")["id"])).otherwise(F.array(*[F.col(p)["id"] for p in ("FY", "Q1", "Q2", "Q3")])).alias("inputs"),
    )
    return out.where(F.col("value").isNotNull())


def upsert(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """existing with batch written over it by (ticker, metric, fiscal_year, fiscal_period, accession). Within a batch the row with
    the smallest `ord` wins (a column the batch brings along), as the first row written does."""
    key = FACT_KEY
    rest = [c for c in batch.columns if c not in key and c != "ord"]
    new = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("_v")).select(*key, "_v.*")
    if existing is None:
        return new
    return existing.join(new, key, "left_anti").unionByName(new.select(*existing.columns))
