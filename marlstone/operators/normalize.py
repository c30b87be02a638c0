"""Filed facts from nested company-facts JSON, and flattened filing lists.

A payload row is (ticker, json). The JSON is parsed to maps, only curated concepts are kept before anything is exploded, and every
decision is a window or an aggregate over explicit positions: which row comes first never depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric, unit and concepts in order of priority.
METRICS = {
    "revenue": ("USD", ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenuesNetOfInterestExpense"]),
    "net_income": ("USD", ["NetIncomeLoss", "ProfitLoss"]),
    "operating_income": ("USD", ["OperatingIncomeLoss"]),
    "gross_profit": ("USD", ["GrossProfit"]),
    "operating_cash_flow": ("USD", ["NetCashProvidedByUsedInOperatingActivities"]),
    "capex": ("USD", ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]),
    "total_assets": ("USD", ["Assets"]),
    "total_liabilities": ("USD", ["Liabilities"]),
    "stockholders_equity": ("USD", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    "cash": ("USD", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
    "long_term_debt": ("USD", ["LongTermDebt", "LongTermDebtNoncurrent"]),
    "eps_diluted": ("USD/shares", ["EarningsPerShareDiluted"]),
}
# How answers name the metrics.
LABELS = {
    "revenue": "Revenue", "net_income": "Net income", "operating_income": "Operating income", "gross_profit": "Gross profit", "operating_cash_flow": "Operating cash flow",
    "capex": "Capital expenditures", "total_assets": "Total assets", "total_liabilities": "Total liabilities", "stockholders_equity": "Stockholders' equity",
    "cash": "Cash and equivalents", "long_term_debt": "Long-term debt", "eps_diluted": "Diluted EPS",
}
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]
ANNUAL_DAYS, QUARTER_DAYS = (350, 380), (80, 100)

_ROW = "struct<start:string,end:string,val:double,accn:string,fy:string,fp:string,form:string,filed:string>"
PAYLOAD = f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{_ROW}>>>>>>"


def duration_class(start, end):
    """instant without a start; annual or quarter by days, both bounds included; else null (year to date)."""
    days = F.datediff(end, start)
    return F.when(start.isNull(), "instant").when(days.between(*ANNUAL_DAYS), "annual").when(days.between(*QUARTER_DAYS), "quarter")


def concepts(spark) -> DataFrame:
    """The curated concepts: (metric, metric_order, unit, concept, priority), 19 rows."""
    rows = [(m, i, unit, c, p) for i, (m, (unit, names)) in enumerate(METRICS.items()) for p, c in enumerate(names)]
    return F.broadcast(spark.createDataFrame(rows, "metric string, metric_order int, unit string, concept string, priority int"))


def rows_of(payloads: DataFrame) -> DataFrame:
    """Curated rows of (ticker, json) with their place in the payload."""
    spark = payloads.sparkSession
    wanted = F.array(*[F.lit(c) for _, names in METRICS.values() for c in names])
    gaap = F.from_json("json", PAYLOAD)["facts"]["us-gaap"]
    kept = payloads.select("ticker", F.explode(F.map_filter(gaap, lambda k, v: F.array_contains(wanted, k))).alias("concept", "c"))
    units = kept.select("ticker", "concept", F.explode("c.units").alias("unit", "rows"))
    flat = units.join(concepts(spark), ["concept", "unit"]).select("ticker", "concept", "unit", "metric", "metric_order", "priority", F.posexplode("rows").alias("pos", "r"))
    date = lambda x: F.try_to_date(F.col(f"r.{x}"))
    out = flat.where(F.col("r.form").isin(FORMS)).select("*", date("start").alias("period_start"), date("end").alias("period_end"), date("filed").alias("filed"), F.col("r.accn").alias("accession"), F.col("r.form").alias("form"), F.col("r.val").alias("value"), F.expr("try_cast(r.fy as int)").alias("fy"), F.col("r.fp").alias("fp"))
    return out.drop("r").withColumn("class", duration_class(F.col("period_start"), F.col("period_end")))


def normalize(payloads: DataFrame) -> DataFrame:
    """Every version of every curated metric; rows without a fiscal year of their own filing are left out (see rejects)."""
    rows = rows_of(payloads).withColumn("report_end", F.max("period_end").over(Window.partitionBy("ticker", "accession")))
    place = F.struct("metric_order", "priority", "pos")
    period = F.when((F.col("class") == "quarter") & (F.col("fp") == "FY"), "Q4").when((F.col("class") == "annual") | ((F.col("class") == "instant") & F.col("form").startswith("10-K")), "FY").otherwise(F.col("fp"))
    own = rows.where((F.col("period_end") == F.col("report_end")) & F.col("class").isNotNull() & F.col("fy").isNotNull())
    labels = own.groupBy("ticker", "period_end", "class").agg(F.min_by(F.struct(F.col("fy").alias("fiscal_year"), period.alias("fiscal_period")), place).alias("l")).select("ticker", "period_end", "class", "l.*")
    named = rows.where(F.col("class").isNotNull()).join(labels, ["ticker", "period_end", "class"])
    # an alias that names a period for an accession shuts out the ones after it, and the first of its rows stands: one minimum
    # (a null start is one group of its own)
    rest = ["concept", "unit", "value", "class", "fiscal_year", "fiscal_period", "form", "filed"]
    first = named.groupBy("ticker", "metric", "period_start", "period_end", "accession").agg(F.min_by(F.struct(*rest), F.struct("priority", "pos")).alias("f"))
    kind = F.when(F.col("f.class") == "instant", "instant").otherwise("duration").alias("period_type")
    return first.select("ticker", "metric", "f.concept", "f.unit", "f.value", kind, "period_start", "period_end", "f.fiscal_year", "f.fiscal_period", "f.form", "accession", "f.filed")


def rejects(payloads: DataFrame) -> DataFrame:
    """Rows whose fiscal year is no number: for the dead-letter table."""
    return rows_of(payloads).where(F.col("fy").isNull())


def recent_filings(submissions: DataFrame, forms: list[str] = ("10-K", "10-Q")) -> DataFrame:
    """Filings from (ticker, json) whose recent filings are parallel arrays; the shortest array ends the list, order is kept."""
    names = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument"]
    schema = "struct<filings:struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in names) + ">>>"
    recent = submissions.select("ticker", F.from_json("json", schema)["filings"]["recent"].alias("r"))
    shortest = F.least(*[F.size(f"r.{n}") for n in names])
    zipped = F.slice(F.arrays_zip(*[F.col(f"r.{n}").alias(n) for n in names]), F.lit(1), F.greatest(shortest, F.lit(0)))
    out = recent.select("ticker", F.posexplode(zipped).alias("position", "f")).select("ticker", "position", *[F.col(f"f.{n}").alias(n) for n in names])
    return out.where(F.col("form").isin(list(forms)))


def newest(filings: DataFrame, n: int = 4) -> DataFrame:
    """The first n filings of each company's list."""
    return filings.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("position"))).where(F.col("_k") <= n).drop("_k")
