"""Readers of landed files and sinks beside them: facts, company payloads, prices, passages; audit and span records.

Nothing here reaches the network: what a service would fetch lies in files already. Files are read with a schema, without a pass to
infer one; where the order of files matters, it is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import normalize, pit

FACT = "ticker string, metric string, concept string, unit string, value double, period_type string, period_start date, period_end date, fiscal_year int, fiscal_period string, form string, accession string, filed date"
CHART = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<adjclose:array<struct<adjclose:array<double>>>>>>>"


def _file():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON files, each an array of them; of rows with one key those of the first file by name, and in it the first, stand."""
    rows = spark.read.schema(FACT).option("multiLine", "true").json(path).withColumn("ord", F.struct(_file().alias("file"), F.monotonically_increasing_id().alias("row")))
    return pit.upsert(None, rows)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, json) of company files, the ticker being the file's name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(_file(), r"^([^.]+)", 1).alias("ticker"), F.col("value").alias("json"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, accession, html) of filings in files named ticker_accession.html."""
    name = _file()
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"^([^_]+)_", 1).alias("ticker"), F.regexp_extract(name, r"_([^.]+)", 1).alias("accession"), F.col("value").alias("html"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, adj_close) from CSV with a header; rows without a price are left out."""
    return spark.read.schema("date timestamp_ntz, ticker string, adj_close double").option("header", "true").csv(path).where("adj_close is not null")


def chart_prices(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, adj_close) from chart JSON: parallel arrays of seconds and prices; nulls are left out, prices have 6 places."""
    r = spark.read.schema(CHART).option("multiLine", "true").json(path).select(F.explode("chart.result").alias("r"))
    pairs = F.arrays_zip(F.col("r.timestamp").alias("at"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("p"))
    flat = r.select(F.col("r.meta.symbol").alias("ticker"), F.explode(pairs).alias("x"))
    return flat.where("x.p is not null").select(F.date_trunc("day", F.timestamp_seconds("x.at")).cast("timestamp_ntz").alias("date"), "ticker", F.round("x.p", 6).alias("adj_close"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(scope, doc, text) from JSON lines (ticker, passage_id, text); doc numbers them by file and place, the order of ties."""
    rows = spark.read.schema("ticker string, passage_id string, text string").json(path)
    return rows.select(F.col("ticker").alias("scope"), F.monotonically_increasing_id().alias("doc"), "passage_id", "text", _file().alias("file"))


def write_fixture(payload_rows: DataFrame, path: str, since: int = 2019) -> None:
    """Normalised facts from the fiscal year `since` on, as JSON files by ticker, in order within each."""
    rows = normalize.normalize(payload_rows).where(F.col("fiscal_year") >= since)
    ordered = rows.repartition("ticker").sortWithinPartitions("ticker", "metric", "period_end", "filed", "accession")
    ordered.withColumn("_t", F.col("ticker")).write.mode("overwrite").partitionBy("_t").json(path)


def append_records(records: DataFrame, path: str, at: str = "ts") -> None:
    """Audit or span records, appended by day; a record gets the digest of its question where it has one."""
    more = records.withColumn("question_sha256", question_digest(F.col("question"))) if "question" in records.columns else records
    more.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(path)


def question_digest(question):
    return F.sha2(question.cast("binary"), 256)


def cache_key(data_version, *parts):
    """One digest of a request and the version of the data it is answered from: a new version misses the cache."""
    return F.sha2(F.concat_ws("\x1f", data_version.cast("string"), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"), 256)
