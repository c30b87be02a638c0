"""Readers: the driver's tables, and the views of them that stand for facts, prices, portfolios and passages."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task of spread() gets.
ROWS_PER_TASK = 10_000
#: Stand-ins: which order priority plays which metric.
METRIC_OF = {"1-URGENT": "revenue", "2-HIGH": "net_income", "3-MEDIUM": "operating_income", "4-NOT SPECIFIED": "operating_cash_flow", "5-LOW": "capex"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Where that is unset one is made in local mode, as in tests;
    on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, kept in the shared folder for as long as the application runs, by name and the data's folder."""
    path = f"{shared_dir(spark)}/stored/{spark.sparkContext.applicationId}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """df written to a new table of the shared folder and read again, so that what reads it several times doesn't plan it anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to a task for every ROWS_PER_TASK rows, for expressions that cost more than moving a row: a file's row group may be all there is."""
    n = df.count()
    return df.repartition(-(-n // ROWS_PER_TASK)) if n > ROWS_PER_TASK else df


def facts(spark: SparkSession, sf_dir: str, quarters: bool = False) -> DataFrame:
    """Orders as versions of facts: nation = ticker, priority = metric, order = accession, order date = date of filing.

    With quarters, every fourth order reports a fiscal year and the others their calendar quarter."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows
    metric = F.create_map(*[F.lit(x) for kv in METRIC_OF.items() for x in kv])
    period = F.when(F.col("o_orderkey") % 4 == 0, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate"))) if quarters else F.lit("FY")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("ticker"), metric[F.col("o_orderpriority")].alias("metric"), F.col("o_totalprice").alias("value"), F.year("o_orderdate").alias("fiscal_year"),
            period.alias("fiscal_period"), F.col("o_orderkey").cast("string").alias("accession"), F.to_date("o_orderdate").alias("filed"),
        )
    )


_METRIC_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF.items())


def facts_sql(quarters: bool = False) -> str:
    period = "CASE WHEN o_orderkey % 4 = 0 THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END" if quarters else "'FY'"
    return f"""facts AS (SELECT n_name AS ticker, CASE o_orderpriority {_METRIC_SQL} END AS metric, o_totalprice AS value, year(o_orderdate)::INT AS fiscal_year,
  {period} AS fiscal_period, o_orderkey::VARCHAR AS accession, o_orderdate::DATE AS filed
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prices: hour = date, event type = ticker, mean positive value = adjusted close."""
    events = table(spark, sf_dir, "events").where("value > 0").select("ts", "event_type", "value")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("ticker")).agg(F.avg("value").alias("adj_close"))


PRICES_SQL = "prices AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS date, event_type AS ticker, avg(value) AS adj_close FROM events WHERE value > 0 GROUP BY 1, 2)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as portfolios: supplier = name, share of the extended price = weight, the supplier's region = sector."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    per = line.groupBy(F.col("l_orderkey").alias("portfolio_id"), F.col("l_suppkey").alias("name")).agg(F.sum("l_extendedprice").alias("amount"))
    total = per.groupBy("portfolio_id").agg(F.sum("amount").alias("total"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    sector = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("name"), "sector")
    weighed = per.join(total, "portfolio_id").select("portfolio_id", "name", F.round(F.col("amount") / F.col("total"), 12).alias("weight"))
    return weighed.join(sector, "name", "left").select("portfolio_id", "name", "weight", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


POSITIONS_SQL = """per AS (SELECT l_orderkey AS portfolio_id, l_suppkey AS name, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2),
total AS (SELECT portfolio_id, sum(amount) AS total FROM per GROUP BY 1),
positions AS (SELECT per.portfolio_id, per.name, round(amount / total, 12) AS weight, coalesce(r_name, 'Unknown') AS sector
  FROM per JOIN total ON per.portfolio_id = total.portfolio_id LEFT JOIN supplier ON s_suppkey = per.name LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages; doc_id is the order of ties."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("scope"), "text")
