"""Ingestion as Structured Streaming: publish once, retry and dead-letter, idempotent upserts into snapshots.

Offsets and state live in the checkpoint, outputs are written per batch id: a batch that runs twice writes the same snapshot again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import pit

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
MAX_DELIVERIES = 5
MOST_RUNS = 8
PART_BYTES = 128 << 20
STALE_AFTER = 60


def events_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, at most per_trigger files at once; ts becomes TIMESTAMP, which watermarks need."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def publish_once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first event of each key, however late; the state holds every key that was seen."""
    return events.dropDuplicates([key])


def counts_by_window(events: DataFrame, every: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window"), "event_type", "n")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, batch by batch, then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


class Sink:
    """A table that grows by batches, a folder for each: a batch that runs twice writes its folder again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")


class Snapshots:
    """A table of facts by key (pit.FACT_KEY) in runs, oldest first; a row of a newer run hides that of an older one.

    A batch writes a run of its own rows, so what is written follows the batch, whatever the table's size and however many of its rows
    one ticker has. compact() joins the newest runs into one as long as an older one is no larger than twice all that are newer, so
    sizes grow geometrically and a row is rewritten as often as its run doubles. Joined runs are cut into files by ranges of the key
    of about PART_BYTES each and sorted, so a hot ticker has many files and a reader of one ticker skips the others'.

    A pointer file names the current runs; the one with the largest number counts, so there is one at any time, also after a crash
    between two steps. A batch id that was applied is not applied again. Empty batches leave the version as it is. One writer at a
    time; readers keep what they have opened until vacuum()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names("pointers") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _load(self, pointer: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{pointer}", wholetext=True).collect()[0][0])  # one small file

    def state(self) -> dict:
        whole = self._pointers()
        return self._load(whole[-1]) if whole else {"number": 0, "version": 0, "batch": -1, "runs": []}

    def read(self, runs: list[dict] | None = None) -> DataFrame | None:
        """The table, or what these runs in a row make of it. The oldest run is not shuffled while the others' keys are few."""
        runs = self.state()["runs"] if runs is None else runs
        if not runs:
            return None
        base, *newer = (self.spark.read.parquet(f"{self.path}/{r['folder']}") for r in runs)
        if not newer:
            return base
        key, rest = pit.FACT_KEY, [c for c in base.columns if c not in pit.FACT_KEY]
        rows = reduce(DataFrame.unionByName, (df.withColumn("_n", F.lit(i)) for i, df in enumerate(newer)))
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_n").alias("_v")).select(*key, "_v.*")
        hidden = rows.select(*[F.col(c).alias(f"_{c}") for c in key])
        kept = base.join(hidden, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key)), "left_anti")
        return kept.unionByName(rows)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Upsert a batch; the version grows only if the batch has rows."""
        now = self.state()
        if batch_id <= now["batch"]:
            return
        after = now | {"number": now["number"] + 1, "batch": batch_id}
        run = self._write(pit.upsert(None, batch), after["number"])
        if not self.read([run]).isEmpty():
            after |= {"version": now["version"] + 1, "runs": [*now["runs"], run]}
        self._point(after)
        if len(after["runs"]) > MOST_RUNS:
            self.compact()

    def compact(self) -> None:
        """Join the newest runs; the rows and the version stay."""
        now = self.state()
        runs, size = now["runs"], 0
        first = len(runs)
        while first and (len(runs) - first < 2 or runs[first - 1]["bytes"] <= 2 * size):
            first -= 1
            size += runs[first]["bytes"]
        if len(runs) - first < 2:
            return
        rows = self.read(runs[first:]).repartitionByRange(-(-size // PART_BYTES), *pit.FACT_KEY).sortWithinPartitions(*pit.FACT_KEY)
        number = now["number"] + 1
        self._point(now | {"number": number, "runs": [*runs[:first], self._write(rows, number)]})

    def vacuum(self, keep: int = 2) -> None:
        """Delete the runs that none of the newest `keep` pointers names, and older pointers. For the writer, between batches."""
        whole = self._pointers()
        named = {r["folder"] for n in whole[-keep:] for r in self._load(n)["runs"]}
        for name in [f"pointers/{n}" for n in whole[:-keep]] + [f for n in self._names("data") if (f := f"data/{n}") not in named]:
            fs, p = self._fs(name)
            fs.delete(p, True)

    def _write(self, df: DataFrame, number: int) -> dict:
        folder = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        fs, p = self._fs(folder)
        return {"folder": folder, "bytes": fs.getContentSummary(p).getLength()}

    def _point(self, state: dict) -> None:
        fs, new = self._fs(f"pointers/.new-{uuid.uuid4().hex[:8]}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, p = self._fs(f"pointers/{state['number']:012d}.json")
        if not fs.rename(new, p):
            raise RuntimeError(f"pointer {p} is there already: two writers")


def split(messages: DataFrame, good, error) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ok, retry, dead) of (…, attempts): what is not good is tried again until its MAX_DELIVERIES-th attempt, then it is dead."""
    rows = messages.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).withColumn("_ok", F.coalesce(good, F.lit(False)))
    bad = rows.where("not _ok").withColumn("error", F.substring(error, 1, 500))
    return rows.where("_ok").drop("_ok"), bad.where(F.col("attempts") < MAX_DELIVERIES).drop("_ok"), bad.where(F.col("attempts") >= MAX_DELIVERIES).drop("_ok")


def enrich(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Events with the facts of their accession: a static table beside a stream, or two tables."""
    return events.join(facts, "accession")


def messages(facts: DataFrame) -> DataFrame:
    """(value): a JSON message per accession with its facts, as replicas read them."""
    row = F.struct(*sorted(c for c in facts.columns if c != "accession"))
    return facts.groupBy("accession").agg(F.sort_array(F.collect_list(row)).alias("facts")).select(F.to_json(F.struct("accession", "facts")).alias("value"))  # one filing's facts


def decode(log: DataFrame, schema: T.StructType) -> DataFrame:
    """Facts of messages(), from (value); schema is that of the facts. What is no message is left out."""
    row = T.StructType([schema[c] for c in sorted(schema.names) if c != "accession"])
    whole = T.StructType([T.StructField("accession", T.StringType()), T.StructField("facts", T.ArrayType(row))])
    parsed = log.select(F.from_json("value", whole).alias("m")).where(F.col("m.accession").isNotNull() & F.col("m.facts").isNotNull())
    return parsed.select("m.accession", F.inline("m.facts"))


def replicate(spark: SparkSession, log_path: str, schema: T.StructType, store: Snapshots, checkpoint: str) -> None:
    """A replica: reads the log of messages from its start, or from where its checkpoint stands, and applies it to a store."""
    log = spark.readStream.text(log_path)
    run(log, lambda b, i: store.apply(decode(b, schema).withColumn("ord", F.lit(0)), i), checkpoint)


def health(seen: DataFrame, by: str, now, stale_after: int = STALE_AFTER) -> DataFrame:
    """(by, lag_s, healthy): seconds since each replica last applied something (ts)."""
    lag = (F.unix_micros(F.lit(now) if isinstance(now, str) else now) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 1e6
    return seen.groupBy(by).agg(F.greatest(F.lit(0.0), lag).alias("lag_s")).withColumn("healthy", F.col("lag_s") <= stale_after)


def backoff(failures):
    """Seconds to wait after so many failures in a row: 1, 2, 4 ... 30."""
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1))


def retained(log: DataFrame, n: int, *newest) -> DataFrame:
    """The newest n entries of a log."""
    return log.orderBy(*newest).limit(n)
