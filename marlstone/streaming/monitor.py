"""Replicas that are watched while they run: what each has applied, how long ago it last read its log, and whether that is too long.

follow() starts a replica as a streaming query that goes on; its decoded facts are observed on their way, so that counts cost no job
of their own. ReplicaMonitor listens to the queries of a session. keep_following() starts a replica again after a failure, with
waits that double; it goes on from its checkpoint, so nothing is missed and nothing applied twice.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marlstone.streaming import ingest

OBSERVED = "replica"
STATUS = "replica string, rows long, newest string, batch long, failures int, lag_s double, healthy boolean"
LONGEST_WAIT = 30.0


class ReplicaMonitor(StreamingQueryListener):
    """Per named query: rows that its batches brought, the newest time among them, the last batch, failures, and seconds since its
    last successful read (a read that found nothing counts). A replica is healthy while that is no more than stale_after; one that
    has not read yet is not. Add it by spark.streams.addListener."""

    def __init__(self, stale_after: float = ingest.STALE_AFTER, clock: Callable[[], float] = time.monotonic):
        self.stale_after, self.clock = stale_after, clock
        self._changed, self._names, self._seen = threading.Condition(), {}, {}

    def _note(self, name: str | None, **what) -> None:
        with self._changed:
            if name is not None:
                self._seen.setdefault(name, {"rows": 0, "newest": None, "batch": -1, "failures": 0, "ok": None, "running": False}).update(what)
            self._changed.notify_all()

    def onQueryStarted(self, event) -> None:
        with self._changed:
            self._names[str(event.runId)] = event.name
        self._note(event.name, running=True)

    def onQueryProgress(self, event) -> None:
        p, what = event.progress, {"ok": self.clock()}
        before = self._seen.get(p.name, {"batch": -1, "rows": 0, "newest": None})
        if p.batchId > before["batch"] and OBSERVED in p.observedMetrics:  # a batch that runs again after a restart is counted once
            got = p.observedMetrics[OBSERVED]
            newest = [str(v) for v in (before["newest"], got["newest"]) if v is not None]
            what |= {"batch": p.batchId, "rows": before["rows"] + got["rows"], "newest": max(newest, default=None)}
        self._note(p.name, **what)

    def onQueryIdle(self, event) -> None:
        self._note(self._names.get(str(event.runId)), ok=self.clock())

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), None)
        failed = event.exception is not None
        self._note(name, running=False, failures=self._seen.get(name, {"failures": 0})["failures"] + failed)

    def wait(self, test: Callable[[dict], bool], name: str, longest_s: float = 60) -> dict:
        """Until test holds of what is known of a replica (events arrive a little after what they tell of); TimeoutError after longest_s."""
        with self._changed:
            if not self._changed.wait_for(lambda: name in self._seen and test(self._seen[name]), longest_s):
                raise TimeoutError(f"{name}: {self._seen.get(name)}")
            return dict(self._seen[name])

    def status(self, spark: SparkSession) -> DataFrame:
        """STATUS, a row per replica; lag_s is null before the first read."""
        now = self.clock()
        with self._changed:
            lags = {n: None if v["ok"] is None else float(now - v["ok"]) for n, v in self._seen.items()}
            rows = [(n, v["rows"], v["newest"], v["batch"], v["failures"], lags[n], lags[n] is not None and lags[n] <= self.stale_after) for n, v in self._seen.items()]
        return spark.createDataFrame(sorted(rows), STATUS)


def follow(spark: SparkSession, log_path: str, schema: T.StructType, store: ingest.Snapshots, checkpoint: str, name: str, at: str, every: str | None = "1 second") -> StreamingQuery:
    """Start a replica of the log in a store under a name; `at` is the column whose newest value is told. every None: what is there now."""
    facts = ingest.decode(spark.readStream.text(log_path), schema)
    seen = facts.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.max(at).cast("string").alias("newest")).withColumn("ord", F.lit(0))
    writer = seen.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(store.apply)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def keep_following(start: Callable[[], StreamingQuery], stop: threading.Event, wait: Callable[[float], object] | None = None) -> int:
    """Run start()'s query until stop is set and start it again whenever it fails, after 1, 2, 4 ... LONGEST_WAIT seconds; a batch
    that went well resets the wait. Gives the number of failures."""
    failures = in_a_row = 0
    while not stop.is_set():
        query = start()
        try:
            while not query.awaitTermination(0.1) and not stop.is_set():
                pass
            if query.exception() is None:
                query.stop()
                return failures
            raise query.exception()
        except StreamingQueryException:
            failures += 1
            in_a_row = 1 if query.lastProgress is not None else in_a_row + 1
            (wait or stop.wait)(min(LONGEST_WAIT, 2.0 ** (in_a_row - 1)))
    return failures
