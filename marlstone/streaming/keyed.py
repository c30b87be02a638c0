"""Streams by keyed state: messages tried again by timers, first events remembered for a time.

Both are one streaming query each, over transformWithState. State lives in RocksDB (PROVIDER, set for the session), so it may be
larger than memory, and in the checkpoint, so a query that starts again goes on with it.

* attempts(): a message that can't be handled is kept with the number of its attempts and the time of the next; when that is due, it is
  tried again, until it is handled or has failed MAX_DELIVERIES times. A message that is handled at once takes no state. Messages are
  grouped by a hash of their key, and a group's waiting messages are read and written at once: what Python asks of the state store
  follows the number of groups, not that of messages.
* publish_once_for(): the first event of a key passes and the key is remembered for `keep` of processing time, then forgotten, so
  that state is bounded by the keys of that time; a repeat that comes later passes again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from marlstone.streaming.ingest import MAX_DELIVERIES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LONGEST_WAIT_MS = 30_000
LONGEST_ERROR = 500
#: Groups of messages that attempts() keeps together.
GROUPS = 256
_OUTCOME = [T.StructField("outcome", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]


class _Attempts(StatefulProcessor):
    def __init__(self, schema: T.StructType, key: str, handle: Callable[[Row, int], str | None], most: int, wait_ms: int):
        self.schema, self.at, self.handle_message, self.most, self.wait_ms = schema, schema.names.index(key), handle, most, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([*self.schema.fields, T.StructField("_attempts", T.IntegerType()), T.StructField("_due", T.LongType())]))

    def _try(self, message: tuple, attempts: int, now: int, kept: list[tuple]) -> Iterator[Row]:
        error = self.handle_message(Row(*self.schema.names)(*message), attempts)
        if error is not None and attempts < self.most:
            kept.append((*message, attempts, now + max(1, min(LONGEST_WAIT_MS, self.wait_ms * 2 ** (attempts - 1)))))
            return
        yield Row(*self.schema.names, *(f.name for f in _OUTCOME))(*message, "ok" if error is None else "dead_lettered", attempts, error if error is None else error[:LONGEST_ERROR])

    def _keep(self, kept: list[tuple], timers: list[int]) -> None:
        """Store what waits; the earliest of it has a timer, if none is set that comes sooner."""
        if not kept:
            self.waiting.clear()
            return
        self.waiting.put(kept)
        due = min(m[-1] for m in kept)
        if not timers or min(timers) > due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(m) for m in self.waiting.get()]
        seen, new, now = {m[self.at] for m in before}, [], timerValues.getCurrentProcessingTimeInMs()
        for row in rows:
            message = tuple(row)[: len(self.schema)]
            if message[self.at] not in seen:  # repeats of a message are one, and one that waits is not tried by its repeat
                seen.add(message[self.at])
                yield from self._try(message, 1, now, new)
        if new:
            self._keep(before + new, list(self.handle.listTimers()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, kept = timerValues.getCurrentProcessingTimeInMs(), []
        for m in [tuple(m) for m in self.waiting.get()]:
            if m[-1] <= now:
                yield from self._try(m[:-2], m[-2] + 1, now, kept)
            else:
                kept.append(m)
        self._keep(kept, [t for t in self.handle.listTimers() if t > expiredTimerInfo.getExpiryTimeInMs()])

    def close(self) -> None:
        pass


def attempts(messages: DataFrame, key: str, handle: Callable[[Row, int], str | None], most: int = MAX_DELIVERIES, wait_ms: int = 1000, groups: int = GROUPS) -> DataFrame:
    """messages with outcome (ok, dead_lettered), attempts and error. handle(row, attempt) gives None or what went wrong; the wait before
    another attempt doubles from wait_ms. key names a message; its repeats in a batch or while it waits are one. A task holds the keys that
    one batch has in one of the groups, and what waits there; groups must stay the same for a checkpoint."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType([*messages.schema.fields, *_OUTCOME])
    grouped = messages.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).groupBy("_group")
    return grouped.transformWithState(_Attempts(messages.schema, key, handle, most, wait_ms), schema, "Append", "ProcessingTime")


class _Once(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield next(iter(rows))

    def close(self) -> None:
        pass


def publish_once_for(events: DataFrame, key: str, keep_ms: int) -> DataFrame:
    """An event of each key (any of those that come in one batch), and none of its repeats for keep_ms after it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy(key).transformWithState(_Once(keep_ms), events.schema, "Append", "ProcessingTime")


def run_until_quiet(spark: SparkSession, stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, empty: bool = True, quiet: int = 2, longest_s: float = 600) -> None:
    """Run a query with timers until `quiet` batches in a row have read nothing and, with `empty`, hold no state rows; raise after longest_s.
    (Such a query never ends by itself when all there is now has been read: its clock goes on.)"""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").foreachBatch(each).start()
    began = time.monotonic()
    try:
        while time.monotonic() - began < longest_s:
            if query.awaitTermination(0.2):
                return
            last = query.recentProgress[-quiet:]
            if len(last) == quiet and all(p["numInputRows"] == 0 and not (empty and sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in last):
                return
        raise TimeoutError(f"messages still wait after {longest_s} s")
    finally:
        query.stop()
