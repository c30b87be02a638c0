"""Keyed state: attempts by timers, keys that are forgotten, restarts."""

import time
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.streaming import ingest, keyed

SCHEMA = "id long, payload string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def handler():
    def handle(row, attempt):
        """What a payload says: fail so many times; null fails always."""
        if row["payload"] is None:
            return "bad: " + "x" * 600
        return None if attempt > int(row["payload"]) else f"attempt {attempt}"

    return handle  # within another function, so that it is sent as it is


def test_messages_are_tried_until_they_pass_or_die(spark, tmp_path):
    path, sink = str(tmp_path / "in"), ingest.Sink(spark, str(tmp_path / "out"))
    put(spark, path, [(i, str(i % 7)) for i in range(40)] + [(3, "3"), (100, None)])
    stream = keyed.attempts(spark.readStream.schema(SCHEMA).parquet(path), "id", handler(), wait_ms=1)
    keyed.run_until_quiet(spark, stream, sink.write, str(tmp_path / "checkpoint"), longest_s=120)
    got = {r["id"]: r for r in sink.read().collect()}
    assert sink.read().count() == 41 == len(got)
    for i in range(40):
        fails = i % 7
        assert (got[i]["outcome"], got[i]["attempts"]) == (("ok", fails + 1) if fails < 5 else ("dead_lettered", 5)), i
    assert got[100]["attempts"] == 5 and len(got[100]["error"]) == 500 and got[6]["error"] == "attempt 5" and got[1]["error"] is None


def test_what_waits_goes_on_after_a_restart(spark, tmp_path):
    path, sink, at = str(tmp_path / "in"), ingest.Sink(spark, str(tmp_path / "out")), str(tmp_path / "checkpoint")
    put(spark, path, [(1, "0"), (2, "2"), (3, None)])
    make = lambda: keyed.attempts(spark.readStream.schema(SCHEMA).parquet(path), "id", handler(), wait_ms=300)
    keyed.run_until_quiet(spark, make(), sink.write, at, empty=False, quiet=1, longest_s=120)  # ends while messages wait
    early = {r["id"]: r["attempts"] for r in sink.read().collect()}
    assert early[1] == 1 and 3 not in early
    put(spark, path, [(4, "1"), (3, "0")])  # the repeat of one that waits
    keyed.run_until_quiet(spark, make(), sink.write, at, longest_s=120)
    assert sorted((r["id"], r["outcome"], r["attempts"]) for r in sink.read().collect()) == [(1, "ok", 1), (2, "ok", 3), (3, "dead_lettered", 5), (4, "ok", 2)]


def test_calls_of_the_state_store_follow_groups_not_messages():
    """40,000 messages of one group, by hand: one read and one write of its state, one timer."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload", T.StringType())])
    calls = Counter()

    class Store:
        def __init__(self):
            self.rows, self.timers = [], []

        def __getattr__(self, name):
            def call(*args):
                calls[name] += 1
                if name == "put":
                    self.rows = list(args[0])
                elif name == "clear":
                    self.rows = []
                elif name == "registerTimer":
                    self.timers.append(args[0])
                return {"get": iter(self.rows), "listTimers": iter(self.timers), "getListState": self, "getValueState": self}.get(name)

            return call

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000

        getExpiryTimeInMs = getCurrentProcessingTimeInMs

    p, store = keyed._Attempts(schema, "id", handler(), 5, 10), Store()
    p.init(store)
    out = list(p.handleInputRows((0,), iter([Row("id", "payload")(i, str(i % 2)) for i in range(40_000)]), Now()))
    assert len(out) == 20_000 and len(store.rows) == 20_000 and store.timers == [1010] and sum(calls.values()) < 8
    store.rows = [(*m[:-1], 900) for m in store.rows]
    assert {r["attempts"] for r in p.handleExpiredTimer((0,), Now(), Now())} == {2} and store.rows == [] and sum(calls.values()) < 16


@pytest.mark.parametrize(("keep_ms", "wait", "times"), [(600_000, 0, 1), (400, 1.0, 2)])
def test_keys_are_remembered_for_a_time(spark, tmp_path, keep_ms, wait, times):
    path, sink = str(tmp_path / "in"), ingest.Sink(spark, str(tmp_path / "out"))
    for _ in range(2):
        put(spark, path, [(1, "a"), (1, "a"), (2, "b")])
        stream = keyed.publish_once_for(spark.readStream.schema(SCHEMA).parquet(path), "id", keep_ms)
        keyed.run_until_quiet(spark, stream, sink.write, str(tmp_path / "checkpoint"), empty=False, longest_s=120)
        time.sleep(wait)
    assert sorted(r["id"] for r in sink.read().select(F.col("id")).collect()) == sorted([1, 2] * times)
