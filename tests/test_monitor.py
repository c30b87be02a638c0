"""Replicas under watch: progress, idle reads, stale and recovered, failures and restarts."""

import threading
import uuid

import pytest

from marlstone.streaming import ingest, monitor

FACTS = "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, value double, filed string"


def fact(i, value=1.0):
    return (f"T{i}", "revenue", 2020, "FY", f"a{i}", float(value), f"2024-01-{i + 1:02d}")


@pytest.fixture
def watch(spark):
    now = [100.0]
    w = monitor.ReplicaMonitor(60, lambda: now[0])
    w.now = now
    spark.streams.addListener(w)
    yield w
    spark.streams.removeListener(w)


def publish(spark, path, *facts):
    ingest.messages(spark.createDataFrame(facts, FACTS)).coalesce(1).write.mode("append").text(path)


def test_a_replica_while_it_runs(spark, tmp_path, watch):
    path, name, store = str(tmp_path / "log"), uuid.uuid4().hex, ingest.Snapshots(spark, str(tmp_path / "store"))
    schema = spark.createDataFrame([fact(0)], FACTS).schema
    status = lambda: {r["replica"]: r for r in watch.status(spark).collect()}[name]
    publish(spark, path, fact(1), fact(2))
    query = monitor.follow(spark, path, schema, store, str(tmp_path / "checkpoint"), name, "filed", "200 milliseconds")
    try:
        watch.wait(lambda v: v["rows"] == 2, name)
        assert (status()["newest"], status()["healthy"], store.state()["version"]) == ("2024-01-03", True, 1)
        publish(spark, path, fact(0, 5.0))  # older, and it is the newest that counts
        watch.wait(lambda v: v["rows"] == 3, name)
        assert (status()["newest"], store.state()["version"]) == ("2024-01-03", 2)
    finally:
        query.stop()
    watch.wait(lambda v: not v["running"], name)
    watch.now[0] += 61
    assert not status()["healthy"] and status()["lag_s"] == 61 and status()["failures"] == 0  # stale: nothing reads
    query = monitor.follow(spark, path, schema, store, str(tmp_path / "checkpoint"), name, "filed", "200 milliseconds")
    try:
        publish(spark, path, fact(7))
        watch.wait(lambda v: v["rows"] == 4, name)
        assert status()["healthy"] and status()["lag_s"] == 0 and status()["newest"] == "2024-01-08"  # recovered, nothing counted twice
    finally:
        query.stop()
    assert sorted(r["accession"] for r in store.read().collect()) == ["a0", "a1", "a2", "a7"]


def test_failures_are_told_and_the_replica_goes_on(spark, tmp_path, watch):
    path, name, store = str(tmp_path / "log"), uuid.uuid4().hex, ingest.Snapshots(spark, str(tmp_path / "store"))
    schema, waits, left, stop = spark.createDataFrame([fact(0)], FACTS).schema, [], [2], threading.Event()
    publish(spark, path, fact(1), fact(2), fact(3))
    apply = store.apply

    def fails_twice(batch, i):
        if left[0]:
            left[0] -= 1
            raise OSError("no store")
        apply(batch, i)
        stop.set()

    store.apply = fails_twice
    failures = monitor.keep_following(lambda: monitor.follow(spark, path, schema, store, str(tmp_path / "checkpoint"), name, "filed", "200 milliseconds"), stop, waits.append)
    assert failures == 2 and waits == [1.0, 2.0]
    assert watch.wait(lambda v: v["failures"] == 2 and not v["running"], name)["failures"] == 2
    assert sorted(r["accession"] for r in store.read().collect()) == ["a1", "a2", "a3"] and store.state()["version"] == 1


def test_one_that_has_not_read_is_not_healthy(spark):
    w = monitor.ReplicaMonitor()
    assert w.status(spark).count() == 0
    w._note("r", running=True)
    assert [(r["lag_s"], r["healthy"]) for r in w.status(spark).collect()] == [(None, False)]
