"""The data source of landed filings: retries, partitions, offsets."""

import os

import pytest

from marlstone.sources import filings
from marlstone.streaming import ingest


def tried(statuses, **kw):
    calls, waits = [], []

    def get(attempt):
        calls.append(attempt)
        return (statuses[attempt], b"x") if attempt < len(statuses) else (200, b"ok")

    out = filings.fetch(get, "f", sleep=waits.append, draw=lambda low, high: high, **kw)
    return out, calls, waits


def test_what_may_pass_is_tried_again_with_growing_waits():
    assert tried([]) == ((1, b"ok"), [0], [])
    assert tried([503, 429, 0]) == ((4, b"ok"), [0, 1, 2, 3], [0.5, 1.0, 2.0])
    assert tried([500] * 7, retries=8)[2] == [0.5, 1.0, 2.0, 4.0, 8.0, 8.0, 8.0]
    with pytest.raises(filings.FilingError, match="503 after 5 attempts"):
        tried([503] * 9)


@pytest.mark.parametrize("status", [400, 403, 404, 410])
def test_other_failures_are_not_tried_again(status):
    seen = []
    with pytest.raises(filings.FilingError, match=f"status {status}$"):
        filings.fetch(lambda n: (seen.append(n), (status, b""))[1], "f", sleep=seen.append)
    assert seen == [0]


def landed(spark, path, rows):
    filings.land(spark.createDataFrame(rows, "ticker string, accession string, html string, faults array<int>"), path)


def test_files_are_dealt_by_bytes(spark, tmp_path):
    filings.register(spark)
    landed(spark, str(tmp_path), [("T", f"a_{i}", "é" * 100 * i, [503] * (i % 3)) for i in range(9)] + [("T", "null", None, None)])
    df = spark.read.format("landed_filings").option("inject", "true").option("wait", "0").option("partition_bytes", "900").load(str(tmp_path))
    got = {r["accession"]: r for r in df.collect()}
    assert {a: (r["attempts"], len(r["html"])) for a, r in got.items()} == {**{f"a_{i}": (1 + i % 3, 100 * i) for i in range(9)}, "null": (1, 0)}
    assert df.rdd.getNumPartitions() > 3
    assert spark.read.format("landed_filings").load(str(tmp_path / "nowhere")).count() == 0
    landed(spark, str(tmp_path), [("T", "gone", "x", [404])])
    with pytest.raises(Exception, match="status 404"):
        spark.read.format("landed_filings").option("inject", "true").load(str(tmp_path)).collect()


def test_a_stream_that_starts_again_misses_nothing(spark, tmp_path):
    filings.register(spark)
    path, sink = str(tmp_path / "in"), ingest.Sink(spark, str(tmp_path / "out"))
    stream = lambda: spark.readStream.format("landed_filings").option("wait", "0").load(path).select("accession")
    go = lambda: ingest.run(stream(), sink.write, str(tmp_path / "checkpoint"))
    seen = lambda: sorted(r[0] for r in sink.read().collect())
    at = 1_700_000_000_123_456_789
    landed(spark, path, [("T", "b", "1", None), ("T", "c", "2", None)])
    for n in "bc":
        os.utime(f"{path}/T_{n}.html", ns=(at, at))
    go()
    assert seen() == ["b", "c"]
    landed(spark, path, [("T", "a", "3", None), ("T", "d", "4", None)])
    os.utime(f"{path}/T_a.html", ns=(at, at))  # at the same instant as those that were read, with a smaller name
    go()
    go()
    assert seen() == ["a", "b", "c", "d"]

    def fails(batch, i):
        batch.collect()
        raise RuntimeError("lost")

    landed(spark, path, [("T", "e", "5", None)])
    with pytest.raises(Exception, match="lost"):
        ingest.run(stream(), fails, str(tmp_path / "checkpoint"))
    landed(spark, path, [("T", "f", "6", None)])
    go()  # the batch that failed, as it was planned
    assert seen() == ["a", "b", "c", "d", "e"]
    go()
    assert seen() == ["a", "b", "c", "d", "e", "f"]
