from pyspark.sql import functions as F

from marlstone.streaming import ingest


def test_snapshots_are_idempotent(spark, tmp_path):
    cols = "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, value double, ord int"
    store = ingest.Snapshots(spark, str(tmp_path / "facts"))
    assert store.read() is None
    row = ("T", "revenue", 2024, "FY", "a")
    store.apply(spark.createDataFrame([(*row, 1.0, 1), (*row, 9.0, 2)], cols), 0)
    assert [r["value"] for r in store.read().collect()] == [1.0]
    store.apply(spark.createDataFrame([(*row, 2.0, 1)], cols), 1)
    store.apply(spark.createDataFrame([(*row, 3.0, 1)], cols), 1)  # replayed batch
    assert [r["value"] for r in store.read().collect()] == [2.0] and store.state()["version"] == 2
    store.apply(spark.createDataFrame([], cols), 2)
    assert store.state()["version"] == 2


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, None, 0), (3, None, 4), (4, "x", None)], "id int, payload string, attempts int")
    ok, retry, dead = ingest.split(df, F.col("payload").isNotNull(), F.lit("e" * 600))
    assert sorted(r["id"] for r in ok.collect()) == [1, 4]
    assert [(r["id"], r["attempts"]) for r in retry.collect()] == [(2, 1)]
    got = dead.collect()
    assert [r["id"] for r in got] == [3] and len(got[0]["error"]) == 500


def test_all_facts_reach_the_snapshot(spark, sf):
    from marlstone.plans import service
    from marlstone.sources.tables import facts

    store, key = service.upserted(spark, sf), ("ticker", "metric", "fiscal_year", "fiscal_period", "accession")
    want, got = facts(spark, sf).select(*key, "value"), store.read().select(*key, "value")
    assert want.where("fiscal_year > 1997").count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and store.state()["version"] == 2


def test_late_events_are_published_once(spark, tmp_path):
    import os

    # late events are told by the watermark of the batch before: the third file is older than the first two, the fourth repeats an id
    for i, rows in enumerate(([(20, 20), (21, 30)], [(22, 40)], [(1, 1), (2, 2)], [(20, 60), (40, 61)])):
        df = spark.createDataFrame(rows, "event_id long, day int").select("event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.parquet(f"{tmp_path}/f{i}")
        for name in os.listdir(f"{tmp_path}/f{i}"):
            os.utime(f"{tmp_path}/f{i}/{name}", (1_700_000_000 + i * 100,) * 2)
    ingest.run(ingest.publish_once(ingest.events_stream(spark, f"{tmp_path}/f*")), lambda b, i: b.select("event_id").write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 20, 21, 22, 40]


FACTS = "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, value double, ord int"


def fact(i, value):
    return (f"T{i}", "revenue", 2020, "FY", "a", float(value), 0)


def test_a_crash_before_the_pointer_moves_loses_nothing(spark, tmp_path, monkeypatch):
    store = ingest.Snapshots(spark, str(tmp_path / "facts"))
    store.apply(spark.createDataFrame([fact(i, i) for i in range(5)], FACTS), 0)
    with monkeypatch.context() as m:
        m.setattr(ingest.Snapshots, "_point", lambda self, state: 1 / 0)
        try:
            store.apply(spark.createDataFrame([fact(1, 100)], FACTS), 1)
        except ZeroDivisionError:
            pass
    (tmp_path / "facts/pointers/.new-dead").write_text("{")  # a pointer that was not finished
    assert store.state()["version"] == 1 and sorted(r["value"] for r in store.read().collect()) == [0, 1, 2, 3, 4]
    store.apply(spark.createDataFrame([fact(1, 100)], FACTS), 1)
    assert store.state()["version"] == 2 and sorted(r["value"] for r in store.read().collect()) == [0, 2, 3, 4, 100]
    runs = store.state()["runs"]
    assert len(runs) == 2 and runs[1]["folder"].startswith("data/000000000002")  # only the batch was written
    store.vacuum(keep=1)
    assert {f"data/{f.name}" for f in (tmp_path / "facts/data").iterdir()} == {r["folder"] for r in runs}  # what the crash left is gone
    assert sorted(r["value"] for r in store.read().collect()) == [0, 2, 3, 4, 100]


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    sink = ingest.Sink(spark, str(tmp_path / "out"))
    for i, rows in ((0, [1, 2]), (1, [3]), (1, [3])):
        sink.write(spark.createDataFrame([(r,) for r in rows], "id int"), i)
    assert sorted(r["id"] for r in sink.read().collect()) == [1, 2, 3]


def test_malformed_messages_do_not_stop_a_replica(spark, tmp_path):
    rows = spark.createDataFrame([("T", "revenue", 2020, "FY", "a", 1.0), ("T", "cash", 2020, "FY", "b", None)], "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, value double")
    (tmp_path / "log").mkdir()
    lines = [r[0] for r in ingest.messages(rows).collect()]
    (tmp_path / "log/0.txt").write_text("\n".join(["no json", lines[0], '{"accession": null}', "", lines[1][:-5], lines[1]]))
    store = ingest.Snapshots(spark, str(tmp_path / "replica"))
    ingest.replicate(spark, str(tmp_path / "log"), rows.schema, store, str(tmp_path / "c"))
    assert sorted((r["accession"], r["value"]) for r in store.read().collect()) == [("a", 1.0), ("b", None)]


def test_lag_does_not_depend_on_the_zone_of_the_session(spark):
    from marlstone.operators import metrics

    df = spark.createDataFrame([("2024-03-10T07:00:00Z",), ("2024-03-10T07:00:00",), ("2024-03-10T08:00:00+01:00",), ("2024-03-10T09:30:00",), ("garbage",), (None,)], "a string")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in df.select(metrics.lag_seconds(F.col("a"), F.timestamp_micros(F.lit(1_710_054_060_000_000)))).collect()]
            assert got == [60.0, 60.0, 60.0, 0.0, None, None], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_backoff_and_counters(spark):
    from marlstone.operators import metrics

    assert [r[0] for r in spark.range(8).select(ingest.backoff(F.col("id"))).collect()] == [1, 1, 2, 4, 8, 16, 30, 30]
    rows = [(f"2024-01-01 00:0{i}:00", "a", float(v)) for i, v in enumerate((5, 8, 2, 2, 7))]
    df = spark.createDataFrame(rows, "ts string, label string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [r["increase"] for r in metrics.increase(df, "label", "1 hour").collect()] == [3 + 2 + 0 + 5]
    many = spark.range(100_000).select(F.lit("x").alias("k"), (F.col("id") % 97).cast("double").alias("v"))
    assert metrics.nearest_rank(many, "k", "v", 0.95).first()["p"] == sorted(i % 97 for i in range(100_000))[95_000]
    assert metrics.nearest_rank(many.limit(3), "k", "v", 1.0).first()["p"] == 2.0


def test_token_bucket_equals_a_bucket(spark):
    import random

    from marlstone.operators import metrics

    r = random.Random(4)
    at = sorted(r.uniform(0, 20) for _ in range(200))
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(at)], "event_id int, k string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = [x["wait_s"] for x in metrics.token_bucket(df, "k", 5.0, 10).orderBy("event_id").collect()]
    tokens, clock, want = 10.0, 0.0, []
    for t in at:
        now = max(t, clock)
        tokens, clock = min(10.0, tokens + (now - clock) * 5.0), now
        if tokens < 1:
            clock, tokens = clock + (1 - tokens) / 5.0, 1.0
        tokens -= 1
        want.append(clock - t)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-4 and max(want) > 1


def test_digest_of_evidence(spark):
    from marlstone.operators import evidence

    df = spark.createDataFrame([("a", "Revenue, FY 2020", "USD", {"value": 1234567.891}, None), ("b", "Passage", None, {}, "x" * 400)], "id string, label string, unit string, values map<string, double>, excerpt string")
    assert [r["line"] for r in evidence.digest(df).collect()] == ["- [a] Revenue, FY 2020 (USD) value=1.23457e+06", f'- [b] Passage () {" "}excerpt="{"x" * 300}"'.replace("()  ", "()  ")]


def test_scans_by_slices_equal_scans_at_once(spark):
    """Any width of slices gives the rows of one scan per key; one key has almost all rows, keys may be null and slices empty."""
    import random

    from pyspark.sql import Window

    from marlstone.operators import metrics

    r = random.Random(9)
    rows = [(i, r.choice(["hot"] * 8 + ["b", None]), r.uniform(0, 3000) + 9000 * r.randrange(2), r.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id int, k string, t double, v long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).cache()
    w = Window.partitionBy("k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {x["event_id"]: x["s"] for x in df.select("event_id", F.sum("v").over(w).alias("s")).collect()}
    counters = df.select("ts", F.coalesce("k", F.lit("none")).alias("k"), (F.col("v") * 1.0).alias("value"))
    once = {n: None for n in ("wait", "grown")}
    for width in (10**6, 700, 37, 1):
        got = {x["event_id"]: x["total"] for x in metrics.running_total(df, "k", "v", width).collect()}
        assert got == want
        wait = {x["event_id"]: x["wait_s"] for x in metrics.token_bucket(df, "k", 0.1, 3, width).collect()}
        grown = {(x["window"], x["k"]): (x["increase"], x["rate"]) for x in metrics.increase(counters, "k", "10 minutes", width).collect()}
        once = {"wait": once["wait"] or wait, "grown": once["grown"] or grown}
        assert wait.keys() == want.keys() and max(abs(wait[i] - once["wait"][i]) for i in wait) < 1e-4 and max(wait.values()) > 1
        assert grown == once["grown"]
    assert metrics.running_total(df.where("false"), "k", "v").count() == metrics.token_bucket(df.where("false"), "k", 1.0, 1).count() == 0
    nulls = df.withColumn("v", F.lit(None).cast("long"))
    assert {x["total"] for x in metrics.running_total(nulls, "k", "v", 37).collect()} == {None}
    df.unpersist()


def test_a_hot_ticker_is_not_rewritten_by_small_batches(spark, tmp_path, monkeypatch):
    """A ticker with nearly all rows: bytes written follow the batches, files are cut by size, nulls in the key are one value."""
    monkeypatch.setattr(ingest, "MOST_RUNS", 3)
    monkeypatch.setattr(ingest, "PART_BYTES", 200_000)
    store = ingest.Snapshots(spark, str(tmp_path / "facts"))
    cols = ["ticker", "metric", "fiscal_year", "fiscal_period", "accession", "value", "ord"]
    hot = spark.range(120_000).select(F.lit("HOT").alias("ticker"), F.lit("revenue").alias("metric"), F.lit(2020).alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.sha2(F.col("id").cast("string"), 256).alias("accession"), F.col("id").cast("double").alias("value"), F.lit(0).alias("ord"))
    store.apply(hot, 0)
    whole, want = store.state()["runs"][0]["bytes"], {}
    for i in range(1, 13):
        rows = [("HOT" if j % 3 else f"T{j}", "revenue", 2020, None if j == 4 else "FY", f"a{(i + j) % 9}", float(100 * i + j), j) for j in range(30)]
        for r in reversed(rows):
            want[r[:5]] = r[5]
        store.apply(spark.createDataFrame(rows, "ticker string, metric string, fiscal_year int, fiscal_period string, accession string, value double, ord int").select(*cols), i)
    runs = store.state()["runs"]
    assert len(runs) <= 3 + 1 and store.state()["version"] == 13
    written = sum(f.stat().st_size for f in (tmp_path / "facts/data").rglob("*.parquet"))
    assert runs[0]["bytes"] == whole and written < 1.2 * whole  # the large run was never written again
    got = {tuple(r[c] for c in cols[:5]): r["value"] for r in store.read().where(F.length("accession") < 64).collect()}
    assert got == want and store.read().count() == 120_000 + len(want)
    while len(store.state()["runs"]) > 1:
        store.compact()
    assert store.read().count() == 120_000 + len(want) and store.state()["version"] == 13
    files = list((tmp_path / "facts" / store.state()["runs"][0]["folder"]).glob("*.parquet"))
    assert len(files) > 10  # one ticker, many files


def test_evidence_of_several_tools(spark):
    """Appended in order; an id that comes again keeps its first place and its last words; tools without some columns, none at all."""
    from marlstone.operators import evidence

    a = spark.createDataFrame([("x", "X", "USD", {"value": 1.0}), ("y", "Y", None, None)], "id string, label string, unit string, values map<string, double>")
    b = spark.createDataFrame([("p", "Passage", "word " * 100), ("q", "Passage", "")], "id string, label string, excerpt string")
    c = spark.createDataFrame([("x", "X again", {"value": 2.5})], "id string, label string, values map<string, double>")
    assert evidence.appended(a, b, c).count() == 5
    got = {r["id"]: r for r in evidence.merged(evidence.appended(a, b, c, b.where("false"))).collect()}
    assert {k: (r["tool_order"], r["label"], r["unit"], r["values"]) for k, r in got.items()} == {"x": (0, "X again", None, {"value": 2.5}), "y": (0, "Y", None, None), "p": (1, "Passage", None, None), "q": (1, "Passage", None, None)}
    lines = {r["id"]: r["line"] for r in evidence.digest(evidence.merged(evidence.appended(a, b, c))).collect()}
    assert lines["x"] == "- [x] X again () value=2.5" and lines["q"] == "- [q] Passage () " and lines["p"].count("word") == 60
