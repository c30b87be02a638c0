"""Queries of evidence, metrics and streaming operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from marlstone.operators import evidence, metrics, pit
from marlstone.plans.facts import _LATEST
from marlstone.sources import filings, landed
from marlstone.sources.tables import facts, facts_sql, shared_dir, table
from marlstone.streaming import ingest, keyed, monitor

BOUNDS = [10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 250.0]
LIMIT = 3


def _events(s, d):
    return table(s, d, "events")


def _work(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def stream_window_counts(s, d):
    """Hourly counts by a streaming query over all event files."""
    work = _work(s)
    # append mode waits for the watermark to pass; complete mode gives all windows
    ingest.run(ingest.counts_by_window(ingest.events_stream(s, f"{d}/events.parquet*")), lambda b, i: b.write.mode("overwrite").parquet(f"{work}/out"), f"{work}/checkpoint", "complete")
    return s.read.parquet(f"{work}/out")


def stream_publish_once(s, d):
    """Every event twice in the stream, once in the result."""
    work = _work(s)
    events = ingest.events_stream(s, f"{d}/events.parquet*")
    twice = events.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    sink = ingest.Sink(s, f"{work}/out")
    ingest.run(ingest.publish_once(twice), lambda b, i: sink.write(b.select("event_id", "event_type"), i), f"{work}/checkpoint")
    return sink.read()


def upserted(s, d) -> ingest.Snapshots:
    """All facts applied batch by batch to a snapshot table; replays change nothing."""
    store = ingest.Snapshots(s, _work(s))
    f = facts(s, d).withColumn("ord", F.col("accession"))
    for i, batch in enumerate((f.where(F.col("fiscal_year") <= 1997), f, f.where(F.col("fiscal_year") <= 1995))):  # the third is a replay of the second's id
        store.apply(batch, min(i, 1))
    return store


def _totals(df):
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_upsert(s, d):
    """Per ticker the facts of the snapshot."""
    return _totals(upserted(s, d).read())


def stream_apply(s, d):
    """Facts as messages in a log, between lines that are none, applied by a replica."""
    work, f = _work(s), facts(s, d)
    log = ingest.messages(f)
    noise = log.select(F.substring("value", 1, 20).alias("value"))
    log.unionByName(noise.limit(5)).write.text(f"{work}/log")
    store = ingest.Snapshots(s, f"{work}/replica")
    ingest.replicate(s, f"{work}/log", f.schema, store, f"{work}/checkpoint")
    return _totals(store.read())


def _messages(s, d):
    return _events(s, d).select("event_id", "props", (F.col("event_id") % 6).cast("int").alias("attempts"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def dlq_split(s, d):
    """Messages whose payload's number is divisible by 7 fail."""
    ok, retry, dead = ingest.split(_messages(s, d), _k() % 7 != 0, F.concat(F.lit("bad payload: "), "props"))
    parts = [x.select("event_id", F.lit(n).alias("outcome"), "attempts") for n, x in (("ok", ok), ("retry", retry), ("dead_lettered", dead))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _deliver(row, attempt):
    """Numbers divisible by 7 succeed at the third attempt, those by 11 never."""
    k = json.loads(row["props"])["k"]
    return None if k % 11 and (k % 7 or attempt >= 3) else f"bad payload: {row['props']}"


def stream_retries(s, d):
    """A stream whose failures come back by timers, in one query."""
    work = _work(s)
    sink = ingest.Sink(s, f"{work}/out")
    source = ingest.events_stream(s, f"{d}/events.parquet*").select("event_id", "props")
    keyed.run_until_quiet(s, keyed.attempts(source, "event_id", _deliver, wait_ms=10), sink.write, f"{work}/checkpoint")
    return sink.read().select("event_id", "outcome", "attempts")


def stream_publish_recent(s, d):
    """One event of each user in the stream, remembered for an hour."""
    work = _work(s)
    sink = ingest.Sink(s, f"{work}/out")
    first = keyed.publish_once_for(ingest.events_stream(s, f"{d}/events.parquet*").select("user_id"), "user_id", 3_600_000)
    keyed.run_until_quiet(s, first, sink.write, f"{work}/checkpoint", empty=False)
    return sink.read()


def stream_enrich(s, d):
    """Orders as a stream of accessions, each joined to its facts."""
    work = _work(s)
    schema = s.read.parquet(f"{d}/orders.parquet").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/orders.parquet*").select(F.col("o_orderkey").cast("string").alias("accession"))
    sink = ingest.Sink(s, f"{work}/out")
    ingest.run(ingest.enrich(stream, facts(s, d)), lambda b, i: sink.write(b, i), f"{work}/checkpoint")
    return sink.read().select("accession", "ticker", "metric", "fiscal_year", "value")


def _landing(s, d):
    """Pages as filings; the first answers for every seventh are failures that pass."""
    faults = F.when(F.col("page_id") % 7 == 0, F.array(F.lit(503), F.lit(429))).otherwise(F.array().cast("array<int>"))
    return table(s, d, "pages").select("page_id", F.lit("PAGE").alias("ticker"), F.col("page_id").cast("string").alias("accession"), "html", faults.alias("faults"))


def _filed(df):
    return df.select(F.col("accession").cast("long").alias("page_id"), "attempts", F.octet_length("html").cast("long").alias("n_bytes"), F.md5(F.col("html").cast("binary")).alias("digest"))


def landed_filings(s, d):
    """Pages landed as files and read through the data source, which retries."""
    work = _work(s)
    filings.register(s)
    filings.land(_landing(s, d), f"{work}/landed")
    return _filed(s.read.format("landed_filings").option("inject", "true").option("wait", "0.01").load(f"{work}/landed"))


def stream_filings(s, d):
    """The same as a stream that ends after half of the pages and is started again for the rest."""
    work = _work(s)
    filings.register(s)
    sink = ingest.Sink(s, f"{work}/out")
    for part in (0, 1):
        filings.land(_landing(s, d).where(F.col("page_id") % 2 == part), f"{work}/landed")
        stream = s.readStream.format("landed_filings").option("inject", "true").option("wait", "0.01").load(f"{work}/landed")
        ingest.run(_filed(stream), sink.write, f"{work}/checkpoint")
    return sink.read()


def replica_health(s, d):
    """Event types as replicas, an hour before the first of February 2024."""
    return ingest.health(_events(s, d).select(F.col("event_type").alias("replica"), "ts"), "replica", F.lit("2024-01-30 23:50:00").cast("timestamp_ntz").cast("timestamp"), 300)


def replica_progress(s, d):
    """A replica that is stopped and started again between two halves of a log: what its monitor counted and its store's version."""
    work, f, name = _work(s), facts(s, d), f"replica-{uuid.uuid4().hex[:8]}"
    store, watch = ingest.Snapshots(s, f"{work}/store"), monitor.ReplicaMonitor()
    s.streams.addListener(watch)
    try:
        for half in (0, 1):
            ingest.messages(f.where(F.pmod(F.col("accession").cast("long"), F.lit(2)) == half)).write.mode("append").text(f"{work}/log")
            monitor.follow(s, f"{work}/log", f.schema, store, f"{work}/checkpoint", name, "filed", None).awaitTermination()
            seen = watch.wait(lambda v, half=half: v["batch"] == half and not v["running"], name)
    finally:
        s.streams.removeListener(watch)
    return _totals(store.read()).agg(F.count(F.lit(1)).alias("tickers"), F.sum("n").alias("stored")).withColumns({"applied": F.lit(seen["rows"]).cast("long"), "newest": F.lit(seen["newest"]), "version": F.lit(store.state()["version"]), "failures": F.lit(seen["failures"])})


def _hist(s, d):
    return metrics.histogram(_events(s, d), BOUNDS, "6 hours", "event_type")


def ingest_lag(s, d):
    """Lags from acceptance, written with and without a zone, to an event 0 to 99 seconds later."""
    late = F.col("ts") + F.make_dt_interval(secs=F.get_json_object("props", "$.k").cast("int"))
    zone = F.when(F.col("event_id") % 2 == 0, "Z").otherwise("")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    lag = metrics.lag_seconds(text, late)
    return metrics.histogram(_events(s, d).select("ts", "event_type", lag.alias("value")), [1.0, 10.0, 30.0, 60.0], "6 hours", "event_type").withColumn("le", F.col("le").cast("string"))


def counters(s, d):
    """Running totals by event type with a restart at a million, as counters are scraped."""
    rows = metrics.running_total(_events(s, d).select("ts", "event_type", "event_id", "user_id"), "event_type", "user_id")
    return rows.select("ts", "event_type", "event_id", (F.col("total") % 1_000_000).cast("double").alias("value"))


def eval_rates(s, d):
    rows = _events(s, d).select((F.col("event_type") == "error").alias("failed"), (F.col("value") > 50).alias("slow"), F.col("value").alias("latency"))
    return metrics.outcomes(rows, ["failed", "slow"], "latency").select(F.round("failed", 6).alias("failed"), F.round("slow", 6).alias("slow"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def fundamentals_gaps(s, d):
    return evidence.gaps(facts(s, d), facts(s, d).select("ticker").distinct(), ["revenue", "capex", "cash"], 1998)


ASKED = ["revenue", "capex", "cash", "net_margin", "free_cash_flow", "revenue_growth_yoy", "gross_margin"]


def fundamentals(s, d):
    """All nations; those with an even key ask for 1998, the others for the latest year; one invented company has filed nothing."""
    nations = table(s, d, "nation")
    asked = nations.select(F.col("n_name").alias("ticker"), F.when(F.col("n_nationkey") % 2 == 0, 1998).alias("fiscal_year"))
    asked = asked.unionByName(nations.limit(1).select(F.lit("NOWHERE").alias("ticker"), F.lit(None).cast("int").alias("fiscal_year")))
    companies = nations.select(F.col("n_name").alias("ticker"), F.concat(F.initcap(F.lower("n_name")), F.lit(" Inc.")).alias("name"), (F.col("n_nationkey") + 1000).alias("cik"))
    return evidence.fundamentals(facts(s, d), asked, ASKED, "1998-06-30", companies)


def evidence_urls(s, d):
    companies = table(s, d, "nation").select(F.col("n_name").alias("ticker"), F.lit(None).cast("string").alias("name"), (F.col("n_nationkey") + 1000).alias("cik"))
    return evidence.fact_evidence(facts(s, d), companies=companies).select("id", "url", "restated_from")


def answer_evidence(s, d):
    """Three tools answer: facts, documents as passages, and facts of revenue once more under another label."""
    found = evidence.fact_evidence(facts(s, d))
    passages = table(s, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("Passage").alias("label"), F.col("text").alias("excerpt"))
    again = found.where("metric = 'revenue'").select("id", F.lit("Revenue, checked").alias("label"), F.create_map(F.lit("value"), F.col("values")["value"]).alias("values"))
    return evidence.merged(evidence.appended(found, passages, again))


def answer_digest(s, d):
    rows = answer_evidence(s, d)
    return evidence.digest(rows).join(rows.select("id", "tool_order"), "id")


_FILED = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 3 ELSE 1 END AS attempts, octet_length(encode(html))::BIGINT AS n_bytes, md5(html) AS digest FROM pages"
_W6 = "time_bucket(INTERVAL '6 hours', ts)"
_W1 = "time_bucket(INTERVAL '1 hour', ts)"

QUERIES = {
    "rate_limit_windows": lambda s, d: metrics.rate_limit(_events(s, d), "event_type", LIMIT, "1 hour").select("event_id", "n", "allowed", "remaining", "reset_s"),
    "token_bucket": lambda s, d: metrics.token_bucket(_events(s, d).select("event_id", "event_type", "ts"), "event_type", 0.001, 3).select("event_id", F.round("wait_s", 3).alias("wait_s")),
    "evidence_digest": lambda s, d: evidence.digest(evidence.fact_evidence(facts(s, d)).withColumn("excerpt", F.lit(None).cast("string"))),
    "lag_histogram": lambda s, d: _hist(s, d).withColumn("le", F.col("le").cast("string")),
    "ingest_lag": ingest_lag,
    "counter_increase": lambda s, d: metrics.increase(counters(s, d), "event_type", "6 hours").withColumns({"increase": F.round("increase", 3), "rate": F.round("rate", 6)}),
    "counter_divergence": lambda s, d: metrics.divergence(_events(s, d), "1 hour").withColumn("divergence", F.round("divergence", 6)),
    "dashboard_series": lambda s, d: metrics.series(_events(s, d), "5 minutes", "event_type").withColumn("rate", F.round("rate", 6)),
    "span_metrics": lambda s, d: metrics.span_metrics(_events(s, d).select("ts", F.col("event_type").alias("label"), "value", F.col("event_type").alias("name")), BOUNDS, "6 hours", ["view"]).withColumn("le", F.col("le").cast("string")),
    "eval_rates": eval_rates,
    "histogram_p95": lambda s, d: metrics.histogram_quantile(_hist(s, d), 0.95, "event_type").withColumn("value", F.round("value", 6)),
    "error_ratio_window": lambda s, d: metrics.ratio(_events(s, d), F.col("event_type") == "error", "1 hour").withColumn("ratio", F.round("ratio", 6)),
    "nearest_rank_p95": lambda s, d: metrics.nearest_rank(_events(s, d), "event_type", "value", 0.95),
    "usage_cost": lambda s, d: metrics.cost(_events(s, d).select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") % 100).alias("tokens_out")), _events(s, d).groupBy(F.col("event_type").alias("model")).agg(F.lit(0.15).alias("price_in"), F.lit(0.6).alias("price_out"))).withColumn("usd", F.round("usd", 6)),
    "outcome_tallies": lambda s, d: dlq_split(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
    "dlq_split": dlq_split,
    "dedup_events": lambda s, d: _events(s, d).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
    "stream_window_counts": stream_window_counts,
    "stream_publish_once": stream_publish_once,
    "stream_upsert": stream_upsert,
    "stream_apply": stream_apply,
    "stream_retries": stream_retries,
    "stream_publish_recent": stream_publish_recent,
    "stream_enrich": stream_enrich,
    "landed_filings": landed_filings,
    "stream_filings": stream_filings,
    "stream_retention": lambda s, d: ingest.retained(_events(s, d).select("event_id", "event_type"), 500, F.desc("event_id")),
    "replica_health": replica_health,
    "replica_progress": replica_progress,
    "fundamentals": fundamentals,
    "evidence_urls": evidence_urls,
    "answer_digest": answer_digest,
    "evidence_merge": lambda s, d: evidence.merge(_events(s, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value", "event_type")),
    "template_answers": lambda s, d: evidence.answer(table(s, d, "customer").select(F.col("c_nationkey").alias("question"), (F.col("c_custkey") % 3).alias("tool_order"), F.col("c_custkey").alias("position"), F.col("c_name").alias("text"))),
    "question_digests": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", landed.question_digest(F.col("text")).alias("digest")),
    "fact_evidence": lambda s, d: evidence.fact_evidence(facts(s, d)).select("id", "ticker", "label", F.round(F.col("values")["value"], 2).alias("value"), F.round(F.try_element_at("values", F.lit("originally_reported")), 2).alias("originally_reported")),
    "fact_findings": lambda s, d: evidence.fact_evidence(facts(s, d)).select("id", "finding"),
    "fundamentals_gaps": fundamentals_gaps,
    "lineage_inputs": lambda s, d: pit.ratio(facts(s, d), "net_margin").select("ticker", "fiscal_year", F.explode("inputs").alias("id")).join(facts(s, d).select(pit.fact_id().alias("id"), "value", "filed"), "id"),
}

_USD = "CASE WHEN abs({0}) >= 1e9 THEN '$' || format('{{:,.2f}}', {0} / 1e9) || ' billion' WHEN abs({0}) >= 1e6 THEN '$' || format('{{:,.2f}}', {0} / 1e6) || ' million' ELSE '$' || format('{{:,.2f}}', {0}) END"
_FUNDAMENTALS_SQL = f"""WITH {facts_sql()},
{_LATEST.format(where=" WHERE filed <= DATE '1998-06-30'")},
y AS (SELECT ticker, coalesce(max(fiscal_year) FILTER (WHERE metric = 'revenue'), max(fiscal_year) FILTER (WHERE metric = 'net_income')) AS fy FROM latest GROUP BY 1),
n AS (SELECT n_name AS ticker, CASE WHEN n_nationkey % 2 = 0 THEN 1998 ELSE fy END AS fiscal_year, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Inc. (' || n_name || ')' AS who FROM nation LEFT JOIN y ON ticker = n_name),
a AS (SELECT ticker, fiscal_year, who, unnest({ASKED}) AS metric FROM n WHERE fiscal_year IS NOT NULL),
p AS (SELECT l.id, f.value, row_number() OVER (PARTITION BY l.id ORDER BY f.filed, f.accession) AS k FROM ids l JOIN facts f ON f.ticker = l.ticker AND f.metric = l.metric AND f.fiscal_year = l.fiscal_year AND f.filed < l.filed AND f.value <> l.value),
rep AS (SELECT ids.ticker, metric, fiscal_year, ids.id, CASE metric WHEN 'revenue' THEN 'revenue' ELSE 'capital expenditures' END || ' for FY ' || fiscal_year || ' was ' || {_USD.format('ids.value')}
  || CASE WHEN p.value IS NULL THEN '' ELSE ' (restated; originally reported as ' || {_USD.format('p.value')} || ')' END AS said FROM ids LEFT JOIN p ON p.id = ids.id AND p.k = 1 WHERE metric IN ('revenue', 'capex')),
der AS (SELECT x.ticker, 'net_margin' AS metric, x.fiscal_year, 'net margin for FY ' || x.fiscal_year || ' was ' || format('{{:.1f}}', x.value / z.value * 100) || '% (net_income / revenue)' AS said FROM ids x JOIN ids z ON x.ticker = z.ticker AND x.fiscal_year = z.fiscal_year AND x.metric = 'net_income' AND z.metric = 'revenue' WHERE z.value <> 0
  UNION ALL SELECT x.ticker, 'free_cash_flow', x.fiscal_year, 'free cash flow for FY ' || x.fiscal_year || ' was ' || CASE WHEN x.value - z.value < 0 THEN '-' ELSE '' END || {_USD.format('abs(x.value - z.value)')} || ' (operating_cash_flow - capex)' FROM ids x JOIN ids z ON x.ticker = z.ticker AND x.fiscal_year = z.fiscal_year AND x.metric = 'operating_cash_flow' AND z.metric = 'capex'
  UNION ALL SELECT x.ticker, 'revenue_growth_yoy', x.fiscal_year, 'revenue growth YoY for FY ' || x.fiscal_year || ' was ' || format('{{:.1f}}', (x.value / z.value - 1) * 100) || '%' FROM ids x JOIN ids z ON x.ticker = z.ticker AND z.fiscal_year = x.fiscal_year - 1 AND x.metric = 'revenue' AND z.metric = 'revenue' WHERE z.value <> 0),
f AS (SELECT * FROM rep UNION ALL SELECT ticker, metric, fiscal_year, ticker || ':' || metric || ':FY' || fiscal_year AS id, said FROM der)
SELECT a.ticker, a.metric, a.fiscal_year, f.id, who || ' ' || said || ' [' || f.id || '].' AS finding, CASE WHEN f.id IS NULL THEN CASE a.metric WHEN 'revenue' THEN who || ' does not report revenue for FY ' || a.fiscal_year || '.' WHEN 'capex' THEN who || ' does not report capital expenditures for FY ' || a.fiscal_year || '.'
  WHEN 'cash' THEN who || ' does not report cash and equivalents for FY ' || a.fiscal_year || '.' ELSE CASE a.metric WHEN 'net_margin' THEN 'Net margin' WHEN 'free_cash_flow' THEN 'Free cash flow' WHEN 'gross_margin' THEN 'Gross margin' ELSE 'Revenue growth YoY' END || ' is not computable for ' || who || ' FY ' || a.fiscal_year || ' (an input is not reported).' END END AS gap
FROM a LEFT JOIN f ON f.ticker = a.ticker AND f.metric = a.metric AND f.fiscal_year = a.fiscal_year
UNION ALL SELECT ticker, NULL, NULL, NULL, NULL, 'No filings for ' || ticker || ' on or before 1998-06-30.' FROM (SELECT ticker FROM n WHERE fiscal_year IS NULL UNION ALL SELECT 'NOWHERE')"""
SQL = {
    "rate_limit_windows": f"""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, {_W1} ORDER BY ts, event_id) AS n, epoch_us({_W1} + INTERVAL '1 hour') - epoch_us(ts) AS left_us FROM events)
SELECT event_id, n, n <= {LIMIT} AS allowed, greatest(0, {LIMIT} - n)::BIGINT AS remaining, greatest(1, ceil(left_us / 1e6))::BIGINT AS reset_s FROM r""",
    "token_bucket": """WITH r AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER w AS i, event_type, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, round(greatest(0.0, max(t - i / 0.001::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + (i - 2) / 0.001::DOUBLE - t), 3) AS wait_s FROM r""",
    "lag_histogram": f"SELECT {_W6}::TIMESTAMP AS window, event_type, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (SELECT unnest({BOUNDS} || ['inf'::DOUBLE])::DOUBLE AS le) GROUP BY 1, 2, 3",
    "ingest_lag": f"SELECT {_W6}::TIMESTAMP AS window, event_type, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, count(*) FILTER (WHERE (props::JSON->>'$.k')::INT <= le) AS n FROM events CROSS JOIN (SELECT unnest([1.0, 10.0, 30.0, 60.0, 'inf'::DOUBLE])::DOUBLE AS le) GROUP BY 1, 2, 3",
    "counter_increase": f"""WITH c AS (SELECT *, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 1000000 AS v FROM events),
d AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM c)
SELECT {_W6}::TIMESTAMP AS window, event_type, round(sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END)::DOUBLE, 3) AS increase, round(sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END)::DOUBLE / 21600, 6) AS rate FROM d GROUP BY 1, 2""",
    "counter_divergence": f"SELECT {_W1}::TIMESTAMP AS window, round(max(value) - min(value), 6) AS divergence FROM events GROUP BY 1",
    "dashboard_series": "SELECT time_bucket(INTERVAL '5 minutes', ts)::TIMESTAMP AS window, event_type, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM events GROUP BY 1, 2",
    "span_metrics": f"SELECT {_W6}::TIMESTAMP AS window, event_type AS label, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (SELECT unnest({BOUNDS} || ['inf'::DOUBLE])::DOUBLE AS le) WHERE event_type <> 'view' GROUP BY 1, 2, 3",
    "eval_rates": "SELECT round(avg((event_type = 'error')::INT), 6) AS failed, round(avg((value > 50)::INT), 6) AS slow, round(median(value), 6) AS median, (SELECT round(value, 6) FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k FROM events) WHERE k = (SELECT least(count(*) - 1, floor(0.95::DOUBLE * count(*))) FROM events)) AS p95 FROM events",
    "histogram_p95": f"""WITH b AS (SELECT {_W6}::TIMESTAMP AS "window", event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (SELECT unnest({BOUNDS} || ['inf'::DOUBLE])::DOUBLE AS le) GROUP BY 1, 2, 3),
c AS (SELECT *, lag(le, 1, 0.0::DOUBLE) OVER w AS low, lag(n, 1, 0) OVER w AS before, max(n) OVER (PARTITION BY "window", event_type) AS total FROM b WINDOW w AS (PARTITION BY "window", event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY "window", event_type ORDER BY le) AS k FROM c WHERE n >= 0.95::DOUBLE * total)
SELECT "window", event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - before) / (n - before) END, 6) AS value FROM f WHERE k = 1""",
    "error_ratio_window": f"SELECT {_W1}::TIMESTAMP AS window, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*)::DOUBLE, 1e-9), 6) AS ratio FROM events GROUP BY 1",
    "nearest_rank_p95": "SELECT event_type, value AS p FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = least(n - 1, floor(0.95::DOUBLE * n))",
    "usage_cost": "SELECT event_type AS model, round(sum(user_id * 0.15::DOUBLE + (user_id % 100) * 0.6::DOUBLE) / 1e6, 6) AS usd FROM events GROUP BY 1",
    "outcome_tallies": "SELECT CASE WHEN k % 7 <> 0 THEN 'ok' WHEN a < 5 THEN 'retry' ELSE 'dead_lettered' END AS outcome, count(*) AS n FROM (SELECT (props::JSON->>'$.k')::INT AS k, event_id % 6 + 1 AS a FROM events) GROUP BY 1",
    "dlq_split": "SELECT event_id, CASE WHEN k % 7 <> 0 THEN 'ok' WHEN a < 5 THEN 'retry' ELSE 'dead_lettered' END AS outcome, a::INT AS attempts FROM (SELECT event_id, (props::JSON->>'$.k')::INT AS k, event_id % 6 + 1 AS a FROM events)",
    "dedup_events": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "stream_window_counts": f"SELECT {_W1}::TIMESTAMP AS window, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_publish_once": "SELECT event_id, event_type FROM events",
    "stream_upsert": f"WITH {facts_sql()} SELECT ticker, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY 1",
    "stream_apply": f"WITH {facts_sql()} SELECT ticker, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY 1",
    "stream_retries": "SELECT event_id, CASE WHEN k % 11 = 0 THEN 'dead_lettered' ELSE 'ok' END AS outcome, CASE WHEN k % 11 = 0 THEN 5 WHEN k % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM (SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events)",
    "stream_publish_recent": "SELECT DISTINCT user_id FROM events",
    "landed_filings": _FILED,
    "stream_filings": _FILED,
    "stream_enrich": f"WITH {facts_sql()} SELECT accession, ticker, metric, fiscal_year, value FROM facts",
    "evidence_merge": "SELECT user_id AS id, min(event_id) AS seq, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "template_answers": "SELECT c_nationkey AS question, string_agg(c_name, ' ' ORDER BY c_custkey % 3, c_custkey) AS answer FROM customer GROUP BY 1",
    "stream_retention": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500",
    "replica_progress": f"WITH {facts_sql()} SELECT count(DISTINCT ticker) AS tickers, count(*) AS stored, count(*) AS applied, max(filed)::VARCHAR AS newest, 2 AS version, 0 AS failures FROM facts",
    "replica_health": "SELECT replica, lag_s, lag_s <= 300 AS healthy FROM (SELECT event_type AS replica, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-30 23:50:00') - epoch_us(max(ts))) / 1e6) AS lag_s FROM events GROUP BY 1)",
    "question_digests": "SELECT conv_id, turn, sha256(text) AS digest FROM conversations",
    "evidence_urls": f"""WITH {facts_sql()},
{_LATEST.format(where="")},
p AS (SELECT l.id, f.accession, row_number() OVER (PARTITION BY l.id ORDER BY f.filed, f.accession) AS k FROM ids l JOIN facts f ON f.ticker = l.ticker AND f.metric = l.metric AND f.fiscal_year = l.fiscal_year AND f.filed < l.filed AND f.value <> l.value)
SELECT ids.id, 'https://www.sec.gov/Archives/edgar/data/' || (n_nationkey + 1000) || '/' || replace(ids.accession, '-', '') || '/' AS url, p.accession AS restated_from FROM ids JOIN nation ON n_name = ids.ticker LEFT JOIN p ON p.id = ids.id AND p.k = 1""",
    "fundamentals": _FUNDAMENTALS_SQL,
    "fact_evidence": f"""WITH {facts_sql()},
{_LATEST.format(where="")},
p AS (SELECT l.id, f.value, row_number() OVER (PARTITION BY l.id ORDER BY f.filed, f.accession) AS k FROM ids l JOIN facts f ON f.ticker = l.ticker AND f.metric = l.metric AND f.fiscal_year = l.fiscal_year AND f.filed < l.filed AND f.value <> l.value)
SELECT ids.id, ticker, CASE metric WHEN 'revenue' THEN 'Revenue' WHEN 'net_income' THEN 'Net income' WHEN 'operating_income' THEN 'Operating income' WHEN 'operating_cash_flow' THEN 'Operating cash flow' ELSE 'Capital expenditures' END || ', FY ' || fiscal_year AS label,
  round(ids.value, 2) AS value, round(p.value, 2) AS originally_reported FROM ids LEFT JOIN p ON p.id = ids.id AND p.k = 1""",
    "fundamentals_gaps": f"""WITH {facts_sql()}, asked AS (SELECT DISTINCT ticker, unnest(['revenue', 'capex', 'cash']) AS metric FROM facts)
SELECT ticker, metric, ticker || ' does not report ' || CASE metric WHEN 'revenue' THEN 'revenue' WHEN 'capex' THEN 'capital expenditures' ELSE 'cash and equivalents' END || ' for FY 1998.' AS gap
FROM asked WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.ticker = asked.ticker AND f.metric = asked.metric AND f.fiscal_year = 1998)""",
    "lineage_inputs": f"""WITH {facts_sql()},
{_LATEST.format(where="")}
SELECT i.id, a.ticker, a.fiscal_year, i.value, i.filed FROM ids a JOIN ids b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year AND a.metric = 'net_income' AND b.metric = 'revenue' JOIN ids i ON i.id = a.id OR i.id = b.id WHERE b.value <> 0""",
}

_MONEY = lambda v: f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs({v}) >= 1e9 THEN format('{{:,.2f}}', abs({v}) / 1e9) || ' billion' WHEN abs({v}) >= 1e6 THEN format('{{:,.2f}}', abs({v}) / 1e6) || ' million' ELSE format('{{:,.2f}}', abs({v})) END)"
_EVIDENCE = f"WITH e AS ({SQL['fact_evidence']})"
_PAIRS = "'value=' || printf('%.6g', value) || coalesce(', originally_reported=' || printf('%.6g', originally_reported), '')"
SQL["fact_findings"] = f"""{_EVIDENCE} SELECT id, ticker || ' ' || lower(split_part(label, ', FY', 1)) || ' for' || split_part(label, ',', 2) || ' was ' || {_MONEY("value")}
  || coalesce(' (restated; originally reported as ' || {_MONEY("originally_reported")} || ')', '') || ' [' || id || '].' AS finding FROM e"""
SQL["evidence_digest"] = f"{_EVIDENCE} SELECT id, '- [' || id || '] ' || label || ' (USD) ' || {_PAIRS} AS line FROM e"
SQL["answer_digest"] = f"""{_EVIDENCE} SELECT id, 0 AS tool_order, '- [' || id || '] ' || CASE WHEN label LIKE 'Revenue,%' THEN 'Revenue, checked () value=' || printf('%.6g', value) ELSE label || ' (USD) ' || {_PAIRS} END AS line FROM e
UNION ALL SELECT 'doc:' || doc_id, 1, '- [doc:' || doc_id || '] Passage () ' || CASE WHEN length(text) > 0 THEN ' excerpt="' || substring(text, 1, 300) || '"' ELSE '' END FROM documents"""
