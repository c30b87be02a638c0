"""Rollups of service metrics over events (ts, label, value): buckets, rates, quantiles, ratios, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(events: DataFrame, bounds: list[float], every: str, label: str) -> DataFrame:
    """Cumulative counts (window, label, le, n): how many values of a window are at or below each bound; the last is infinite."""
    per = events.groupBy(F.window(F.col("ts").cast("timestamp"), every)["start"].cast("timestamp_ntz").alias("window"), label).agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("all"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return per.select("window", label, F.inline(pairs))


def histogram_quantile(hist: DataFrame, q: float, label: str) -> DataFrame:
    """(window, label, value): linear within the bucket that holds the rank; the last finite bound where that is the infinite one."""
    got = hist.groupBy("window", label).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))  # one entry per bound
    total = F.element_at("b", -1)["n"]
    rank = q * total
    at = F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: F.element_at(F.col("b"), i)["n"] >= rank)[0]
    low = F.when(at == 1, F.lit(0.0)).otherwise(F.get("b", at - 2)["le"])
    before = F.when(at == 1, F.lit(0)).otherwise(F.get("b", at - 2)["n"])
    here = F.element_at("b", at)
    value = F.when(here["le"] == float("inf"), F.get("b", F.size("b") - 2)["le"]).otherwise(low + (here["le"] - low) * (rank - before) / (here["n"] - before))
    return got.where(total > 0).select("window", label, value.alias("value"))


def ratio(events: DataFrame, part, every: str) -> DataFrame:
    """(window, ratio): share of the events for which `part` holds; the denominator is 1e-9 at least."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), every)["start"].cast("timestamp_ntz").alias("window")).agg((F.count_if(part) / F.greatest(F.count(F.lit(1)).cast("double"), F.lit(1e-9))).alias("ratio"))


def rate_limit(events: DataFrame, key: str, limit: int, every: str) -> DataFrame:
    """Fixed windows: an event is allowed while its key has at most `limit` in the window. Adds n, allowed, remaining, reset_s."""
    w = F.window(F.col("ts").cast("timestamp"), every)
    rows = events.withColumn("_w", w)
    n = F.row_number().over(Window.partitionBy(key, "_w").orderBy("ts", "event_id"))
    left = F.unix_micros(F.col("_w.end")) - F.unix_micros(F.col("ts").cast("timestamp"))
    out = rows.withColumn("n", n.cast("long"))
    return out.withColumns({"allowed": F.col("n") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("n")).cast("long"), "reset_s": F.greatest(F.lit(1), F.ceil(left / 1e6)).cast("long")}).drop("_w")


def _slices(rows: DataFrame, seconds: int) -> DataFrame:
    """rows and _slice: the number of the stretch of time that ts is in; rows without ts come before all others."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1e6))
    return rows.withColumn("_slice", F.coalesce(at, F.lit(-(2**62))))


def _carry(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """rows and what `totals` (key, _slice, ...) has for their slice; null keys meet."""
    named = totals.withColumnsRenamed({key: "_key", "_slice": "_at"})
    return rows.join(named, (F.col("_slice") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_at", "_slice")


def _before(key: str):
    """All slices of the key that are earlier: a row per slice, however many rows a slice has."""
    return Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def running_total(rows: DataFrame, key: str, value: str, slice_s: int = 86_400) -> DataFrame:
    """rows (…, ts, event_id) and total: the sum of the key's values up to the row, in order of ts, event_id. Slices of a key's time are
    summed apart, the slices' totals are carried over, then added: no task sees more than one slice of one key."""
    cut = _slices(rows, slice_s)
    local = F.sum(value).over(Window.partitionBy(key, "_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = cut.groupBy(key, "_slice").agg(F.sum(value).alias("_sum")).select(key, "_slice", F.sum("_sum").over(_before(key)).alias("_earlier"))
    both = _carry(cut.withColumn("total", local), totals, key)
    return both.withColumn("total", F.when(F.col("_earlier").isNull(), F.col("total")).otherwise(F.col("_earlier") + F.coalesce("total", F.lit(0)))).drop("_earlier")


def token_bucket(requests: DataFrame, key: str, rate: float, burst: int, slice_s: int = 86_400) -> DataFrame:
    """requests (…, ts) and wait_s: how long each waits for a token of its key's bucket, which holds `burst`, gains `rate` a second and is
    full at first; requests are served in order of ts, event_id. The i-th leaves no sooner than j's arrival plus the time that the
    tokens for j .. i take beyond a burst, for every j up to i: a running maximum, no loop. Numbers and maxima are made within slices of
    a key's time; a slice then takes the count and the maximum of those before it, so that no task sees more than one slice."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy(key, "_slice").orderBy("ts", "event_id")
    cut = _slices(requests, slice_s).withColumn("_i", F.row_number().over(w).cast("long")).withColumn("_base", at - F.col("_i") / rate)
    per = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.max("_base").alias("_top"))
    placed = per.withColumn("_off", F.coalesce(F.sum("_n").over(_before(key)), F.lit(0)))
    totals = placed.select(key, "_slice", "_off", F.max(F.col("_top") - F.col("_off") / rate).over(_before(key)).alias("_earlier"))
    local = F.max("_base").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = _carry(cut.withColumn("_local", local), totals, key)
    soonest = F.greatest(F.col("_local") - F.col("_off") / rate, F.col("_earlier")) + (F.col("_off") + F.col("_i") + 1 - burst) / rate
    return both.withColumn("wait_s", F.greatest(F.lit(0.0), soonest - at)).drop("_i", "_base", "_local", "_off", "_earlier")


def nearest_rank(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """(by, p): the value at place min(n - 1, int(q * n)) in ascending order, from 0. Equal values are counted before they are ordered,
    and only a band of values around two approximate quantiles is: what lies below it is a number."""
    per = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    ends = F.array(F.lit(max(0.0, q - 1e-3)), F.lit(min(1.0, q + 1e-3)))
    cut = df.groupBy(by).agg(F.count(value).alias("n"), F.percentile_approx(value, ends, F.lit(10_000)).alias("e"))
    marked = per.join(cut, by)
    top = q + 1e-3 >= 1
    below = marked.groupBy(by).agg(F.sum(F.when(F.col(value) < F.col("e")[0], F.col("c")).otherwise(0)).alias("below"))
    band = marked.where((F.col(value) >= F.col("e")[0]) & (F.lit(top) | (F.col(value) <= F.col("e")[1]))).join(below, by)
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value)) + F.col("below")
    place = F.least(F.col("n") - 1, F.floor(q * F.col("n")))
    return band.withColumn("u", upto).where((F.col("u") > place) & (F.col("u") - F.col("c") <= place)).select(by, F.col(value).alias("p"))


def increase(samples: DataFrame, label: str, every: str, slice_s: int = 86_400) -> DataFrame:
    """(window, label, increase, rate): growth of a counter (ts, label, value) within each window, and per second. A value below the one
    before is a restart and counts whole; the first sample of a window grows from the one before it, if there is one. Samples that
    follow one another within a slice of a label's time are compared there; the step into a slice is made of its first sample and the
    last one of the slice before, so that no task sees more than one slice."""

    def step(value, before):
        return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)

    cut = _slices(samples.select("ts", label, "value"), slice_s)
    within = cut.withColumn("_d", step(F.col("value"), F.lag("value").over(Window.partitionBy(label, "_slice").orderBy("ts", "value"))))
    ends = cut.groupBy(label, "_slice").agg(F.min(F.struct("ts", "value")).alias("first"), F.max(F.struct("ts", "value")).alias("last"))
    into = ends.withColumn("_before", F.lag("last.value").over(Window.partitionBy(label).orderBy("_slice")))
    edges = into.select(F.col("first.ts").alias("ts"), label, step(F.col("first.value"), F.col("_before")).alias("_d"))
    win = F.window(F.col("ts").cast("timestamp"), every)
    sums = [part.groupBy(win.alias("w"), label).agg(F.sum("_d").alias("_d")) for part in (within.select("ts", label, "_d"), edges)]
    out = sums[0].unionByName(sums[1]).groupBy("w", label).agg(F.sum("_d").alias("increase"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window"), label, "increase", (F.col("increase") / seconds).alias("rate"))


def divergence(samples: DataFrame, every: str) -> DataFrame:
    """(window, divergence): the largest value of a window less its smallest."""
    return samples.groupBy(F.window(F.col("ts").cast("timestamp"), every)["start"].cast("timestamp_ntz").alias("window")).agg((F.max("value") - F.min("value")).alias("divergence"))


def series(events: DataFrame, every: str, *labels: str) -> DataFrame:
    """(window, labels, n, rate): events of a window and per second, for a dashboard's lines."""
    win = F.window(F.col("ts").cast("timestamp"), every)
    out = events.groupBy(win.alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window"), *labels, "n", (F.col("n") / seconds).alias("rate"))


def span_metrics(spans: DataFrame, bounds: list[float], every: str, probes: list[str]) -> DataFrame:
    """Cumulative counts of span durations (ts, label = status code, value = duration, name), without the names of probes."""
    return histogram(spans.where(~F.col("name").isin(probes)), bounds, every, "label")


def outcomes(results: DataFrame, flags: list[str], latency: str, q: float = 0.95) -> DataFrame:
    """One row: the share of true ones of each flag, the median latency and its nearest rank at q."""
    one = results.withColumn("_all", F.lit(1))
    p = nearest_rank(one, "_all", latency, q).select(F.col("p").alias(f"p{round(100 * q)}"))
    return one.agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in flags], F.median(latency).alias("median")).crossJoin(p)  # one row each


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, usd) from (model, tokens_in, tokens_out) and prices per million tokens (model, price_in, price_out): tokens are summed
    before they meet prices."""
    used = usage.groupBy("model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    return used.join(prices, "model").select("model", ((F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out")) / 1e6).alias("usd"))


def lag_seconds(accepted, published):
    """Seconds from an ISO timestamp (naive: UTC) to another, never below 0; null for what is no timestamp. The session's zone does
    not matter: a text without a zone gets one."""
    zoned = F.when(accepted.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), accepted).otherwise(F.concat(accepted, F.lit("+00:00")))
    at = F.try_to_timestamp(zoned)
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(published.cast("timestamp")) - F.unix_micros(at)) / 1e6))
