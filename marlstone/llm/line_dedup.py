"""Boilerplate lines by their frequency within a site, in DataFrame operations only.

Pages are grouped by host; a line that stands on more than `ratio` of its host's pages, and on `least` pages at least, is
boilerplate there and leaves every page of that host. With `once`, rows of a host with equal texts count as one page, so that
copies of a text do not make boilerplate of its own lines. Lines are split at \\n and compared as they are; blank lines (spaces
only) are never boilerplate. With `alike`, near copies do not either: a page has so many classes, the least hashes of its
runs of three words in different orders, which near copies mostly share and pages that only have boilerplate in common mostly
don't; a line's pages are its different classes then, in the order that tells most of them apart. Only 64-bit hashes of lines move, counted before they move; a host's boilerplate has at most
(lines per page) / ratio entries.

Defined results: null text stays null, with no lines; a null host counts as the host ''; without `once` every row is a page,
repeated rows and equal ids too; an empty table gives an empty result. Columns of the input stay, but for those added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATIO = 0.01
LEAST = 3
BROADCAST_HASHES = 500_000


def host_of(url):
    """The host in a URL column, lower-cased, without user, port and a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), r"^www\.", "")


def _lines(text):
    return F.split(text, "\n", -1)


def _classes(text, n: int):
    """The least hash of the text's runs of three words in each of n orders; null for null."""
    words = F.split(F.trim(text), r"\s+")
    # a list of one, so that the words are worked out once and not for every place
    runs = F.transform(F.array(words), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))[0]
    orders = [(k * 0x9E3779B97F4A7C15) % 2**63 for k in range(n)]

    def in_order(o):
        return lambda r: F.array_min(F.transform(r, lambda h: h.bitwiseXOR(F.lit(o))))

    least = F.transform(F.array(runs), lambda r: F.array(*[in_order(o)(r) for o in orders]))[0]
    return F.when(text.isNotNull(), least)


def boilerplate(pages: DataFrame, text, host, ratio: float = RATIO, least: int = LEAST, once: bool = False, alike: int = 0) -> DataFrame:
    """(_host, _hashes): hashes of each host's boilerplate lines."""
    rows = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("_host"), text.alias("_text"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    rows = rows.select("_host", F.md5(F.col("_text").cast("binary")).alias("_digest"), own.alias("_own"), *([_classes(F.col("_text"), alike).alias("_classes")] if alike else []))
    if once:
        rows = rows.groupBy("_host", "_digest").agg(*[F.first(c).alias(c) for c in rows.columns[2:]])
    if alike:
        rows = common.saved(rows, f"{common.workspace(pages.sparkSession)}/pages")  # hashes only: eight bytes for a line
    total = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = rows.select("_host", F.explode("_own").alias("_hash")).groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    found = seen.join(total, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    if alike:
        stand = rows.select("_host", F.explode("_own").alias("_hash"), "_classes").join(found.select("_host", "_hash", "_pages"), ["_host", "_hash"])
        kinds = stand.select("_host", "_hash", "_pages", F.posexplode("_classes").alias("_order", "_class")).distinct()
        per = kinds.groupBy("_host", "_hash", "_pages", "_order").agg(F.count(F.lit(1)).alias("_n")).groupBy("_host", "_hash", "_pages").agg(F.max("_n").alias("_n"))
        found = per.where((F.col("_n") >= least) & (F.col("_n") > F.lit(ratio) * F.col("_pages")))
    return found.groupBy("_host").agg(F.collect_list("_hash").alias("_hashes"))


def drop_lines(pages: DataFrame, text_col: str = "text", host=None, ratio: float = RATIO, least: int = LEAST, once: bool = False, alike: int = 0) -> DataFrame:
    """pages with boilerplate lines taken out of text_col, and n_lines (before) and n_dropped."""
    spark = pages.sparkSession
    host = F.col("source") if host is None else host
    found = common.saved(boilerplate(pages, F.col(text_col), host, ratio, least, once, alike), f"{common.workspace(spark)}/boilerplate")
    size = found.agg(F.sum(F.size("_hashes"))).collect()[0][0] or 0
    at, hashes, lines, kept = common.fresh(pages.columns, "host", "hashes", "lines", "kept")
    found = found.select(F.col("_host").alias(at), F.col("_hashes").alias(hashes))
    found = F.broadcast(found) if size <= BROADCAST_HASHES else found
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    marked = pages.select(*names, F.coalesce(host.cast("string"), F.lit("")).alias(at)).join(found, at, "left").withColumn(lines, _lines(F.col(text_col)))
    left = F.when(F.col(hashes).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(hashes, F.xxhash64(x))))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    some = F.col(text_col).isNotNull()
    out = marked.withColumn(kept, left).withColumn("n_lines", F.when(some, n(lines)).otherwise(0)).withColumn("n_dropped", F.when(some, F.col("n_lines") - n(kept)).otherwise(0))
    return out.withColumn(text_col, F.when(some, F.array_join(kept, "\n"))).select(*names, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, its source being the site."""
    return drop_lines(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
u AS (SELECT host, unnest(list_distinct(list_filter(ls, lambda x: trim(x) <> ''))) AS line FROM d),
b AS (SELECT u.host, line FROM u JOIN n ON u.host = n.host GROUP BY u.host, line, pages HAVING count(*) >= {LEAST} AND count(*) > {RATIO}::DOUBLE * pages),
k AS (SELECT host, list(line) AS bs FROM b GROUP BY host),
r AS (SELECT doc_id, ls, CASE WHEN bs IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bs, x)) END AS kept FROM d LEFT JOIN k ON d.host = k.host)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN ls IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM r"""
}
