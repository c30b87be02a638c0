"""Queries of text, retrieval and language operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import language, tables, text
from marlstone.operators import retrieval
from marlstone.sources.tables import passages, spread, stored, table

K = 5


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) >= {len(s) + 4} THEN left(w, length(w) - {len(s)})" for s in text.SUFFIXES) + " ELSE w END"
_STOP = _sql_list(sorted({*text.STOP_WORDS, *text.QUESTION_WORDS}))


def _terms(col: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w)), lambda w: {_STEM})"


_FOLD = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


LANGUAGES = ["en", "fr", "de", "es"]


def _queries(s, d):
    """Benchmark texts as questions, each to the scope of every language."""
    each = table(s, d, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, LANGUAGES))).alias("scope"), "text")
    return each.select(F.concat_ws("|", F.col("item_id").cast("string"), "scope").alias("query"), "scope", "text")


def _index(s, d):
    return stored(s, d, "index", lambda: retrieval.index(passages(s, d)))


def _ranked(df):
    return df.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_INDEX = f"""docs AS (SELECT doc_id AS doc, lang AS scope, {_terms('text')} AS terms FROM documents),
len AS (SELECT doc, scope, len(terms) AS dl FROM docs),
scopes AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY scope),
post AS (SELECT scope, term, doc, count(*) AS tf FROM (SELECT scope, doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
idf AS (SELECT scope, term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post JOIN scopes USING (scope) GROUP BY scope, term)"""
_EACH = f"""each AS (SELECT item_id, item_id || '|' || scope AS query, scope, text FROM benchmark, (SELECT unnest({_sql_list(LANGUAGES)}) AS scope))"""
_ASKED = f"""{_EACH},
asked AS (SELECT DISTINCT query, scope, unnest({_terms('text')}) AS term FROM each),
scored AS (SELECT query, doc, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked JOIN idf USING (scope, term) JOIN post USING (scope, term) JOIN len USING (doc, scope) JOIN scopes USING (scope) GROUP BY query, doc),
bm25 AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored WHERE score > 0)"""


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def _query_vectors(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


_DENSE = """u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
dense AS (SELECT q.vec_id AS query, e.vec_id AS doc, round(list_inner_product(q.v, e.v), 9) AS score FROM u e JOIN u q ON q.vec_id % 100 = 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dense)"""


def rrf_hybrid(s, d):
    """Two rankings of each question fused: by its terms, and by those of its first ten words."""
    short = _queries(s, d).withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 10), " "))
    idx = _index(s, d)
    return retrieval.fuse([retrieval.bm25(idx, _queries(s, d), 20), retrieval.bm25(idx, short, 20)]).where(F.col("rank") <= K)


def hybrid_search(s, d):
    """BM25 search of the whole pipeline: depth, fusion, removal of repeats."""
    return retrieval.search(passages(s, d), _index(s, d), _queries(s, d), 3)


def _vector_texts(s, d):
    """Every hundredth vector's document as a question by text and by vector; documents beside their vectors by id."""
    asked = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    texts = table(s, d, "documents").join(asked, F.col("doc_id") == F.col("query")).select("query", F.col("lang").alias("scope"), "text")
    return texts, asked


def hybrid_dense(s, d):
    """Terms and vectors fused: documents that stand in embeddings under their id, asked for by every hundredth of them."""
    texts, asked = _vector_texts(s, d)
    return retrieval.search(passages(s, d), _index(s, d), texts, 3, _vectors(s, d), asked)


def _questions(s, d):
    """Benchmark texts: odd ones ask English passages, even ones those of all languages."""
    many = F.array(*map(F.lit, LANGUAGES))
    return table(s, d, "benchmark").select(F.col("item_id").alias("question"), F.when(F.col("item_id") % 2 == 1, F.array(F.lit("en"))).otherwise(many).alias("scopes"), "text")


def filing_search(s, d):
    got = retrieval.filing_search(passages(s, d), _index(s, d), _questions(s, d))
    return got.select("question", "scope", "doc", F.col("rank").cast("long").alias("rank"), "excerpt", "finding")


def filing_evidence(s, d):
    """The numbers that the excerpts of filing_search quote, in order: the values of their evidence."""
    got = retrieval.filing_search(passages(s, d), _index(s, d), _questions(s, d))
    return got.select("question", "scope", "doc", F.posexplode_outer("quoted").alias("pos", "value")).select("question", "scope", "doc", F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), "value")


def verifier_recall(s, d):
    """Per kind of error: how many wrong copies of a sentence about each order there are, how many of them the verifier rejects, and the right
    sentences it accepts. A copy that still matches the order's values as precisely as it is stated is no error and is left out."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = spread(table(s, d, "orders").groupBy(cents.alias("c")).agg(F.count(F.lit(1)).alias("n")))  # orders of one amount have one sentence
    money = F.concat(F.lit("$"), F.format_number(F.expr("c div 100"), 0), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    answers = rows.select(F.struct("c", "n").alias("id"), F.concat(F.lit("In FY2024 the order came to "), money, F.lit(" [order].")).alias("answer"), F.array(F.col("c") / 100.0).alias("values"))
    right = language.judged(answers).select(F.lit("right").alias("change"), "id.n", "status")
    wrong = language.judged(language.perturbed(answers)).select("change", "id.n", "status")
    times = lambda status: F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0))
    return right.unionByName(wrong).groupBy("change").agg(F.sum("n").alias("n"), times("failed").alias("rejected"), times("verified").alias("accepted"))


_SCORED = _ASKED[_ASKED.index("(SELECT DISTINCT query") :]
_FOLDED = f"""r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS k FROM f),
o AS (SELECT query, doc, k, row_number() OVER (PARTITION BY query, {_FOLD.format('text')} ORDER BY k) AS same FROM r JOIN documents ON doc = doc_id WHERE k <= 6),
o2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY k) AS rank FROM o WHERE same = 1)"""
_EXCERPT = f"""squeezed AS (SELECT *, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS whole FROM hits),
parts AS (SELECT *, string_split(regexp_replace(whole, '([.;:]) ', '\\1' || chr(1), 'g'), chr(1)) AS ps, list_distinct({_terms('q')}) AS wanted FROM squeezed),
counted AS (SELECT *, list_transform(ps, lambda p1: len(list_intersect(list_distinct({_terms('p1')}), wanted))) AS shared FROM parts),
placed AS (SELECT *, list_position(shared, list_max(shared)) AS best FROM counted),
led AS (SELECT *, array_to_string(ps[best:], ' ') AS rest, CASE WHEN best > 1 THEN '...' ELSE '' END AS lead FROM placed),
cut AS (SELECT *, CASE WHEN length(whole) <= 600 THEN whole WHEN length(rest) <= 600 - length(lead) THEN lead || rest ELSE lead || regexp_replace(rest[1:597 - length(lead)], ' [^ ]*$', '') || '...' END AS excerpt FROM led)"""
_FIRST = "regexp_replace(string_split(regexp_replace(excerpt, '^\\.\\.\\.', ''), '. ')[1], '\\.+$', '')"


# Numbers of an excerpt, with what stands in for the looks ahead and behind of NUMBER and NOT_CLAIMS, which this SQL does not have.
_UNIT = r"(?i:%|x\b|(?:trillion|billion|million|thousand|tn|bn|mn|mm|[tbmk])\b)"
_DIGITS = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_NO_CLAIMS = "|".join(f"(?i:{p})" if i else f"(?:{p})" for p, i in zip(language.NOT_CLAIMS, language.CASELESS)).replace(r"(?![.,]\d|\s?%|\s?(?:billion|million))", "")
_NUMBERS = rf"([-−]?\$?\b(?:19|20)\d{{2}}(?:[.]\d+\s?{_UNIT}?|,\d{{3}}(?:\.\d+)?\s?{_UNIT}?|\s?(?:%|(?:billion|million)\b)))|[-−]?\$?(?:{_NO_CLAIMS})|\pL[-−]?\$?{_DIGITS}\s?{_UNIT}?|([-−]?\$?{_DIGITS}\s?{_UNIT}?)"
_SCALES = "CASE u " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in {**language.SCALES, "%": 0.01}.items()) + " ELSE 1.0::DOUBLE END"
_QUOTED = rf"""found AS (SELECT question, scope, doc, list_filter(list_transform(list_zip(regexp_extract_all(excerpt, '{_NUMBERS}', 1), regexp_extract_all(excerpt, '{_NUMBERS}', 2)), lambda x: coalesce(x[1], '') || coalesce(x[2], '')), lambda x: x <> '') AS cs FROM cut),
each_claim AS (SELECT question, scope, doc, unnest(CASE WHEN len(cs) = 0 THEN [-1] ELSE range(len(cs)) END)::BIGINT AS pos, cs FROM found),
read AS (SELECT question, scope, doc, pos, CASE WHEN pos >= 0 THEN cs[pos + 1] END AS c, lower(regexp_extract(CASE WHEN pos >= 0 THEN cs[pos + 1] END, '[%A-Za-z]+')) AS u FROM each_claim)
SELECT question, scope, doc, pos, regexp_replace(c, '[^0-9.]', '', 'g')::DOUBLE * {_SCALES} * CASE WHEN regexp_matches(c, '^[-−]') THEN -1 ELSE 1 END AS value FROM read"""

# What a sentence about an order becomes, by change: whole cents, as a fraction of them, half up; a copy counts if it differs by over half a cent.
_RECALL = """WITH t AS (SELECT round(o_totalprice * 100)::BIGINT AS c FROM orders),
v AS (SELECT c, change, c * (1 + share) AS x FROM t, (VALUES ('+0.005', 0.005::DOUBLE), ('-0.01', -0.01::DOUBLE), ('+0.05', 0.05::DOUBLE), ('-0.1', -0.1::DOUBLE), ('+0.5', 0.5::DOUBLE)) AS p(change, share)
UNION ALL SELECT c, 'swap', (s[2] || s[1] || s[3:])::DOUBLE FROM (SELECT c, (c // 100)::VARCHAR || lpad((c % 100)::VARCHAR, 2, '0') AS s FROM t) WHERE s[1] <> s[2]),
w AS (SELECT change, count(*) AS n FROM v WHERE abs(round(x) - c) > 0.5 + 1e-7 * greatest(1, c / 100) GROUP BY 1)
SELECT change, n, n AS rejected, 0::BIGINT AS accepted FROM w UNION ALL SELECT 'right', count(*), 0, count(*) FROM t"""


def _turns(s, d):
    return table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def chunk_documents(s, d):
    got = table(s, d, "documents").select("doc_id", F.posexplode(text.chunks_udf("text")).alias("position", "chunk"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("longest"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk"))), lambda x: x["chunk"]), "\n").cast("binary")).alias("md5"))


def chunk_rows(s, d):
    """Chunks of all documents by SQL: a table function in a lateral join."""
    tables.register(s)
    table(s, d, "documents").createOrReplaceTempView("marlstone_documents")
    return s.sql("SELECT d.doc_id, CAST(c.position AS BIGINT) AS position, length(c.chunk) AS n_chars, md5(CAST(c.chunk AS BINARY)) AS md5 FROM marlstone_documents d, LATERAL chunk_text(d.text) c")


# Packing as a fold of each text's pieces: chr(30) between chunks, a new line within one.
_CHUNKS = rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i){text.FURNITURE.pattern.replace("'", "''")}')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 1) AS ls FROM documents),
p AS (SELECT doc_id, flatten(list_transform(ls, lambda x: CASE WHEN length(x) > 1800 THEN string_split(regexp_replace(x, '([.;])\s+', '\1' || chr(29), 'g'), chr(29)) ELSE [x] END)) AS ps FROM l),
f AS (SELECT doc_id, string_split(list_reduce(ps, lambda acc, x: acc || CASE WHEN length(string_split(acc, chr(30))[-1]) + 1 + length(x) <= 1200 THEN chr(10) ELSE chr(30) END || x), chr(30)) AS cs FROM p WHERE len(ps) > 0)"""

# Invented names for shares: the regions, two of which go by another name.
REGIONS, ALIASES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], {"new world": "AMERICA", "old world": "EUROPE"}


def _orders(s, d):
    """A sentence per customer with shares of its own region and of another."""
    where = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    k = F.col("c_custkey")
    words = F.concat(F.lit("Put "), (k % 90 + 5).cast("string"), F.lit("% in "), F.col("r_name"), F.lit(", "), (k % 7).cast("string"), F.lit(".5 % of the New World, 1% of what is LASIA, and then 10% "), F.col("r_name"))
    return table(s, d, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", words.alias("q"))


def extract_claims(s, d):
    """The numbers in a sentence about each order, between others that are no claims. Cut, not rounded, from whole cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    part = lambda n: F.expr(f"c div {n}").cast("string")
    rows = spread(table(s, d, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", cents.alias("c"))
    told = F.concat(
        F.lit("FY2024 order [o:1] of 1996-01-02 came to $"), F.regexp_replace(F.format_number(F.expr("c div 100"), 0), "$", "."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"),
        F.lit(", -"), part(100_000), F.lit("."), (F.expr("c div 10000") % 10).cast("string"), F.lit("k or "), part(10_000), F.lit("% (Item 7, 10-K), 2.5x of Q3."),
    )
    got = rows.select("o_orderkey", language.claims(told).alias("c")).select("o_orderkey", F.posexplode_outer("c").alias("pos", "c")).where("pos is not null")  # explode() would work the array out for a filter, too
    return got.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "c.kind", F.round("c.value", 4).alias("value"), F.round("c.tolerance", 6).alias("tolerance"))


def verify_claims(s, d):
    """Statements about each customer's balance, right and slightly wrong, against the balance itself."""
    money = text.format_value(F.col("c_acctbal") * 1e6, F.lit("USD"))
    wrong = text.format_value(F.col("c_acctbal") * 1.05e6, F.lit("USD"))
    rows = spread(table(s, d, "customer").select("c_custkey", "c_acctbal")).select("c_custkey", F.explode(F.array(F.struct(F.lit(True).alias("right"), F.concat(F.lit("The balance was "), money, F.lit(" in FY2024.")).alias("answer")), F.struct(F.lit(False).alias("right"), F.concat(F.lit("The balance was "), wrong).alias("answer")))).alias("a"), F.array(F.col("c_acctbal") * 1e6).alias("values"))
    out = rows.select("a.right", language.verify(language.claims(F.col("a.answer")), F.col("values")).alias("v"))
    return out.groupBy("right", F.col("v.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pii_redaction(s, d):
    got = table(s, d, "documents").select("doc_id", language.redact(F.col("text")).alias("r"))
    return got.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("md5"), *[F.coalesce(F.col("r.counts")[k], F.lit(0)).cast("long").alias(k) for k, _ in language.PII])


def pii_sentences(s, d):
    """A sentence about each customer with personal data of every kind, a card number with its right check digit and one with a wrong one."""
    k, digits = F.col("c_custkey"), F.concat((k_ := F.lpad((4000 + F.col("c_custkey") % 1000).cast("string"), 4, "0")), F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0"), F.lit("0000000"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda acc, i: acc + (lambda x: F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))(F.substring(digits, i + 1, F.lit(1)).cast("int")))
    rows = spread(table(s, d, "customer").select("c_custkey")).select(k, k_.alias("a"), F.lpad((k % 10_000).cast("string"), 4, "0").alias("b"), ((10 - total % 10) % 10).alias("k"))
    n = lambda width: F.lpad((k % 10**width).cast("string"), width, "1")
    card = lambda last: F.concat("a", F.lit(" "), "b", F.lit(" 0000 000"), last.cast("string"))
    said = F.concat(
        F.lit("Write to c"), k.cast("string"), F.lit("@shop.example.org or call +34 612 "), n(3), F.lit(" "), n(3), F.lit(". Card "), card(F.col("k")), F.lit(", not "), card((F.col("k") + 1) % 10),
        F.lit("; SSN 123-45-"), F.lpad((1 + k % 9999).cast("string"), 4, "0"), F.lit(" and 000-12-3456, id "), n(8), F.lit("Z, account GB29 NWBK "), n(4), F.lit(" LTSB QXYZ."),
    )
    got = rows.select("c_custkey", language.redact(said).alias("r"))
    return got.select("c_custkey", "r.text", *[F.coalesce(F.col("r.counts")[kind], F.lit(0)).cast("long").alias(kind) for kind, _ in language.PII])


_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+"


def route_questions(s, d):
    """Every question four times: with and without a company, with and without a portfolio."""
    flags = F.explode(F.array(*[F.struct(F.lit(bool(i & 1)).alias("company"), F.lit(bool(i & 2)).alias("portfolio")) for i in range(4)]))
    got = _turns(s, d).withColumn("f", flags)
    return got.select("conv_id", "turn", "f.*", F.array_join(language.route(F.col("text"), F.col("f.company"), F.col("f.portfolio")), ",").alias("tools"))


_SQL_METRICS = "list_filter([" + ", ".join("CASE WHEN regexp_matches(text, '(?i)" + p.replace("'", "''") + f"') THEN '{m}' END" for p, m in language.METRIC_PHRASES) + "], lambda m: m IS NOT NULL)"


def _m(p: str) -> str:
    return "regexp_matches(text, '(?i)" + p.replace("'", "''") + "')"


QUERIES = {
    "analyze_terms": lambda s, d: table(s, d, "documents").select("doc_id", text.analyze(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("md5")),
    "fold_distinct": lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.countDistinct(text.fold(F.col("text"))).alias("n")),
    "bm25_idf": lambda s, d: retrieval.idf(retrieval.postings(_index(s, d)), retrieval.scopes(_index(s, d))).select("scope", "term", "df", F.round("idf", 6).alias("idf")),
    "bm25_topk": lambda s, d: _ranked(retrieval.bm25(_index(s, d), _queries(s, d), K)),
    "dense_topk": lambda s, d: _ranked(retrieval.dense(_vectors(s, d), _query_vectors(s, d), K)),
    "rrf_hybrid": lambda s, d: _ranked(rrf_hybrid(s, d)),
    "hybrid_search": lambda s, d: hybrid_search(s, d).select("query", "doc", F.col("rank").cast("long").alias("rank")),
    "dedupe_passages": lambda s, d: table(s, d, "documents").groupBy("lang", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded")).agg(F.min("doc_id").alias("doc_id")).select("lang", "doc_id"),
    "chunk_documents": chunk_documents,
    "chunk_rows": chunk_rows,
    "html_to_text": lambda s, d: table(s, d, "pages").select("page_id", text.html_to_text_udf("html").alias("text")),
    "excerpt_best_sentence": lambda s, d: retrieval.bm25(_index(s, d), _queries(s, d), 1).join(passages(s, d).select("doc", F.col("text").alias("p")), "doc").join(_queries(s, d).select("query", "text"), "query").select("query", "doc", text.excerpt(F.col("p"), F.col("text")).alias("excerpt")).withColumn("first_sentence", text.first_sentence(F.col("excerpt"))),
    "hybrid_dense": lambda s, d: hybrid_dense(s, d).select("query", "doc", F.col("rank").cast("long").alias("rank")),
    "filing_search": filing_search,
    "filing_evidence": filing_evidence,
    "verifier_recall": verifier_recall,
    "extract_tickers": lambda s, d: _orders(s, d).select("c_custkey", F.array_join(language.tickers_in(F.col("q"), REGIONS, ALIASES), ",").alias("tickers")),
    "extract_weights": lambda s, d: _orders(s, d).select("c_custkey", F.explode(language.weights_in(F.col("q"), REGIONS, ALIASES)).alias("ticker", "weight")),
    "extract_claims": extract_claims,
    "extract_metrics": lambda s, d: _turns(s, d).select("conv_id", "turn", F.array_join(language.metrics_in(F.col("text")), ",").alias("metrics")),
    "extract_fiscal_year": lambda s, d: _turns(s, d).select("conv_id", "turn", language.fiscal_year_in(F.col("text")).alias("fiscal_year")),
    "route_questions": route_questions,
    "injection_flags": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", language.injected(F.col("text")).alias("blocked")),
    "pii_email_counts": lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(_EMAIL)).cast("long").alias("emails")),
    "pii_redaction": pii_redaction,
    "pii_sentences": pii_sentences,
    "verify_claims": verify_claims,
    "format_values": lambda s, d: table(s, d, "orders").select("o_orderkey", text.format_value(F.col("o_totalprice") * 1000, F.lit("USD")).alias("usd")),
    "passage_ids": lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws(":", "lang", "source", F.lit("1A"), F.format_string("%03d", "doc_id"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8)).alias("passage_id")),
}

SQL = {
    "analyze_terms": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS md5 FROM t",
    "fold_distinct": f"SELECT lang, count(DISTINCT {_FOLD.format('text')}) AS n FROM documents GROUP BY lang",
    "bm25_idf": f"WITH {_INDEX} SELECT scope, term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_INDEX}, {_ASKED} SELECT query, doc, round(score, 6) AS score, rank FROM bm25 WHERE rank <= {K}",
    "dense_topk": f"WITH {_DENSE} SELECT query, doc, round(score, 6) AS score, rank FROM nearest WHERE rank <= {K}",
    "rrf_hybrid": f"""WITH {_INDEX}, {_ASKED}, a AS (SELECT query, doc, rank FROM bm25 WHERE rank <= 20),
asked2 AS (SELECT DISTINCT query, scope, unnest({_terms("array_to_string(string_split(text, ' ')[1:10], ' ')")}) AS term FROM each),
scored2 AS (SELECT query, doc, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked2 JOIN idf USING (scope, term) JOIN post USING (scope, term) JOIN len USING (doc, scope) JOIN scopes USING (scope) GROUP BY query, doc),
b AS (SELECT query, doc, rank FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored2 WHERE score > 0) WHERE rank <= 20),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM a UNION ALL SELECT query, doc, rank FROM b) GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= {K}""",
    "hybrid_search": f"""WITH {_INDEX}, {_ASKED}, f AS (SELECT query, doc, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM bm25 WHERE rank <= 24),
{_FOLDED}
SELECT query, doc, rank FROM o2 WHERE rank <= 3""",
    "hybrid_dense": f"""WITH {_INDEX}, each AS (SELECT vec_id AS query, lang AS scope, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
asked AS {_SCORED}, {_DENSE},
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM bm25 WHERE rank <= 24 UNION ALL SELECT query, doc, rank FROM nearest WHERE rank <= 24) GROUP BY 1, 2),
{_FOLDED}
SELECT query, doc, rank FROM o2 WHERE rank <= 3""",
    "filing_search": f"""WITH {_INDEX}, {_EACH.replace("benchmark, (", "benchmark JOIN (").replace("AS scope))", "AS scope) ON scope = 'en' OR item_id % 2 = 0)")},
asked AS {_SCORED}, f AS (SELECT query, doc, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM bm25 WHERE rank <= 24),
{_FOLDED},
hits AS (SELECT item_id AS question, scope, doc, rank, documents.text AS p, each.text AS q FROM o2 JOIN each USING (query) JOIN documents ON doc = doc_id WHERE rank <= CASE WHEN item_id % 2 = 1 THEN 3 ELSE 2 END),
{_EXCERPT}
SELECT question, scope, doc, rank, excerpt, {_FIRST} AS finding FROM cut""",
    "verifier_recall": _RECALL,
    "chunk_documents": _CHUNKS + " SELECT doc_id, len(cs)::BIGINT AS n_chunks, list_max(list_transform(cs, lambda c: length(c)))::INT AS longest, md5(array_to_string(cs, chr(10))) AS md5 FROM f",
    "chunk_rows": _CHUNKS + " SELECT doc_id, position, length(chunk)::INT AS n_chars, md5(chunk) AS md5 FROM (SELECT doc_id, unnest(range(len(cs))) AS position, unnest(cs) AS chunk FROM f)",
    "pii_sentences": """SELECT c_custkey, 'Write to [EMAIL] or call [PHONE]. Card [CARD], not ' || lpad((4000 + c_custkey % 1000)::VARCHAR, 4, '0') || ' ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' 0000 000' || ((k + 1) % 10) || '; SSN [SSN] and [PHONE], id [DNI], account [IBAN].' AS text,
  1::BIGINT AS email, 1::BIGINT AS card, 1::BIGINT AS ssn, 1::BIGINT AS dni, 1::BIGINT AS iban, 2::BIGINT AS phone
FROM (SELECT c_custkey, (10 - list_sum(list_transform(range(15), lambda i: CASE WHEN i % 2 = 0 THEN d[i + 1] * 2 - CASE WHEN d[i + 1] > 4 THEN 9 ELSE 0 END ELSE d[i + 1] END)) % 10) % 10 AS k
  FROM (SELECT c_custkey, list_transform(string_split(lpad((4000 + c_custkey % 1000)::VARCHAR, 4, '0') || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '0000000', ''), lambda x: x::INT) AS d FROM customer))""",
    "excerpt_best_sentence": f"""WITH {_INDEX}, {_ASKED},
hits AS (SELECT query, doc, documents.text AS p, each.text AS q FROM bm25 JOIN each USING (query) JOIN documents ON doc = doc_id WHERE rank <= 1),
{_EXCERPT}
SELECT query, doc, excerpt, {_FIRST} AS first_sentence FROM cut""",
    "extract_tickers": "SELECT c_custkey, CASE WHEN r_name = 'AMERICA' THEN r_name ELSE r_name || ',AMERICA' END AS tickers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "extract_weights": """WITH c AS (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, r_name AS ticker, (c_custkey % 90 + 5) / 100.0::DOUBLE AS weight FROM c UNION ALL SELECT c_custkey, 'AMERICA', (c_custkey % 7 + 0.5::DOUBLE) / 100.0::DOUBLE FROM c WHERE r_name <> 'AMERICA'""",
    "extract_claims": """WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders),
u AS (SELECT o_orderkey, [{'pos': 0, 'kind': 'usd', 'value': c / 100.0::DOUBLE, 'tolerance': 0.005::DOUBLE}, {'pos': 1, 'kind': 'usd', 'value': -100.0::DOUBLE * (c // 10000), 'tolerance': 50.0::DOUBLE},
  {'pos': 2, 'kind': 'pct', 'value': (c // 10000) / 100.0::DOUBLE, 'tolerance': 0.005::DOUBLE}, {'pos': 3, 'kind': 'multiple', 'value': 2.5::DOUBLE, 'tolerance': 0.05::DOUBLE}] AS cs FROM t),
e AS (SELECT o_orderkey, unnest(cs) AS c FROM u)
SELECT o_orderkey, c.pos::BIGINT AS pos, c.kind AS kind, round(c.value, 4) AS value, round(c.tolerance, 6) AS tolerance FROM e""",
    "dedupe_passages": f"SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, {_FOLD.format('text')}",
    "extract_metrics": f"SELECT conv_id, turn, array_to_string(CASE WHEN {_m(language.GROWTH_PHRASE)} THEN list_filter(m, lambda x: x <> 'revenue') ELSE m END, ',') AS metrics FROM (SELECT *, {_SQL_METRICS} AS m FROM conversations WHERE role = 'user')",
    "extract_fiscal_year": f"SELECT conv_id, turn, list_max(list_transform(regexp_extract_all(text, '(?i){language.YEAR_PHRASE}', 1), lambda y: y::INT)) AS fiscal_year FROM conversations WHERE role = 'user'",
    "route_questions": f"""WITH t AS (SELECT conv_id, turn, len({_SQL_METRICS}) > 0 OR {_m(language.FUNDAMENTAL_PHRASES)} AS fund, {_m(language.FILING_PHRASES)} AS filing, {_m(language.PRETRADE_PHRASES)} AS trade, {_m(language.RISK_PHRASES)} AS r FROM conversations WHERE role = 'user'),
u AS (SELECT *, NOT trade AND (r OR (portfolio AND NOT fund AND NOT filing)) AS risk FROM t, (SELECT unnest([false, true]) AS company), (SELECT unnest([false, true]) AS portfolio)),
w AS (SELECT *, NOT (fund OR filing OR trade OR risk) AS none FROM u)
SELECT conv_id, turn, company, portfolio, array_to_string(list_filter([CASE WHEN fund OR (none AND company) THEN 'fundamentals' END, CASE WHEN filing OR (none AND NOT company) THEN 'filing_search' END, CASE WHEN risk THEN 'market_risk' END, CASE WHEN trade THEN 'pretrade_check' END], lambda x: x IS NOT NULL), ',') AS tools FROM w""",
    "injection_flags": "SELECT conv_id, turn, coalesce(" + " OR ".join(_m(p) for p in language.INJECTION) + ", false) AS blocked FROM conversations",
    "pii_email_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS emails FROM documents",
    "verify_claims": """SELECT "right", CASE WHEN c_acctbal IS NULL THEN 'no_numeric_claims' WHEN "right" OR c_acctbal = 0 THEN 'verified' ELSE 'failed' END AS status, count(*) AS n
  FROM customer, (SELECT unnest([true, false]) AS "right") GROUP BY 1, 2""",
    "format_values": """SELECT o_orderkey, CASE WHEN o_totalprice * 1000 >= 1e9 THEN '$' || format('{:,.2f}', o_totalprice * 1000 / 1e9) || ' billion' WHEN o_totalprice * 1000 >= 1e6 THEN '$' || format('{:,.2f}', o_totalprice * 1000 / 1e6) || ' million'
  ELSE '$' || format('{:,.2f}', o_totalprice * 1000) END AS usd FROM orders""",
    "passage_ids": "SELECT doc_id, lang || ':' || source || ':1A:' || CASE WHEN doc_id < 1000 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END || ':' || left(sha256(text), 8) AS passage_id FROM documents",
}

SQL["filing_evidence"] = SQL["filing_search"][: SQL["filing_search"].rindex("\nSELECT question")] + ",\n" + _QUOTED
