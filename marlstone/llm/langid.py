"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams of NGRAM lower-cased characters are hashed to BUCKETS columns. Training counts them per language in parallel; the
matrix of smoothed log probabilities (languages x BUCKETS, at most MAX_CELLS cells) is broadcast, and a batch is scored by
adding the matrix rows of its n-grams, document by document, in numpy.

What is learned from is a bounded sample: of the rows that may be learned from, a share chosen by a hash of doc_id so that
about `sample` documents of each language remain (all of them, where there are fewer).

Defined results: null texts and texts without a letter give `und` with score 0; with nothing to learn from, so does every
text. Rows whose doc_id is null are held out. Ties go to the language first in order. Repeated rows get equal results.
Columns of the input stay, but for lang_pred and score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NGRAM = 3
BUCKETS = 1 << 16
MAX_CELLS = 1 << 26
SAMPLE = 5000
SLICE = 1 << 20  # characters scored at once


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    logs: np.ndarray | None = None  # buckets x languages
    prior: np.ndarray | None = None


def hashed(codes: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point but the last NGRAM - 1."""
    h = codes[: len(codes) - NGRAM + 1].astype(np.uint32)
    for k in range(1, NGRAM):
        h = h * np.uint32(0x9E3779B1) + codes[k : len(codes) - NGRAM + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(16)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of docs that are not held out and have a language."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where(~held_out("_id") & F.col("_lang").isNotNull())
    found = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CELLS // BUCKETS + 1).collect()}
    if len(found) * BUCKETS > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS // BUCKETS} languages: the matrix would be too large to broadcast")
    langs = sorted(found)
    if not langs:
        return Model()
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / found[k]))]), F.col("_lang"))
    chosen = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30)).where(F.col("_text").isNotNull())

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        at = {k: i for i, k in enumerate(langs)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = _codes(text)
                if len(codes) >= NGRAM:
                    total[at[lang]] += np.bincount(hashed(codes), minlength=BUCKETS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j], pa.int64())], ["i", "j", "n"])

    counts = np.zeros((len(langs), BUCKETS))
    got = chosen.select("_lang", "_text").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # MAX_CELLS rows at most
    counts[got["i"].to_numpy(), got["j"].to_numpy()] = got["n"].to_numpy()
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
    prior = np.log(np.array([found[k] for k in langs], float) / sum(found.values()))
    return Model(langs, np.ascontiguousarray(logs.T, np.float32), prior)


def log_likelihoods(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Sum of each text's matrix rows: texts x languages."""
    out = np.zeros((len(texts), logs.shape[1]))
    batch: list[np.ndarray] = []
    first = size = 0

    def flush(upto: int) -> None:
        codes = np.concatenate(batch)
        ends = np.cumsum([len(x) for x in batch])
        starts = np.concatenate([[0], ends[:-1]])
        rows = hashed(codes)  # n-grams over two texts are left out below
        for j in range(logs.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(logs[:, j][rows], dtype=np.float64)])
            out[first:upto, j] = sums[np.maximum(ends - NGRAM + 1, starts)] - sums[np.minimum(starts, len(sums) - 1)]

    for i, text in enumerate(texts):
        batch.append(_codes(text if text else " "))  # three blanks: never shorter than an n-gram
        size += len(batch[-1])
        if size >= SLICE:
            flush(i + 1)
            batch, first, size = [], i + 1, 0
    if batch:
        flush(len(texts))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language."""
    kept = docs.drop("lang_pred", "score")
    if not model.langs:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def run(batches):
        m = sent.value
        columns = np.asfortranarray(m.logs)
        ascii_letters = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            lettered = np.array([not ascii_letters.isdisjoint(t) or any(map(str.isalpha, t)) for t in texts], bool)
            x = log_likelihoods(texts, columns) + m.prior
            p = np.exp(x - x.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            names = [m.langs[k] if ok else "und" for k, ok in zip(best, lettered)]
            scores = np.where(lettered, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, with its predicted language."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_langid": op5_langid}
SQL: dict[str, str] = {}
