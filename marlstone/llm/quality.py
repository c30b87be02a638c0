"""Quality classifier by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is cut into pieces of PIECE bytes and each piece is compressed under either dictionary. The difference of the two
compressed sizes divided by their sum is all that a score knows of a text; a slope and an intercept, fitted by logistic
regression on labelled texts that built no dictionary, turn it into a probability of label 1.

What is learned from is a bounded sample: per label the `sample` documents with the smallest hashes of their ids, half for
dictionaries (at most `n_pieces` pieces), half for calibration. Rows that are held out are never learned from. Where there are
too few pieces for the dictionary builder, their own bytes are the (raw) dictionary.

Defined results: null text is empty; empty texts get a score like any other (difference 0). Rows whose
doc_id is null are held out. Without texts of both labels every score is the share of label 1 (0.5 without any). Repeated
rows get equal scores; an empty table gives an empty result. Columns of the input stay, but for `score`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PIECE = 1024
LEVEL = 3
DICT_BYTES = 112 << 10
SAMPLE = 3000
PIECES = 4000
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    mean: float = 0.0
    scale: float = 1.0
    line: list[float] = field(default_factory=list)  # intercept and slope of the standardised difference; empty: the prior
    prior: float = 0.5


def _compressor(data: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(raw: bytes, good, bad) -> float:
    """The size under the good dictionary less that under the bad one, over their sum."""
    g = b = 0
    for i in range(0, len(raw), PIECE):
        g += len(good.compress(raw[i : i + PIECE]))
        b += len(bad.compress(raw[i : i + PIECE]))
    return (g - b) / max(g + b, 1)


def _map_differences(df: DataFrame, model: Model, text_col: str, finish, name: str, kind: T.DataType) -> DataFrame:
    """df and a column that finish() makes of the differences of each batch."""
    common.small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.good, model.bad))
    kept = df.drop(name)
    at = kept.columns.index(text_col)

    def run(batches):
        good, bad = map(_compressor, sent.value)
        for b in batches:
            x = np.array([difference((t or "").encode("utf-8"), good, bad) for t in b.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, finish(x)], [*b.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, kind)]))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text has remainder 0; true for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def _build(pieces: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for the builder: their own bytes, as a raw dictionary
        return b"".join(pieces)[-DICT_BYTES:]


def _least(df: DataFrame, n: int, total: dict[int, int], place, *ties) -> DataFrame:
    """Of either label the n rows of smallest hash (`place`): first a share of all hashes that holds about as many, with room, so
    that what tasks send on is bounded by n and not by their number."""
    parts = []
    for q in (0, 1):
        share = min(1.0, (n + 6 * n**0.5 + 10) / max(total.get(q, 0), 1))
        some = df.where((F.col("_label") == q) & (place <= int(-(2**63) + share * (2**64 - 2**11))))
        parts.append(some.orderBy(place, *ties).limit(n))
    return parts[0].unionByName(parts[1])


def _totals(df: DataFrame) -> dict[int, int]:
    return {r["_label"]: r["n"] for r in df.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_pieces: int = PIECES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the rows of docs that are not held out and have a label."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(~held_out("_id") & F.col("_label").isin(0, 1)).groupBy("_id").agg(F.min("_label").alias("_label"))
    true = _totals(known)
    chosen = _least(known, sample, true, F.xxhash64("_id"), F.col("_id")).select("_id", "_label", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).alias("_half"))
    texts = docs.select(F.col(id_col).alias("_id"), common.text_of(docs, text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # 2 * sample rows at most
    work = common.workspace(spark)
    sampled = common.saved(texts, f"{work}/labelled")
    try:
        return _learn(sampled, true, sample, n_pieces)
    finally:
        common.forget(spark, work)


def _learn(sampled: DataFrame, true: dict[int, int], sample: int, n_pieces: int) -> Model:
    """The model from sampled rows (_id, _label, _half, _text); true: how many rows have either label."""
    n = _totals(sampled)
    model = Model(prior=n.get(1, 0) / sum(n.values()) if n else 0.5)
    if len(n) < 2:
        return model
    raw = F.encode("_text", "utf-8")
    cut = sampled.where("_half = 0").select("_label", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(raw) - 1, F.lit(0)), F.lit(PIECE)), lambda i: F.substring(raw, i + 1, F.lit(PIECE)))).alias("_piece"))
    cut = cut.where(F.octet_length("_piece") > 0)
    got = _least(cut, n_pieces, _totals(cut), F.xxhash64("_piece"), F.col("_piece")).collect()  # 2 * n_pieces pieces of PIECE bytes at most
    pieces = {q: sorted(bytes(r["_piece"]) for r in got if r["_label"] == q) for q in (0, 1)}
    if not (pieces[0] and pieces[1]):
        return model
    model.bad, model.good = _build(pieces[0]), _build(pieces[1])
    rest = _least(sampled.where("_half = 1"), sample, n, F.xxhash64("_id", "_text"), F.col("_text"))
    got = _map_differences(rest.select("_label", "_text"), model, "_text", lambda x: pa.array(x, pa.float64()), "_x", T.DoubleType()).select("_label", "_x").collect()  # 2 * sample rows of two numbers at most
    got = sorted((r["_label"], r["_x"]) for r in got)
    if len({r[0] for r in got}) < 2:
        return Model(prior=model.prior)
    y, x = np.array([r[0] for r in got], float), np.array([r[1] for r in got])
    share = model.prior * (1 - model.prior)
    if share and sample:  # the halves hold as many rows of either label as there are, up to the bound: weigh them as the labels are
        weight = np.where(y == 1, true[1] / max((y == 1).sum(), 1), true[0] / max((y == 0).sum(), 1))
        weight *= len(y) / weight.sum()
    else:
        weight = np.ones(len(y))
    mean, scale = float(x.mean()), float(x.std()) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
        w += np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * w)
    model.mean, model.scale, model.line = mean, scale, w.tolist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the column score: the probability of label 1."""
    if not model.line:
        return docs.drop("score").withColumn("score", F.lit(model.prior))
    (intercept, slope), mean, scale = model.line, model.mean, model.scale

    def finish(x):
        return pa.array(1 / (1 + np.exp(-np.clip(intercept + slope * (x - mean) / scale, -30, 30))), pa.float64())

    return _map_differences(docs, model, text_col, finish, "score", T.DoubleType())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, scored."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
