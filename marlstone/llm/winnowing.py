"""Document fingerprints by winnowing.

A hash of every K consecutive code points is made by doubling; of each WINDOW consecutive hashes the smallest is kept, the
rightmost where several are equal, with its position. Two texts that share K + WINDOW - 1 consecutive code points share a kept
hash. A text too short for a window keeps its smallest hash, one shorter than K the hash of the whole.

The fingerprint is the kept hashes in text order, 8 hexadecimal digits each; likeness() of two fingerprints is the size of the
intersection of their sets of hashes over that of the union (1 for two empty ones).

Defined results: null text is empty and has the empty fingerprint. Documents with null ids come first; rows with equal ids are
ordered by text; the document after the last is the first, in a table of one row the row itself. Repeated rows stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K = 12
WINDOW = 24
LEAST = -(1 << 63)
PART_BYTES = 16 << 20
MAX_PARTS = 20_000


def hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams of code points: that of a + b follows from those of a and b."""
    base, n = 0x9E3779B97F4A7C15, len(codes) - k + 1
    have, h, done, width = np.zeros(n, np.uint64), codes.astype(np.uint64) + np.uint64(1), 0, 1
    while True:
        factor = np.uint64(pow(base, width, 1 << 64))
        if k & width:
            have = have * factor + h[done : done + n]
            done += width
        if width * 2 > k:
            break
        h = h[:-width] * factor + h[width:]
        width *= 2
    have ^= have >> np.uint64(29)
    have *= np.uint64(0xBF58476D1CE4E5B9)
    return (have >> np.uint64(32)).astype(np.uint32)


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that are kept of a text given as code points."""
    if len(codes) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = hashes(codes, min(k, len(codes)))
    back = np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)  # rightmost first among equals
    low = h.astype(np.uint64) << np.uint64(32) | back
    window = min(window, len(h))
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(h) - window + 1], low[window - width :])
    kept = low[np.flatnonzero(np.diff(low, prepend=~low[:1]))]
    at = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return (kept >> np.uint64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint_text(h: np.ndarray) -> str:
    return h.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint and positions (array of the kept hashes' offsets in code points)."""
    common.small_batches(docs.sparkSession)
    kept = docs.drop("fingerprint", "positions")
    at = kept.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [winnow(code_points(t or "")) for t in b.column(at).to_pylist()]
            cols = [pa.array([fingerprint_text(h) for h, _ in got], pa.string()), pa.array([p for _, p in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "fingerprint", "positions"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("positions", T.ArrayType(T.LongType()))]))


def with_next(docs: DataFrame, make, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """make(list of ids, list of texts with one more, the text after the last) for runs of documents in ascending id order.

    Texts move once, to the range of ids they fall in; the first document of each range also goes to the range before."""
    spark = docs.sparkSession
    common.small_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    ids = docs.select(key.alias("_key"), F.octet_length(common.text_of(docs, text_col)).alias("_bytes"))
    size = ids.agg(F.sum("_bytes")).collect()[0][0]
    n_parts = int(min(MAX_PARTS, max(common.spread(spark), (size or 0) // PART_BYTES)))
    found = ids.agg(F.percentile_approx("_key", F.array(*[F.lit(i / n_parts) for i in range(1, n_parts)]), F.lit(100 * n_parts))).collect()[0][0] if size is not None and n_parts > 1 else []
    cuts = sorted(set(found or []))
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length(), -1, -1)])
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")

    def part_of(k):  # how many cuts are at or below k, by binary search
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(numbers(cuts), at + step - 1) <= k, step).otherwise(0))

    firsts = dict(ids.groupBy(part_of(F.col("_key")).alias("p")).agg(F.min("_key")).collect())  # a row per range at most
    there = sorted(firsts)
    before = {p: there[i - 1] for i, p in enumerate(there)}
    row = docs.select(key.alias("_key"), F.col(id_col).cast("long").alias("_id"), common.text_of(docs, text_col).alias("_text")).withColumn("_part", part_of(F.col("_key")))
    every = range(len(cuts) + 1)
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("after"))
    again = F.struct(F.get(numbers([before.get(p) for p in every]), F.col("_part")).cast("int").alias("part"), F.lit(True).alias("after"))
    is_first = F.get(numbers([firsts.get(p) for p in every]), F.col("_part")) == F.col("_key")
    dealt = row.withColumn("_to", F.explode(F.when(is_first, F.array(own, again)).otherwise(F.array(own)))).select("_key", "_id", "_text", "_to.part", "_to.after")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("after", "_key", "_text")

    def run(batches):
        ids, texts, ended = [], [], False
        for b in batches:
            for i, text, after in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if not after:
                    ids.append(i)
                    texts.append(text)
                elif not ended:
                    yield make(ids, [*texts, text])
                    ended = True
            if not ended and len(ids) > 1:
                yield make(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.mapInArrow(run, schema)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digest(ids: list, texts: list[str]) -> pa.RecordBatch:
    """What op10 returns, for a run of documents."""
    codes = [code_points(t) for t in texts]
    own = [winnow(c)[0] for c in codes]
    edited, other = [], []
    for i in range(len(ids)):
        n = len(codes[i])
        m = n // 4
        edited.append(texts[i][: n - m] + texts[i + 1][:m])
        other.append(winnow(np.concatenate([codes[i][: n - m], codes[i + 1][:m]]))[0])
    cols = [
        pa.array(ids, pa.int64()),
        pa.array([len(c) for c in codes[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
        pa.array([fingerprint_text(h) for h in own[:-1]], pa.string()),
        pa.array([fingerprint_text(h) for h in other], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with the fingerprint of its text and of its edited text."""
    return with_next(common.table(spark, sf_dir, "documents"), _digest, _SCHEMA)


QUERIES = {"op10_winnowing": op10_winnowing}
SQL: dict[str, str] = {}
