"""Whitening of embeddings by a compensated covariance.

All vectors' covariance is taken in double-double arithmetic: a number is an unevaluated sum of a high and a low double, sums and
products are error-free transformations. Each task centres runs of rows by their own mean before it multiplies, adds the outer
products, and joins runs by the rule for two groups (the sum of their products, and that of the difference of their means). What
a task has is sent on as high and low parts, in blocks of pairs of dimensions, and tasks are joined by the same rule in two rounds.
The covariance matrix, as many numbers as there are pairs of dimensions, is the only thing the driver solves: LAPACK's symmetric
solver, which makes the matrix tridiagonal and then divides and conquers.

Defined results: a row whose vector is null or empty, or holds a null, a NaN or an infinity, is dropped; so is one whose length is
not the most frequent one (the longest of several). Rows with equal or null ids stay. A component without variance has a null
whitened value and takes no part in identity_error; without any, explained and identity_error are null. deviation is null where
it passes 64 bits. An empty table gives an empty result. Columns of the input other than id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
ROWS, PAIRS = 32, 4096  # of products made at once
FAN = 64  # groups of tasks whose parts are joined first
_PART = "block int, salt int, n long, sums binary, products binary"

Pair = tuple[np.ndarray, np.ndarray]  # high and low parts


def _two_sum(a, b) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _tidy(a, b) -> Pair:
    s = a + b
    return s, b - (s - a)


def _two_product(a, b) -> Pair:
    p = a * b
    split = lambda x: ((c := 134217729.0 * x) - (c - x), x)
    (ah, a), (bh, b) = split(a), split(b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    s, e = _two_sum(x[0], y[0])
    t, f = _two_sum(x[1], y[1])
    s, e = _tidy(s, e + t)
    return _tidy(s, e + f)


def times(x: Pair, y: Pair) -> Pair:
    p, e = _two_product(x[0], y[0])
    return _tidy(p, e + (x[0] * y[1] + x[1] * y[0]))


def over(x: Pair, n: float) -> Pair:
    q = x[0] / n
    p, e = _two_product(q, np.float64(n))
    rest = add(x, (-p, -e))
    return _tidy(q, rest[0] / n)


def total(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    h, low = x
    while len(h) > 1:
        half = len(h) // 2
        s = add((h[:half], low[:half]), (h[half : 2 * half], low[half : 2 * half]))
        h, low = (np.concatenate([a, b[2 * half :]]) for a, b in zip(s, (h, low)))
    return h[0], low[0]


def minus(x: Pair) -> Pair:
    return -x[0], -x[1]


class Moments:
    """How many rows, their sums by dimension and the sums of centred products of some pairs (i, j) of dimensions."""

    def __init__(self, n: int, sums: Pair, products: Pair):
        self.n, self.sums, self.products = n, sums, products

    @classmethod
    def of(cls, rows: Pair, i: np.ndarray, j: np.ndarray) -> Moments:
        n = len(rows[0])
        sums = total(rows)
        d = add(rows, minus(over(sums, n)))
        return cls(n, sums, total(times((d[0][:, i], d[1][:, i]), (d[0][:, j], d[1][:, j]))))

    def join(self, other: Moments, i: np.ndarray, j: np.ndarray) -> Moments:
        n = self.n + other.n
        apart = add(over(other.sums, other.n), minus(over(self.sums, self.n)))
        weight = over(_two_product(np.float64(self.n), np.float64(other.n)), n)
        more = times(times((apart[0][i], apart[1][i]), (apart[0][j], apart[1][j])), weight)
        return Moments(n, add(self.sums, other.sums), add(add(self.products, other.products), more))


def _blocks(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    i, j = np.triu_indices(dim)
    return [(i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]


def _pack(x: Pair) -> bytes:
    return np.concatenate(x).tobytes()


def _unpack(b: bytes) -> Pair:
    x = np.frombuffer(b)
    return x[: len(x) // 2], x[len(x) // 2 :]


def _rows(found: dict[int, Moments], salt: int) -> pa.RecordBatch:
    cols = [[k, salt, m.n, _pack(m.sums), _pack(m.products)] for k, m in found.items()]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([c[x] for c in cols], t) for x, t in enumerate(kinds)], ["block", "salt", "n", "sums", "products"])


def moments(df: DataFrame, dim: int, make) -> tuple[int, list[int] | None, Pair, np.ndarray]:
    """(n, exact sums where they are whole numbers, sums, covariance matrix with divisor n) of the rows that make(batch) gives as
    high and low parts."""
    spark = df.sparkSession

    def run(batches):
        blocks, found = _blocks(dim), {}
        for b in batches:
            high, low = make(b)
            for at in range(0, len(high), ROWS):
                part = high[at : at + ROWS], low[at : at + ROWS]
                for k, (i, j) in enumerate(blocks):
                    m = Moments.of(part, i, j)
                    found[k] = found[k].join(m, i, j) if k in found else m
        yield _rows(found, TaskContext.get().partitionId() % FAN)

    def join(batches):
        blocks, found, salt = _blocks(dim), {}, 0
        for b in batches:
            for k, salt, n, sums, products in zip(*(c.to_pylist() for c in b.columns)):
                m = Moments(n, _unpack(sums), _unpack(products))
                key = (k, salt)
                found[key] = found[key].join(m, *blocks[k]) if key in found else m
        for (k, salt), m in found.items():
            yield _rows({k: m}, salt)

    parts = df.mapInArrow(run, _PART)
    parts = parts.repartition(common.spread(spark), "block", "salt").mapInArrow(join, _PART).withColumn("salt", F.lit(0))
    got = parts.repartition(common.spread(spark), "block").mapInArrow(join, _PART).collect()  # PAIRS pairs of dimensions in each row
    if not got:
        return 0, [], (np.zeros(dim), np.zeros(dim)), np.zeros((dim, dim))
    cov = np.zeros((dim, dim))
    for r in got:
        i, j = _blocks(dim)[r["block"]]
        cov[i, j] = cov[j, i] = over(_unpack(r["products"]), r["n"])[0]
    sums = _unpack(got[0]["sums"])
    whole = [int(h) + int(x) for h, x in zip(*sums)] if all(float(h).is_integer() and float(x).is_integer() for h, x in zip(*sums)) else None
    return got[0]["n"], whole, sums, cov


def components(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), largest first."""
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:most]
    return e[order], v[:, order]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exactly."""
    widest = max(int(np.abs(x).max(initial=0)), max((abs(s) for s in sums), default=0) // max(n, 1) + 1)
    if 2 * n * widest < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if len(sums) * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            return (d * d).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(_id, _v) of the rows whose vectors have finite entries only, all of the most frequent length; and that length."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    fine = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all numbers
    rows = rows.where((F.size("_v") > 0) & F.forall("_v", fine))
    best = rows.groupBy(F.size("_v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = best[0]["dim"] if best else 0
    return rows.where(F.size("_v") == dim), dim


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _grid(v: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * v), -float(1 << 61), float(1 << 61)).astype(np.int64) + offset


def _exact(x: np.ndarray) -> Pair:
    high = x.astype(float)
    return high, (x - high.astype(np.int64)).astype(float)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, most: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each valid row and component: entries become whole numbers
    floor(scale * c) + offset first, and whitened is their projection over the root of the component's variance."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows, dim = valid(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)
    n, sums, pair, cov = moments(rows.select("_v"), dim, lambda b: _exact(_grid(_matrix(b.column(0), dim), scale, offset)))
    e, w = components(cov, most)
    real = e > dim * np.finfo(float).eps * max(e.max(initial=0.0), 0.0)
    basis = w[:, real] / np.sqrt(e[real])
    mean = minus(over(pair, n))
    sent = spark.sparkContext.broadcast((sums, mean, basis))  # as many numbers as dim * most

    def project(x: np.ndarray) -> np.ndarray:
        _, mean, basis = sent.value
        return add(_exact(x), mean)[0] @ basis

    def projected(b) -> Pair:
        z = project(_grid(_matrix(b.column(0), dim), scale, offset))
        return z, np.zeros_like(z)

    k, error = int(real.sum()), None
    if k:
        error = float(np.abs(moments(rows.select("_v"), k, projected)[3] - np.eye(k)).max())
    spread = float(np.trace(cov))
    explained = [float(x) / spread if spread > 0 else None for x in e]

    def run(batches):
        for b in batches:
            x = _grid(_matrix(b.column(1), dim), scale, offset)
            m, c = len(x), len(explained)
            z = np.full((m, c), np.nan)
            z[:, real] = project(x)
            tile = lambda values, t: pa.array(list(values) * m, t)
            cols = [
                b.column(0).take(pa.array(np.repeat(np.arange(m), c))), tile(range(1, c + 1), pa.int32()), pa.array(np.full(m * c, n), pa.int64()),
                pa.array(deviations(x, n, sent.value[0]), pa.int64()).take(pa.array(np.repeat(np.arange(m), c))), pa.array(z.ravel(), pa.float64(), mask=np.tile(~real, m)),
                tile(explained, pa.float64()), pa.array([error] * (m * c), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid row of `embeddings` with each of its components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
