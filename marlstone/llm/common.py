"""What the operators of this subpackage share: working tables, batch limits and the tables they read."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import shared_dir


class Cache(dict):
    """learn(key) by key. At most `most` entries, those met again and the newest; keys longer than `longest` are learnt each time."""

    def __init__(self, learn, most: int, longest: int = 1 << 30):
        super().__init__()
        self.learn, self.half, self.longest, self.old = learn, most // 2, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.learn(key)
        self.put(key, got)
        return got

    def known(self, key):
        """The value if it is remembered, else None."""
        got = self.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, got) -> None:
        if len(key) > self.longest:
            return
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = got


def strings(values: pa.StringArray) -> list[str]:
    """The values as a list: Arrow makes them at once, to_pylist() one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


def in_turn(words: pa.ListArray, learn, end: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words what learn() gives for its words in turn, then `end`: (bytes of all lists, where each list's bytes end,
    the lists that hold a word without a value). learn(words) is asked once, for the different words, and gives their bytes or nulls, both as
    arrays."""
    flat = words.flatten().dictionary_encode()
    values = pa.concat_arrays([learn(flat.dictionary), pa.array([end], pa.large_binary())])
    stops = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    seq = np.insert(flat.indices.to_numpy(), stops, len(values) - 1)
    stops += np.arange(1, len(stops) + 1)
    got = values.take(pa.array(seq))
    ends = np.frombuffer(got.buffers()[1], np.int64)[: len(seq) + 1][stops]
    data = got.buffers()[2]
    bad = np.flatnonzero(got.is_null().to_numpy(zero_copy_only=False)) if got.null_count else np.zeros(0, np.int64)
    return np.frombuffer(data, np.uint8)[: ends[-1]] if data and len(ends) else np.zeros(0, np.uint8), ends, np.unique(np.searchsorted(stops, bad, side="right"))


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The stretches of data that end at `ends`, without a copy."""
    if len(data) > 0x7FFFFFFF:
        raise ValueError("the values of one Arrow batch exceed 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def workspace(spark: SparkSession) -> str:
    """A new folder for the working tables of one call. They belong to the returned DataFrame; drop them with forget()."""
    return f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df as a table at path and read it again: this cuts the lineage, and lost executors cost only their own tasks."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh(taken: list[str], *names: str) -> list[str]:
    """These names with underscores before them, as many as keep them apart from those taken, in any case of letters."""
    known, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in known or not name.startswith("_"):
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, text_col: str = "text"):
    """The text column as a string that is never null."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def spread(spark: SparkSession) -> int:
    """Partitions for exchanges that are not sized by their own data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
