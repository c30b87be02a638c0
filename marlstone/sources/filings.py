"""Filings of a landing folder as a data source: spark.read.format("landed_filings") and spark.readStream.

A filing is a file named ticker_accession.html in a folder that pyarrow.fs can open (file, hdfs, s3, gs) and that all executors see.
The files are dealt to tasks by their bytes. Each is fetched with retries: what may pass (RETRYABLE, or no answer) is tried again
after a wait drawn from all of 0 to the limit, which doubles (full jitter); any other failure is an error at once. With the option
`inject`, a file named like the filing with .faults after it holds the statuses of its first answers, one word each.

Options: path; retries (4); wait (seconds of the first limit, 0.5); partition_bytes (32 MB); inject (false).

As a stream, the offset is the latest time of change and the names that have it, so what lands later is read once, also after a
restart, and files of one instant are told apart. A file must not change, nor land with an older time, once it is there.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Answers that may pass, and the longest wait in seconds.
RETRYABLE = {429, 500, 502, 503, 504}
LONGEST_WAIT = 8.0
SCHEMA = "ticker string, accession string, attempts int, html string"


class FilingError(RuntimeError):
    pass


def fetch(get: Callable[[int], tuple[int, bytes]], name: str, retries: int = 4, wait: float = 0.5, sleep=time.sleep, draw=random.uniform) -> tuple[int, bytes]:
    """(attempts, content) of get(attempt) -> (status, content), which is 0 for no answer."""
    for attempt in range(retries + 1):
        status, content = get(attempt)
        if 200 <= status < 400:
            return attempt + 1, content
        if status and status not in RETRYABLE:
            raise FilingError(f"{name}: status {status}")
        if attempt < retries:
            sleep(draw(0, min(LONGEST_WAIT, wait * 2**attempt)))
    raise FilingError(f"{name}: status {status} after {retries + 1} attempts")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Files(InputPartition):
    names: list[str]


class _Landed:
    """What reading at once and as a stream share."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.retries, self.wait = int(options.get("retries", 4)), float(options.get("wait", 0.5))
        self.most, self.inject = int(options.get("partition_bytes", 32 << 20)), options.get("inject", "false").lower() == "true"

    def files(self) -> list[tuple[int, str, int]]:
        """(time of change, name, bytes) of all filings."""
        from pyarrow import fs

        system, base = _open(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted((f.mtime_ns, f.base_name, f.size) for f in found if f.base_name.endswith(".html") and not f.base_name.startswith((".", "_")))

    def deal(self, files) -> list[Files]:
        out, room = [], 0
        for _, name, size in files:
            if room < size or not out:
                out.append(Files([]))
                room = self.most
            out[-1].names.append(name)
            room -= size
        return out

    def read(self, partition: Files):
        system, base = _open(self.path)
        for name in partition.names:
            faults = []
            if self.inject and system.get_file_info(f"{base}/{name}.faults").is_file:
                faults = [int(x) for x in system.open_input_file(f"{base}/{name}.faults").read().split()]

            def get(attempt: int, name=name, faults=faults):
                if attempt < len(faults):
                    return faults[attempt], b""
                try:
                    with system.open_input_file(f"{base}/{name}") as f:
                        return 200, f.read()
                except FileNotFoundError:
                    return 404, b""
                except OSError:
                    return 0, b""

            attempts, content = fetch(get, name, self.retries, self.wait)
            ticker, _, accession = name.removesuffix(".html").partition("_")
            yield ticker, accession, attempts, content.decode("utf-8", "replace")


class _Batch(_Landed, DataSourceReader):
    def partitions(self):
        return self.deal(self.files()) or [Files([])]


class _Stream(_Landed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": "0", "names": []}

    def latestOffset(self) -> dict:
        files = self.files()
        last = files[-1][0] if files else 0
        return {"at": str(last), "names": [name for at, name, _ in files if at == last]}  # as text: JSON numbers may lose digits

    def partitions(self, start: dict, end: dict):
        after = lambda at, name, offset: at > int(offset["at"]) or (at == int(offset["at"]) and name not in offset["names"])
        return self.deal([f for f in self.files() if after(f[0], f[1], start) and not after(f[0], f[1], end)])


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Filings)


def land(filings: DataFrame, path: str) -> None:
    """Write filings (ticker, accession, html[, faults: array of statuses]) into a landing folder, a file each, by the tasks; a file appears
    whole, under its name."""
    system, base = _open(path)
    system.create_dir(base, recursive=True)
    rows = filings.select("ticker", "accession", F.coalesce("html", F.lit("")).alias("html"), (F.array_join("faults", " ") if "faults" in filings.columns else F.lit("")).alias("faults"))

    def write(batches):
        system, base = _open(path)
        n = 0
        for b in batches:
            for ticker, accession, html, faults in zip(*(c.to_pylist() for c in b.columns)):
                name = f"{ticker}_{accession}.html"
                for file, content in ((f"{name}.faults", faults), (name, html)):
                    if content or file == name:
                        with system.open_output_stream(f"{base}/.{file}.new") as f:
                            f.write(content.encode())
                        system.move(f"{base}/.{file}.new", f"{base}/{file}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
