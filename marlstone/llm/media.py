"""Texts as pictures in content-addressed tar shards.

A payload is a text's bytes, filled up with 255 to a positive multiple of 576, and is stored as a grey picture of 8 bits a sample: a
PNG of 576 columns without filters. Its name is the SHA-256 of the stored form. store() first counts 64-bit hashes of the texts; what
occurs once is encoded and written where it is read, in tar shards of about SHARD_BYTES, and only what may occur twice (a bitmap of
SPOTS places, which errs to that side) is dealt by digest, without repeats within a task, so that each digest is written once. The
index beside the shards says where a digest lies (shard, offset, length), and rows carry that. headers() fills metadata columns by
range reads of the first HEADER bytes of each picture; features() reads whole pictures and works out what they hold.

Shards are written and read by the tasks through pyarrow.fs, so the folder must be of a kind that it knows (file, hdfs, s3, gs) and
that all executors see; a task writes a shard under a name of its own, and only those that the index names count, so a task that
is lost or runs twice leaves a file nobody reads. Texts that occur once never move; memory is one batch of texts, or one
picture.

Defined results: null text is empty, and an empty text has one row of 255; equal texts have one picture, also in rows that repeat;
null ids stay; an empty table gives an empty result. Columns of the input stay in store(), but for those it adds.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH = 576
HEADER = 33  # a PNG's signature and its first chunk, which has the size
SHARD_BYTES = 64 << 20
PIECE = 16 << 20
LEVEL = 6
REMEMBERED = 100_000  # digests of a task's own pictures that it does not send again
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SPOTS = 1 << 26  # places of the bitmap of repeated texts
_PLACE = "text_digest binary, digest binary, shard string, media_offset long, media_length long"


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A grey PNG of WIDTH columns that holds these bytes as samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    packed = zlib.compress(lines.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", packed[i : i + PIECE]) for i in range(0, len(packed), PIECE)]
    return b"".join([_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def header(first: bytes) -> dict:
    """width, height, bits and channels from the first HEADER bytes of a picture."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or struct.unpack(">I", first[29:33])[0] != zlib.crc32(first[12:29]):
        raise ValueError("no PNG header")
    width, height, bits, color = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "bits": bits, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[color]}


def decode(media: bytes) -> bytes:
    """The samples of a picture that encode() made."""
    size, parts, at = header(media[:HEADER]), [], 8
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk of the picture is damaged")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size["height"], size["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """The mean sample, and a hash of 64 bits: which of 8 x 8 fields of the picture are lighter than all of it."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    whole, ys = int(x.sum(dtype=np.int64)), np.linspace(0, len(x), 9).astype(int)
    columns = np.stack([x[a : max(b, a + 1)].sum(0, dtype=np.int64) for a, b in zip(ys.clip(max=len(x) - 1), ys[1:])])
    heights = np.maximum(np.diff(ys), 1)[:, None]
    fields = columns.reshape(8, 8, WIDTH // 8).sum(2)
    bits = fields * x.size > whole * heights * (WIDTH // 8)
    return f"{whole / x.size:.3f}:{np.packbits(bits).tobytes().hex()}"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


class _Shards:
    """Tar shards in a folder: put() says where a member's bytes lie."""

    def __init__(self, folder: str):
        self.files, self.folder = _files(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name, self.out, self.at = "", None, 0

    def put(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        place = self.name, self.at + len(head), len(media)
        self.at += len(head) + len(media) + -len(media) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def repeated(docs: DataFrame, spot) -> bytes:
    """A bit for each of SPOTS places: whether it may hold a text that occurs twice. 8 bytes a row are counted; the bits are put together
    by the tasks, SPOTS / 8 bytes in all."""
    twice = docs.groupBy(spot.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select((F.pmod("_h", F.lit(SPOTS)) + 1).alias("_at"))  # buckets begin with 1
    rows = twice.groupBy(F.bitmap_bucket_number("_at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"))
    bits = bytearray(SPOTS // 8)
    for r in rows.toLocalIterator():
        at = (r["b"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits)


def store(docs: DataFrame, folder: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with n_bytes and text_digest; the index: text_digest, digest, shard, media_offset, media_length). One index row for each
    different text; text_digest is the SHA-256 of the text itself, digest that of its picture."""
    spark = docs.sparkSession
    common.small_batches(spark)
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "text_digest")]
    text = common.text_of(docs, text_col).cast("binary")
    key = F.unhex(F.sha2(text, 256))
    rows = docs.select(*names, F.octet_length(text).cast("long").alias("n_bytes"), key.alias("text_digest"))
    sent = spark.sparkContext.broadcast(repeated(docs, F.xxhash64(text)))
    spots = docs.select(key.alias("text_digest"), text.alias("raw"), F.pmod(F.xxhash64(text), F.lit(SPOTS)).alias("spot"))

    def chosen(batch, twice: bool):
        for key, raw, spot in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            if (sent.value[spot >> 3] >> (spot & 7) & 1) == twice:
                yield key.as_py(), raw

    def placed(shards: _Shards, pairs) -> pa.RecordBatch:
        out = [(key, d := hashlib.sha256(media).digest(), *shards.put(d.hex(), media)) for key, media in pairs]
        kinds = (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["text_digest", "digest", "shard", "media_offset", "media_length"])

    def write_once(batches):
        shards = _Shards(folder)
        for b in batches:
            yield placed(shards, ((key, encode(payload_of(raw.as_py()))) for key, raw in chosen(b, False)))
        shards.close()

    def draw(batches):
        seen: set[bytes] = set()
        for b in batches:
            out = []
            for key, raw in chosen(b, True):
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    out.append((key, encode(payload_of(raw.as_py()))))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([m for _, m in out], pa.binary())], ["text_digest", "media"])

    def write_first(batches):
        shards, seen = _Shards(folder), set()
        for b in batches:
            new = {key: media.as_py() for key, media in zip(b.column(0).to_pylist(), b.column(1)) if key not in seen}
            seen.update(new)
            yield placed(shards, new.items())
        shards.close()

    several = spots.mapInArrow(draw, "text_digest binary, media binary").repartition("text_digest").mapInArrow(write_first, _PLACE)
    return rows, common.saved(spots.mapInArrow(write_once, _PLACE).unionByName(several), f"{folder}/index")


def by_place(places: DataFrame) -> DataFrame:
    """places (…, shard, media_offset, media_length) dealt by stretches of shards, in their order."""
    return places.repartition(F.col("shard"), F.floor(F.col("media_offset") / F.lit(PIECE))).sortWithinPartitions("shard", "media_offset")


def _read(places: DataFrame, folder: str, length: int | None, made: dict[str, T.DataType], work) -> DataFrame:
    """places with what work(the first `length` bytes, or all) gives."""
    at = {c: i for i, c in enumerate(places.columns)}
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}

    def run(batches):
        files, base = _files(folder)
        name, source = None, None
        for b in batches:
            out = []
            for shard, offset, size in zip(*(b.column(at[c]).to_pylist() for c in ("shard", "media_offset", "media_length"))):
                if shard != name:
                    name, source = shard, files.open_input_file(f"{base}/{shard}")
                want = min(size, length) if length else size
                got = source.read_at(want, offset)
                if len(got) != want:
                    raise OSError(f"{shard} ends before {offset + want}")
                out.append(work(got))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[c] for x in out], kinds[t]) for c, t in made.items())], [*b.schema.names, *made])

    return places.mapInArrow(run, T.StructType([*places.schema.fields, *(T.StructField(c, t) for c, t in made.items())]))


def headers(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height, bits and channels, from a range read of each picture's first bytes."""
    return _read(places, folder, HEADER, dict.fromkeys(("width", "height", "bits", "channels"), T.IntegerType()), header)


def features(places: DataFrame, folder: str) -> DataFrame:
    """places with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the pictures read back; digests in binary."""

    def work(media: bytes) -> dict:
        payload = decode(media)
        return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).digest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).digest(), "feature": feature(payload)}

    made = dict.fromkeys(("payload_bytes", "tail_crc32", "media_bytes"), T.LongType()) | dict.fromkeys(("payload_sha256", "media_sha256"), T.BinaryType())
    return _read(places, folder, None, made | {"feature": T.StringType()}, work)


def unpack(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, media) of whole shards, for readers without the index."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    got = [(m.name.removesuffix(".png"), tar.extractfile(m).read()) for m in tar]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.string()), pa.array([m for _, m in got], pa.binary())], ["digest", "media"])

    return whole.select("content").mapInArrow(run, "digest string, media binary")


def op13_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its picture's place, header and features."""
    folder = f"{common.workspace(spark)}/media"
    docs, index = store(common.table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    known = features(headers(by_place(index), folder), folder)
    out = docs.select("doc_id", "n_bytes", "text_digest").join(known, "text_digest")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_bytes", "payload_bytes", text("payload_sha256"), "tail_crc32", "media_bytes", text("media_sha256"), "feature", text("digest"), "shard", "media_offset", "media_length", "width", "height", "bits", "channels")


QUERIES = {"op13_media": op13_media}
SQL: dict[str, str] = {}
