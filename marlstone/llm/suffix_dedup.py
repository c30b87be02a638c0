"""Removal of repeated substrings: every byte that a string of LENGTH bytes covers which also starts anywhere else.

1. anchors   Each start p of a whole string of LENGTH bytes is owned by an anchor: the place of the smallest hash of GRAM bytes
             that begins at p .. p + SPAN - 1, the leftmost among equals. Equal strings have equal anchors at equal distances,
             and all of them hold the LENGTH - SPAN + 1 bytes from the anchor on: their hash is the anchor's key. Starts with
             one anchor are consecutive; the bytes of their strings are the anchor's context.
2. filter    Only anchors whose key occurs twice can own repeated strings. Equal contexts of one key repeat as a whole and need
             no bytes: they are counted before they move, and one of them stands for all.
3. sort      The different contexts of a key meet in one shard, a partition sized by its bytes. A shard is suffix-sorted by
             external induced sorting (see induced), after starts whose string's hash no other start of the shard has are left
             out, and the bytes that only they need: two owned starts next to each other in that order with a common prefix of
             LENGTH or more are repeats. A key whose contexts exceed HOT_BYTES is not collected: its strings are digested one by
             one (128 bits), counted before they move, and met again by a join that Spark can split.
4. cut       The starts found are merged to spans by document, and the texts lose them.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; matches never cross documents; repeated rows are
repeats of each other; an empty table gives an empty result. Rows are told apart by doc_id, or where that is null or not
unique by a hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, induced

LENGTH = 400
GRAM = 32
SPAN = 200
SHARD_BYTES = 5 << 19
HOT_BYTES = 5 << 19
MAX_SHARDS = 100_000
BROADCAST_ROWS = 400_000

_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of GRAM bytes (a power of two)."""
    h, width = b.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def anchors(raw: bytes, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, key) of each anchor of a text of `length` bytes or more."""
    h = _gram_hashes(np.frombuffer(raw, np.uint8))
    n = len(raw) - length + 1
    low = h[: n + span - 1] >> np.uint64(32) << np.uint64(32) | np.arange(n + span - 1, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:n], low[span - width : span - width + n])
    first = np.flatnonzero(np.diff(low, prepend=~low[:1]))
    last = np.append(first[1:] - 1, n - 1)
    at = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key, tail = np.zeros(len(at), np.uint64), length - span + 1
    for k in [*range(0, tail - GRAM, GRAM), tail - GRAM]:
        key = (key ^ h[at + k]) * np.uint64(_BASE)
        key ^= key >> np.uint64(32)
    return first, last, key.view(np.int64)


def find_anchors(rows: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(rid, lo, hi, key, ctx): the starts each anchor of (rid, text) owns, its key and the digest of its context."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rid, lo, hi, key, ctx = [], [], [], [], []
            for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                first, last, keys = anchors(raw, length, span)
                view = memoryview(raw)
                ctx.append(np.array([digest(view[i : j + length]) for i, j in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64))
                rid.append(np.full(len(first), r, np.int64))
                lo.append(first)
                hi.append(last)
                key.append(keys)
            if rid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid)), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32)), pa.array(np.concatenate(key)), pa.array(np.concatenate(ctx))], ["rid", "lo", "hi", "key", "ctx"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, lo int, hi int, key long, ctx long")


def _string_hashes(t: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the `length` bytes from each place on."""
    total = np.full(len(t) + 1, _BASE, np.uint64)
    total[0] = 1
    np.multiply.accumulate(total, out=total)
    total[1:] = np.cumsum(t * total[:-1])
    total[0] = 0
    out = total[at + length] - total[at]
    total[:] = pow(_BASE, -1, 1 << 64)
    total[0] = 1
    np.multiply.accumulate(total, out=total)
    return out * total[at]


def _may_repeat(contexts: list[bytes], owned: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its first `owned` starts begin a string whose hash another owned start has. Equal strings have equal
    hashes, so this loses no repeat; unequal ones with equal hashes are told apart by the sort."""
    starts = np.cumsum([0, *map(len, contexts)])[:-1]
    n = np.array(owned)
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    h = _string_hashes(np.frombuffer(b"".join(contexts), np.uint8), at, length)
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [np.flatnonzero(x) for x in np.split(twice, first[1:])]


def repeats_in_shard(contexts: list[bytes], owned: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first `owned` starts begin a string of `length` bytes that another owned start begins.
    The bytes of starts that may repeat are sorted, no others."""
    may = _may_repeat(contexts, owned, length) if contexts else []
    out = [np.zeros(0, np.int64) for _ in contexts]
    live = [i for i, x in enumerate(may) if len(x)]
    if live:
        found = _sorted_repeats([contexts[i][may[i][0] : may[i][-1] + length] for i in live], [may[i] - may[i][0] for i in live], length)
        for i, x in zip(live, found):
            out[i] = x + may[i][0]
    return out


def _sorted_repeats(contexts: list[bytes], owned: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each context, which of its starts `owned` (ascending) begin a string of `length` bytes that another of them begins."""
    # no byte of UTF-8 is 0xFE, so a zero byte can move there and zero ends each context
    t = np.frombuffer(b"".join(c.replace(b"\0", b"\xfe") + b"\0" for c in contexts), np.uint8)
    starts = np.cumsum([0, *(len(c) + 1 for c in contexts)])
    mine = np.zeros(len(t), bool)
    mine[np.concatenate([s + x for s, x in zip(starts.tolist(), owned)])] = True
    order, lcp = induced.suffix_array(t, length)
    at = np.flatnonzero(mine[order])
    hit = np.zeros(len(t), bool)
    if len(at) > 1:
        near = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) >= length
        pos = order[at]
        hit[pos[:-1][near]] = True
        hit[pos[1:][near]] = True
    return [np.flatnonzero(hit[s:e]) for s, e in zip(starts.tolist(), starts[1:].tolist())]


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as ranges (from, to), both ends included."""
    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[new], at[np.append(new[1:] - 1, len(at) - 1)]


def _sort_shards(pieces: DataFrame, length: int) -> DataFrame:
    """(rid, lo, hi) of repeated starts, from a shard's (rid, lo, n, once, bytes) in each partition."""

    def run(batches):
        rid, lo, n, once, data = [], [], [], [], []
        for b in batches:
            for col, to in zip(b.columns, (rid, lo, n, once, data)):
                to.extend(col.to_pylist())
        out: list[list] = [[], [], []]
        if len(data) > 1:
            for r, base, single, at in zip(rid, lo, once, repeats_in_shard(data, n, length)):
                if single and len(at):
                    a, z = _ranges(at)
                    out[0].extend([r] * len(a))
                    out[1].extend((a + base).tolist())
                    out[2].extend((z + base).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["rid", "lo", "hi"])

    return pieces.mapInArrow(run, "rid long, lo int, hi int")


_PICKED = "rid long, lo int, n int, key long, once boolean, hot boolean, bytes binary"


def _pick(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted contexts (rid, lo, hi, key, once, hot) from one exchange of the texts: a row with the bytes of each, or of a hot one a
    row per start with a digest of its string."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "key", "once", "hot")).alias("want"))  # a document's own anchors
    both = rows.join(per.hint("merge"), "rid").select("rid", "text", "want")  # per follows the corpus: never broadcast
    names = [f.split()[0] for f in _PICKED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches):
        import xxhash

        for b in batches:
            for r, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, out = text.encode("utf-8", "surrogatepass"), []
                for w in want:
                    lo, hi = w["lo"], w["hi"]
                    if w["hot"]:
                        out.extend((r, p, 1, w["key"], w["once"], True, xxhash.xxh3_128_digest(raw[p : p + length])) for p in range(lo, hi + 1))
                    else:
                        out.append((r, lo, hi - lo + 1, w["key"], w["once"], False, raw[lo : hi + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return both.mapInArrow(run, _PICKED)


def repeated_starts(rows: DataFrame, work: str, length: int = LENGTH, span: int = SPAN, hot_bytes: int = HOT_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(rid, lo, hi): ranges of starts of repeated strings, over (rid, text)."""
    spark = rows.sparkSession
    found = common.saved(find_anchors(rows, length, span), f"{work}/anchors")
    # joins by merge at every size: what they join follows the corpus, so a broadcast of it would hold on small inputs only
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = common.saved(found.join(twice.hint("merge"), "key"), f"{work}/again")
    common.forget(spark, f"{work}/anchors")
    kinds = again.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("one"))
    kinds = common.saved(kinds.select("key", "ctx", "n", "one.*"), f"{work}/kinds")
    whole = common.saved(again.join(kinds.where("n > 1").select("key", "ctx").hint("merge"), ["key", "ctx"]).select("rid", "lo", "hi"), f"{work}/whole")
    common.forget(spark, f"{work}/again")
    size = F.col("hi") - F.col("lo") + length
    several = common.saved(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(size).alias("size"), F.min("n").alias("least")).where("k > 1 and least = 1").select("key", (F.col("size") > hot_bytes).alias("hot"), "size"), f"{work}/several")
    wanted = common.saved(kinds.join(several.select("key", "hot").hint("merge"), "key").select("rid", "lo", "hi", "key", (F.col("n") == 1).alias("once"), "hot"), f"{work}/wanted")
    common.forget(spark, f"{work}/kinds")
    total, hot = several.agg(F.sum(F.when(~F.col("hot"), F.col("size"))), F.count_if("hot")).collect()[0]
    n_shards = int(min(MAX_SHARDS, max(common.spread(spark), -(-(total or 0) // shard_bytes))))
    picked = common.saved(_pick(rows, wanted, length), f"{work}/picked")
    pieces = picked.where("not hot").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))
    sorted_ = _sort_shards(pieces.repartitionById(n_shards, F.col("shard")).select("rid", "lo", "n", "once", "bytes"), length)
    out = whole.unionByName(common.saved(sorted_, f"{work}/sorted"))
    if hot:
        one = picked.where("hot")
        met = one.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bytes")
        out = out.unionByName(common.saved(one.join(met.hint("merge"), "bytes").select("rid", "lo", F.col("lo").alias("hi")), f"{work}/digests"))
    common.forget(spark, f"{work}/picked")
    for done in ("several", "wanted"):
        common.forget(spark, f"{work}/{done}")
    return out


def dedup(docs: DataFrame, length: int = LENGTH, span: int = SPAN, hot_bytes: int = HOT_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans, kept): the removed spans of bytes [from, to) and what is left, as bytes. length: induced.LONGEST at most."""
    if not span < length <= induced.LONGEST:
        raise ValueError(f"length must be above {span} and at most {induced.LONGEST}")
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.workspace(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    unclear = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    rows = plain.withColumn("rid", F.xxhash64("doc_id", "text") if unclear else F.col("doc_id"))
    starts = repeated_starts(rows, work, length, span, hot_bytes, shard_bytes)
    spot = F.array_sort(F.collect_set(F.struct("lo", "hi")))  # a document's own ranges
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def join(done, x):  # starts a and b <= a + length cover one span
        last = F.try_element_at(done, F.lit(-1))
        touch = (F.size(done) > 0) & (x["lo"] <= last["hi"] + length)
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when(touch, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    spans = common.saved(starts.groupBy("rid").agg(spot.alias("r")).select("rid", F.aggregate("r", empty, join).alias("spans")), f"{work}/spans")
    for done in ("whole", "sorted", "digests"):
        common.forget(spark, f"{work}/{done}")
    size = spans.agg(F.sum(F.size("spans") + 2)).collect()[0][0] or 0
    spans = F.broadcast(spans) if size <= BROADCAST_ROWS else spans
    both = rows.join(spans, "rid", "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out: list[list] = [[], []]
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                cut = [[s["lo"], s["hi"] + length] for s in found or ()]
                ends = [0, *(x for s in cut for x in s), len(raw)]
                out[0].append(cut)
                out[1].append(b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.list_(pa.list_(pa.int64()))), pa.array(out[1], pa.binary())], ["doc_id", "text", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, text string, spans array<array<bigint>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` without its repeated strings of 400 bytes; text is what is left, where a cut went through a
    character with U+FFFD in its place."""
    found = dedup(common.table(spark, sf_dir, "documents"))
    n = F.octet_length("text").cast("long")
    removed = n - F.octet_length("kept")
    return found.select("doc_id", n.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.when(removed == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string"))).alias("text"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
