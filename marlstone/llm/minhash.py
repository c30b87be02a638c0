"""Near-duplicate groups: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

A-Z are lower-cased, words are runs of `[^\\x20\\x09-\\x0D]`, and a document's set holds its distinct shingles of `shingle` words
(fewer words, but not none: the whole sequence is one). Documents with equal sets form a class, known by a digest of the set;
classes are what is compared. Two are linked if 100 * |intersection| >= percent * |union|.

1. sketch   One pass over the texts: size and digest of the set, ROWS * BANDS minimum hashes, a bucket per band.
2. stars    A bucket's centre is the class that meets most others over all of its buckets. A class is compared with the one among
            its buckets' centres that meets most: one pair per class.
3. verify   Candidates are compared signature batch by batch; one is dropped once the posterior probability (uniform prior)
            of a similarity at the threshold falls below MISS. Survivors are decided exactly, on their full sets.
4. rest     Links are contracted to components. In buckets that still hold several, classes outside a bucket's main component
            are compared with those inside and with each other, block by block (a bucket of more than BLOCK classes is dealt to
            several tasks); only pairs that are not dropped leave the task, and are decided exactly: at first each class's BEST
            likeliest ones, and once those are contracted, all that are left, each from the first bucket it meets in. Pairs
            inside one component need no comparison: they cannot change it.

A pair at the threshold of 0.8 shares no bucket with probability 3e-6, and is dropped in step 3 with probability MISS at most.

Defined results: null or wordless texts have the empty set, link with nothing and are kept; so are rows with a null id
(component_id null). Repeated rows are equal texts; rows that repeat an id are kept or dropped together. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
PERCENT = 80
ROWS = 5
BANDS = 32
BATCH = 32
MISS = 1e-7
SEED = 20240607
VOCABULARY = 250_000
SEEN = 100_000
BROADCAST_IDS = 1_000_000
BLOCK = 1000
BEST = 2
WIDE = 1024
MISS_WIDE = 1e-5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WIDE = np.random.default_rng(SEED + 2).integers(0, 1 << 31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes() -> common.Cache:
    """Hashes of words by word, as far as a task remembers them."""
    import xxhash

    return common.Cache(xxhash.xxh3_64_intdigest, VOCABULARY, 64)


def shingle_set(text: str | None, shingle: int, hashes: common.Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - shingle + 1)
    k = min(shingle, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out ^= h[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each of the ROWS * BANDS hash functions over a set that is not empty."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = None
    for i in range(0, len(x), 1024):
        part = np.multiply.outer(_MULTIPLIERS, x[i : i + 1024]).min(1)
        low = part if low is None else np.minimum(low, part)
    return low


def wide_signature(s: np.ndarray) -> np.ndarray:
    """One byte of each of the minima of WIDE more hash functions."""
    x = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = None
    for i in range(0, len(x), 256):
        part = np.multiply.outer(_WIDE, x[i : i + 256]).min(1)
        low = part if low is None else np.minimum(low, part)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def buckets(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    h = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ h[:, i]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_SKETCH = "doc_id long, n_shingles long, key binary, sig binary, buckets array<bigint>"


def sketch(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document. Of the classes that a task has met before, only the digest is repeated."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        seen: set[bytes] = set()
        hashes = _word_hashes()
        for b in batches:
            n, keys, sigs, bs = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, shingle, hashes)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                keys.append(key)
                if key is None or key in seen:
                    sigs.append(None)
                    bs.append(None)
                else:
                    seen.add(key)
                    sig = signature(s)
                    sigs.append(sig.tobytes())
                    bs.append(buckets(sig).tolist())
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "sig", "buckets"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SKETCH)


def least_matches(n: int, percent: float = PERCENT, miss: float = MISS) -> int:
    """Fewest matches among n hashes with which P(similarity >= percent / 100 | matches) is `miss` or more. With a uniform prior
    that posterior is P(Binomial(n + 1, percent / 100) <= matches)."""
    t, tail = percent / 100, 0.0
    if t >= 1:
        return n
    for m in range(n + 1):
        tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log1p(-t))
        if tail >= miss:
            return m
    return n


def _steps(percent: int, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent, miss)) for n in range(BATCH, ROWS * BANDS + 1, BATCH)]


def _wide_steps(percent: int) -> list[tuple[int, int]]:
    """As _steps, for bytes: those of different minima agree once in 256 times."""
    return [(n, least_matches(n, percent + (100 - percent) / 256, MISS_WIDE)) for n in range(BATCH * 8, WIDE + 1, BATCH * 8)]


def _survivors(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]], best: int | None = None) -> np.ndarray:
    """Rows of two arrays of signatures (one may have a single row) that sequential comparison doesn't drop; with best, only that
    many of them, those with most matches."""
    live, matches, done = np.arange(max(len(a), len(b))), np.zeros(max(len(a), len(b)), np.int64), 0
    for n, least in steps:
        x, y = (s[:, done:n] if len(s) == 1 else s[live, done:n] for s in (a, b))
        done = n
        matches[live] += (x == y).sum(1)
        live = live[matches[live] >= least]
        if not len(live):
            break
    return live if best is None or len(live) <= best else live[np.argpartition(-matches[live], best)[:best]]


def _signatures(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint32).reshape(-1, ROWS * BANDS)


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v, sig_u, sig_v) those that sequential comparison doesn't drop."""
    steps = _steps(percent, MISS)

    def run(batches):
        for b in batches:
            live = pa.array(_survivors(*(_signatures(b.column(i).to_pylist()) for i in (2, 3)), steps))
            yield pa.RecordBatch.from_arrays([b.column(0).take(live), b.column(1).take(live)], ["u", "v"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u binary, v binary")


def _across(open_: DataFrame, percent: int, best: int | None = None, keys: bool = False) -> DataFrame:
    """Pairs (u, v) of different components that share a bucket and aren't dropped, from (bucket, band, key, comp, n, sig, main,
    odd, most[, wide]): whether a class is in its bucket's main component, which holds `most` classes there, `odd` all others. Only
    the others are compared: with the main component's blocks and with each other's, two blocks to a group. With best, so many
    pairs of each class and group; without, each pair that is left comes once, from the first bucket that its classes share.
    With keys only the classes that are in such pairs, (key)."""
    steps, wide = _steps(percent, MISS), "wide" in open_.columns
    more = _wide_steps(percent) if wide else []
    odd_blocks, main_blocks = (F.greatest(F.lit(1), F.ceil(F.col(x) / BLOCK)).cast("int") for x in ("odd", "most"))
    own = F.when(F.col("main"), F.pmod(F.xxhash64("key"), main_blocks)).otherwise(F.pmod(F.xxhash64("key"), odd_blocks)).cast("int")
    at = lambda a, b, met: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(met).alias("met"))
    to_odd = F.transform(F.sequence(F.lit(0), odd_blocks - 1), lambda o: at(o, F.col("own"), True))
    to_all = F.concat(
        F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda m: at(F.col("own"), m, True)),
        F.transform(F.sequence(F.lit(0), odd_blocks - 1), lambda o: at(F.least(o, F.col("own")), F.greatest(o, F.col("own")), False)),
    )
    dealt = open_.withColumn("own", own).withColumn("to", F.explode(F.when(F.col("main"), to_odd).otherwise(to_all))).select("bucket", "to.*", "band", "main", "own", "key", "comp", "n", "sig", *["wide"] * wide)

    def compare(group: tuple, rows: list) -> list:
        a, b, met, band = group[1:]
        main, own, names, comps, n, sig = ([r[i] for r in rows] for i in range(6))
        main, own, n, sig, comp = np.array(main), np.array(own), np.array(n), _signatures(sig), np.unique(np.array(comps, object), return_inverse=True)[1]
        bytes_ = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, WIDE) if wide else None
        found = set()
        left = np.flatnonzero(~main) if met else np.flatnonzero(own == a)
        right = main if met else own == b
        for i in left:
            ok = right & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if not met and a == b:
                ok &= np.arange(len(n)) > i
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            at = at[_survivors(sig[i : i + 1], sig[at], steps, best)]
            if wide and len(at):
                at = at[_survivors(bytes_[i : i + 1], bytes_[at], more)]
            if keys:
                found.update((names[i], *(names[j] for j in at)) if len(at) else ())
                continue
            if best is None and band:  # a pair that meets in an earlier band is left to that
                before = ROWS * band
                at = at[~(sig[at, :before] == sig[i, :before]).reshape(len(at), band, ROWS).all(2).any(1)]
            found.update((min(names[i], names[j]), max(names[i], names[j])) for j in at)
        return sorted(found)

    names = ["key"] if keys else ["u", "v"]

    def run(batches):
        group, rows = None, []

        def flush(rows):
            new = compare(group, rows) if len({r[3] for r in rows}) > 1 else []
            cols = [new] if keys else [*zip(*new)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names) if new else None

        for batch in batches:
            for bucket, a, b, met, band, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, a, b, met, band) != group:
                    if rows and (out := flush(rows)):
                        yield out
                    group, rows = (bucket, a, b, met, band), []
                rows.append(row)
        if rows and (out := flush(rows)):
            yield out

    to = ("bucket", "a", "b", "met", "band")
    return dealt.repartition(*to).sortWithinPartitions(*to).mapInArrow(run, ", ".join(f"{x} binary" for x in names))


def _wide(sets: DataFrame) -> DataFrame:
    """(key, wide) from (key, set)."""

    def run(batches):
        for b in batches:
            got = [wide_signature(np.frombuffer(x, np.uint64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["key", "wide"])

    return sets.select("key", "set").mapInArrow(run, "key binary, wide binary")


class _Verifier:
    """Compares pairs of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, work: str, shingle: int, percent: int, id_col: str, text_col: str):
        self.docs, self.classes, self.work, self.shingle, self.percent = docs, classes, work, shingle, percent
        self.id_col, self.text_col, self.calls = id_col, text_col, 0

    def sets(self, keys: DataFrame) -> DataFrame:
        """(key, set) of these classes, from the text of one document of each."""
        spark = self.docs.sparkSession
        common.small_batches(spark)
        shingle = self.shingle
        few = keys.count() <= BROADCAST_IDS
        keys = F.broadcast(keys) if few else keys
        ids = self.classes.join(keys, "key", "left_semi").select(F.col("rep").alias("_id"))
        ids = F.broadcast(ids) if few else ids
        texts = self.docs.select(F.col(self.id_col).cast("long").alias("_id"), F.col(self.text_col).cast("string").alias("_text")).join(ids, "_id", "left_semi")

        def run(batches):
            import xxhash

            hashes = _word_hashes()
            for b in batches:
                sets = [shingle_set(t, shingle, hashes).tobytes() for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

        got = texts.select("_text").mapInArrow(run, "key binary, set binary").join(keys, "key", "left_semi")
        return got.dropDuplicates(["key"])

    def __call__(self, pairs: DataFrame, compared: bool = False, sets: DataFrame | None = None) -> DataFrame:
        """Of distinct pairs (u, v) of keys those that are linked, as a table; compared: by signature already; sets: if known."""
        self.calls += 1
        at, percent = f"{self.work}/verify{self.calls}", self.percent
        if compared:
            likely = common.saved(pairs, f"{at}/likely")
        else:
            side = lambda x: self.classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
            both = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
            likely = common.saved(_likely(both, percent), f"{at}/likely")
        if sets is None:
            keys = common.saved(likely.select(F.col("u").alias("key")).unionByName(likely.select(F.col("v").alias("key"))).distinct(), f"{at}/keys")
            sets = common.saved(self.sets(keys), f"{at}/sets")
        whole = likely.join(sets.select(F.col("key").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("key").alias("v"), F.col("set").alias("set_v")), "v")

        def run(batches):
            for b in batches:
                keep = []
                for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common_ = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common_ >= percent * (len(x) + len(y) - common_):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])

        out = common.saved(whole.select("u", "v", "set_u", "set_v").mapInArrow(run, "u binary, v binary"), f"{at}/linked")
        for done in ("likely", "keys", "sets"):
            common.forget(self.docs.sparkSession, f"{at}/{done}")
        return out


def components(edges: DataFrame, work: str) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): root is the smallest node reachable. Large and small stars in turn, each round
    written as a table, until nothing changes; a hub's edges are summed before they move and joined by joins Spark can split."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before, turn = None, 0
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = common.saved(small, f"{work}/stars{turn}")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if turn:
            common.forget(spark, f"{work}/stars{turn - 1}")
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, turn = now, turn + 1


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", work: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs. The result reads two tables in the folder work; once it is no
    longer needed, forget() deletes them."""
    spark = docs.sparkSession
    work = work or common.workspace(spark)
    rows = common.saved(sketch(docs, shingle, id_col, text_col), f"{work}/sketch")
    known = rows.where(F.col("key").isNotNull())
    # a class's signature comes from any row that has it; the smallest id stands for the class
    classes = common.saved(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig", ignorenulls=True).alias("sig"), F.first("buckets", ignorenulls=True).alias("buckets")).where(F.col("rep").isNotNull()), f"{work}/classes")
    member = classes.select("key", F.posexplode("buckets").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = common.saved(member.join(shared, "bucket").select("bucket", "band", "key", "m"), f"{work}/members")
    meets = members.groupBy("key").agg(F.sum("m").alias("meets"))
    centre = members.join(meets, "key").groupBy("bucket").agg(F.max(F.struct("meets", "key")).alias("c"))
    # of all centres that a class meets, the one that meets most: a pair per class at most
    star = members.join(centre, "bucket").where(F.col("key") != F.col("c.key")).groupBy("key").agg(F.max("c")["key"].alias("centre"))
    star = star.select(F.least("key", "centre").alias("u"), F.greatest("key", "centre").alias("v")).distinct()
    verify = _Verifier(docs, classes, work, shingle, percent, id_col, text_col)
    links = verify(star)
    roots = components(links, f"{work}/first")

    def open_classes():
        now = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("comp"))
        parts = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
        several = parts.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", F.col("top.comp").alias("largest"), F.col("top.k").alias("most"), (F.col("all") - F.col("top.k")).alias("odd"))
        return now.join(several, "bucket").withColumn("main", F.col("comp") == F.col("largest")).join(classes.select("key", "n", "sig"), "key")

    def contract(more, at):
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), f"{work}/{at}")

    # the likeliest partners join most of what belongs together; then all that is left, after a longer look
    roots = contract(verify(_across(open_classes(), percent, BEST).distinct(), compared=True), "likeliest")
    left = common.saved(_across(open_classes(), percent, keys=True).distinct(), f"{work}/left")
    sets = common.saved(verify.sets(left), f"{work}/sets")
    roots = contract(verify(_across(open_classes().join(_wide(sets), "key"), percent), compared=True, sets=sets), "rest")
    label = classes.select("key", "rep").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = label.groupBy("root").agg(F.min("rep").alias("component"))
    label = common.saved(label.join(least, "root").select("key", "component"), f"{work}/labels")
    for done in ("classes", "members", "first", "likeliest", "rest", "left", "sets", *(f"verify{i}" for i in range(1, verify.calls + 1))):
        common.forget(spark, f"{work}/{done}")
    out = rows.select("doc_id", "n_shingles", "key").join(label, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def forget(spark: SparkSession, work: str) -> None:
    """Delete what a result of near_duplicates() reads."""
    for done in ("sketch", "labels"):
        common.forget(spark, f"{work}/{done}")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents` on two-word shingles."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op7_minhash": op7_minhash}
SQL: dict[str, str] = {}
