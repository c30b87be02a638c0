"""Frequent phrases and how much more often their parts meet than chance, per language.

Texts are lower-cased (A-Z), cut at PIECE characters into pieces and those at blanks and tabs into words. Every phrase of one to LONGEST
consecutive words of a piece is counted, overlaps included, in three passes over the texts:

1. A sketch. The phrases of each length fall into so many counters that a counter stands for SHARE phrases in the mean; counters are
   dealt in blocks of 65,536 to tasks, as packed positions, and added up there. A counter is never below the count of a phrase in it.
2. Candidates. A phrase is one where its own counter and both phrases a word shorter reach the least count; each task sends its
   different ones in sorted, compressed groups by hash, and a group's repeats from other tasks go.
3. Counts. Candidates are compiled, with a blank on either side of each word, into Aho-Corasick automata of at most AUTOMATON_BYTES
   of phrases; each automaton reads all texts of its language, counts overlapping matches, and the tasks' counts are added.

What reaches the least count is exact then: no phrase is lost (a counter only errs upwards), none is miscounted. The driver holds one
automaton's phrases at a time and a bit per counter (2^MOST_BITS per length at most; beyond some 16 million counters' worth of
phrases each the bounds get looser and more candidates are counted, with the same result).

The score of a cut of a phrase is floor(1000 a n / (l r)) in 38-digit decimals, by joins on the parts; the lowest cut counts.

Defined results: null text is empty; a null language is `und`; texts without words count nothing; repeated rows count each time; an
empty table gives an empty result. Columns of the input other than text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LONGEST, LEAST, TOP, COVERED = 5, 100, 2_000, 100
SHARE = 8  # words per counter, in the mean, of each length
LEAST_BITS, MOST_BITS = 16, 28
BLOCK = 1 << 16
FLUSH = 2 << 20  # phrases of a length that a task gathers before it sends them
HELD = 1_000_000  # candidates that a task holds before it sends them
AUTOMATON_BYTES = 6 << 20
SCAN_BYTES = 64 << 20  # of texts that a task reads with one automaton
CHUNK = 4096
BREAK = b"."  # stands for the end of a piece among words, which never hold it

# What ends a piece, and what ends a word.
PIECE = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"

_MARKS = bytes.maketrans(PIECE.encode() + b"\t", b"\n" * len(PIECE) + b" ")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    """Words in order, BREAK between pieces. bytes.lower() changes A-Z only."""
    return text.lower().translate(_MARKS).replace(b"\n", b" . ").split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """A 64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = 0 if word == BREAK else xxhash.xxh64_intdigest(word) or 1
        return h


def phrase_hashes(words: list[bytes], lang: str, known: _Hashes, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length: hashes of the phrases that begin at each word, and whether they stay within a piece."""
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h, inside = np.full(len(ids), known[b"\x00" + lang.encode("utf-8", "surrogatepass")], np.uint64), np.ones(len(ids), bool)
    out = []
    for k in range(min(longest, len(ids))):
        n = len(ids) - k
        h = (h[:n] + ids[k:]) * _P
        inside = inside[:n] & (ids[k:] != 0)
        out.append((_mix(h), inside))
    return out


def _by_language(batch, lang_at: int, text_at: int):
    """(language, words of all its texts in this batch)."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(lang_at).to_pylist(), batch.column(text_at)):
        found.setdefault(lang, []).append(text.as_py())
    for lang, texts in found.items():
        yield lang, words_of(b"\n".join(texts))


def texts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_lang, _text): text as bytes."""
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), common.text_of(docs, text_col).cast("binary").alias("_text"))


def sketch(texts: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """(length, block, lang, data, n): by length and block a bit for each counter, packed and compressed, that reaches `least`; and, with
    length 0, by language the number of all its words."""
    schema = "length int, block int, lang string, data binary, n long"
    spark = texts.sparkSession

    def gather(batches):
        import zstandard

        press, known, waiting, size, total = zstandard.ZstdCompressor(level=1), _Hashes(), [[] for _ in range(longest)], 0, {}

        def send(k: int):
            at = np.sort(np.concatenate(waiting[k]))
            waiting[k] = []
            edges = np.flatnonzero(np.diff(at >> np.uint32(16), prepend=np.uint32(1 << 31)))
            rows = []
            for a, b in zip(edges, [*edges[1:], len(at)]):
                local = (at[a:b] & np.uint32(BLOCK - 1)).astype(np.uint16)
                rows.append((int(at[a] >> np.uint32(16)), press.compress(np.diff(local, prepend=np.uint16(0)).tobytes())))
            cols = [pa.array([k + 1] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.nulls(len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["length", "block", "lang", "data", "n"])

        for batch in batches:
            for lang, words in _by_language(batch, 0, 1):
                for k, (h, inside) in enumerate(phrase_hashes(words, lang, known, longest)):
                    waiting[k].append((h[inside] >> np.uint64(64 - bits)).astype(np.uint32))
                    if k == 0:
                        n = len(waiting[0][-1])
                        total[lang] = total.get(lang, 0) + n
                        size += n
            if size >= FLUSH:
                yield from (send(k) for k in range(longest) if waiting[k])
                size = 0
        yield from (send(k) for k in range(longest) if waiting[k])
        cols = [pa.array([0] * len(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array(list(total), pa.string()), pa.nulls(len(total), pa.binary()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["length", "block", "lang", "data", "n"])

    def add(batches):
        import zstandard

        press, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        counts: dict[tuple[int, int], np.ndarray] = {}
        total: dict[str, int] = {}
        for batch in batches:
            for length, block, lang, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if length == 0:
                    total[lang] = total.get(lang, 0) + n
                    continue
                local = np.cumsum(np.frombuffer(open_.decompress(data), np.uint16), dtype=np.uint16)
                at = counts.setdefault((length, block), np.zeros(BLOCK, np.uint32))
                at += np.bincount(local, minlength=BLOCK).astype(np.uint32)
        out = [(length, block, None, press.compress(np.packbits(c >= least).tobytes()), None) for (length, block), c in counts.items() if (c >= least).any()]
        out += [(0, 0, lang, None, n) for lang, n in total.items()]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["length", "block", "lang", "data", "n"])

    return texts.mapInArrow(gather, schema).repartition(common.spread(spark), "length", "block", "lang").mapInArrow(add, schema)


def candidates(texts: DataFrame, table: DataFrame, bits: int, longest: int) -> DataFrame:
    """(lang, phrase): the different phrases (bytes) that the sketch's table lets through."""
    import zstandard

    spark, open_ = texts.sparkSession, zstandard.ZstdDecompressor()
    maps = np.zeros((longest, (1 << bits) // 8), np.uint8)
    for r in table.where("length > 0").select("length", "block", "data").toLocalIterator():  # a bit per counter
        maps[r["length"] - 1, r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(open_.decompress(bytes(r["data"])), np.uint8)
    sent = spark.sparkContext.broadcast(maps)

    groups = 4 * common.spread(spark)

    def find(batches):
        import xxhash

        press, known, waiting = zstandard.ZstdCompressor(level=3), _Hashes(), {}
        seen, held = [np.zeros(0, np.uint64) for _ in range(longest)], 0

        def send():
            rows = [(lang, group, press.compress(b"\n".join(sorted(phrases)))) for (lang, group), phrases in waiting.items()]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["lang", "grp", "data"])

        for batch in batches:
            if held >= HELD:
                yield send()
                held = 0
            for lang, words in _by_language(batch, 0, 1):
                before = None
                for k, (h, inside) in enumerate(phrase_hashes(words, lang, known, longest)):
                    may = np.flatnonzero(inside if before is None else before[:-1] & before[1:] & inside)
                    at = (h[may] >> np.uint64(64 - bits)).astype(np.int64)
                    may = may[(sent.value[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                    before = np.zeros(len(h), bool)
                    before[may] = True
                    new, first = np.unique(h[may], return_index=True)
                    spot = np.searchsorted(seen[k], new)
                    fresh = np.ones(len(new), bool) if not len(seen[k]) else seen[k][np.minimum(spot, len(seen[k]) - 1)] != new
                    if fresh.any():
                        seen[k] = np.insert(seen[k], spot[fresh], new[fresh])
                        held += int(fresh.sum())
                        for i in may[first[fresh]].tolist():
                            phrase = b" ".join(words[i : i + k + 1])
                            waiting.setdefault((lang, xxhash.xxh32_intdigest(phrase) % groups), []).append(phrase)
        yield send()

    def differ(batches):
        open_, found = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found.setdefault(lang, set()).update(open_.decompress(data).split(b"\n"))
        for lang, phrases in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(sorted(phrases), pa.binary())], ["lang", "phrase"])

    packed = texts.mapInArrow(find, "lang string, grp int, data binary")
    return packed.repartition(common.spread(spark), "lang", "grp").mapInArrow(differ, "lang string, phrase binary")


def count(texts: DataFrame, phrases: DataFrame, size: int, least: int, work: str) -> DataFrame:
    """(lang, phrase, a) of the phrases (lang, phrase) that occur `least` times, counted one automaton after the other; size: bytes of the texts."""
    spark = texts.sparkSession
    whole = phrases.agg(F.sum(F.octet_length("phrase") + 2)).collect()[0][0] or 0
    parts = max(1, -(-whole // AUTOMATON_BYTES))
    tasks = max(1, -(-size // SCAN_BYTES))
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)))
    schema = "chunk int, counts binary"
    done = []
    for part in range(parts):
        own = sorted((r["lang"], bytes(r["phrase"])) for r in dealt.where(F.col("part") == part).select("lang", "phrase").toLocalIterator())  # AUTOMATON_BYTES
        sent = spark.sparkContext.broadcast(own)

        def scan(batches, sent=sent):
            import ahocorasick

            counts, automata, spans = np.zeros(len(sent.value), np.int64), {}, {}
            for i, (lang, _) in enumerate(sent.value):
                spans[lang] = (spans.get(lang, (i,))[0], i + 1)
            for batch in batches:
                for lang, words in _by_language(batch, 0, 1):
                    if lang not in spans:
                        continue
                    if lang not in automata:
                        automata[lang] = auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                        for i in range(*spans[lang]):
                            auto.add_word(f" {sent.value[i][1].decode('latin-1')} ", i)
                        auto.make_automaton()
                    text = f" {b' '.join(words).decode('latin-1')} "
                    found = np.fromiter((i for _, i in automata[lang].iter(text)), np.int64)
                    np.add(counts, np.bincount(found, minlength=len(counts)), out=counts)
            full = [c for c in range(0, len(counts), CHUNK) if counts[c : c + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK for c in full], pa.int32()), pa.array([counts[c : c + CHUNK].tobytes() for c in full], pa.binary())], ["chunk", "counts"])

        def add(batches, sent=sent):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total[c] = total.get(c, 0) + np.frombuffer(data, np.int64)
            rows = [(*sent.value[c * CHUNK + int(i)], int(x[i])) for c, x in total.items() for i in np.flatnonzero(x >= least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "phrase", "a"])

        got = texts.coalesce(tasks).mapInArrow(scan, schema).repartition(common.spread(spark), "chunk").mapInArrow(add, "lang string, phrase binary, a long")
        done.append(common.saved(got, f"{work}/count{part}"))
        sent.unpersist()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of up to `longest` words that occur `least` times; (lang, n) of all words."""
    spark = docs.sparkSession
    common.small_batches(spark)
    work = work or common.workspace(spark)
    texts = texts_of(docs, text_col, lang_col)
    size = texts.agg(F.sum(F.octet_length("_text"))).collect()[0][0] or 0
    bits = int(min(MOST_BITS, max(LEAST_BITS, (size // 6 // SHARE).bit_length())))
    table = common.saved(sketch(texts, bits, least, longest), f"{work}/sketch")
    found = common.saved(candidates(texts, table, bits, longest), f"{work}/candidates")
    counts = count(texts, found, size, least, work).select("lang", F.col("phrase").cast("string").alias("phrase"), "a")
    return counts, table.where("length = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words and more. One whose words stand inside a longer
    phrase with `covered` per cent of its occurrences is left out."""
    counts, total = counted(docs, text_col, lang_col, least, longest)
    size = F.size(F.split("phrase", " "))
    phrases = counts.where(size > 1).withColumn("_w", F.split("phrase", " "))
    join = lambda at, n: F.array_join(F.slice("_w", at, n), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("_w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda at: join(at, n))))
    larger = phrases.where(F.size("_w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_in"))
    kept = phrases.join(larger, ["lang", "phrase"], "left").where(F.col("_in").isNull() | (100 * F.col("_in") < covered * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("first"), join(k + 1, F.size("_w")).alias("rest")))).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    both = cuts.join(parts("first", "l"), ["lang", "first"]).join(parts("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(1000 * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of `documents`."""
    return collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, i, unnest(range(1, {LONGEST + 1})) AS k FROM g) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM p GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS b FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
q AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, ws FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.b >= {COVERED} * c.a)),
e AS (SELECT q.lang, q.phrase, q.a, cut, l.a AS l, r.a AS r, n, ((1000::HUGEINT * q.a * n) // (l.a::HUGEINT * r.a)) AS score FROM q JOIN f l ON l.lang = q.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = q.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN t ON t.lang = q.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {TOP}"""
}
