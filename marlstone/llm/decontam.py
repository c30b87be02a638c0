"""Benchmark decontamination with an FM-index per training shard.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Every run of `window` consecutive words of a
benchmark item is a phrase; an item of fewer words, but not none, is one phrase. A shard is a run of documents, about
SHARD_WORDS symbols: the documents' words as ids of the benchmark's vocabulary, all other words and the ends of documents
being one separator that no phrase holds (stretches between separators that are shorter than the shortest phrase are left
out). A shard's suffix array gives its Burrows-Wheeler transform, held in a wavelet tree; all phrases are searched
backwards at once, each step two rank queries per level. Occurrences are located by steps back to the nearest sampled
suffix position, and the spans of words that they cover are merged by document.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, one pass of the documents for each block;
what a document gathers (spans, items) goes along with its row, so no block needs a shuffle. To clean, all blocks search the
same text, then it is cut, and cut texts go through all blocks again until nothing is found: borders of blocks do not matter.

Defined results: null texts have no words and no hits, and null items no phrases; an empty benchmark hits nothing; equal
phrases of several items count for each. Repeated rows get equal results. Columns of the input stay, but for those added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
SHARD_WORDS = 1 << 20
SHARD_DOCS = 20_000
BLOCK_BYTES = 8 << 20
SAMPLING = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """Distinct phrases of a block of items, as rows of word ids (from 1), and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")]
            for i in range(max(1, len(ws) - window + 1)) if ws else ():
                found.setdefault(tuple(ws[i : i + window]), set()).add(item)
        self.phrases = list(found)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), max(self.lengths, default=0)), np.int64)
        for i, p in enumerate(found):
            self.table[i, : len(p)] = p
        self.shortest = int(min(self.lengths, default=0))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling; a shorter suffix comes before a longer one that it begins."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank, k = new, 2 * k
        if k >= n or rank[order[-1]] == n - 1:
            return order


class BitRank:
    """Ones before a position, from a count per 64-bit word and the bits of the word itself."""

    def __init__(self, bits: np.ndarray):
        n = (len(bits) >> 6) + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Rank of a symbol and the symbol at a position; level by level, zeros before ones."""

    def __init__(self, s: np.ndarray):
        self.levels = []
        for shift in reversed(range(max(1, int(s.max(initial=0)).bit_length()))):
            bits = s >> shift & 1
            self.levels.append((shift, BitRank(bits), int(len(s) - bits.sum())))
            s = np.concatenate([s[bits == 0], s[bits == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbols >> shift & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the positions, and how often each stands before its position."""
        symbol, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.bit(at).astype(bool)
            symbol |= one.astype(np.int64) << shift
            a, b = bits.ones(low), bits.ones(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return symbol, at - low


class FMIndex:
    """Of s followed by an end symbol 0; the symbols of s are 1 at least."""

    def __init__(self, s: np.ndarray, sampling: int = SAMPLING):
        s = np.append(s, 0)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.tree = WaveletTree(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])  # suffixes that begin with a smaller symbol
        sampled = order % sampling == 0
        self.sampled, self.positions, self.n = BitRank(sampled), order[sampled], len(s)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffix array that begin with each phrase, found from its last symbol to its first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step]
            known = c < len(self.first) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in s of the suffixes at these places of the suffix array."""
        out, steps, todo, at = np.zeros(len(at), np.int64), 0, np.arange(len(at)), at.copy()
        while len(todo):
            have = self.sampled.bit(at).astype(bool)
            out[todo[have]] = self.positions[self.sampled.ones(at[have])] + steps
            todo, at = todo[~have], at[~have]
            symbol, before = self.tree.access(at)
            at, steps = self.first[symbol] + before, steps + 1
        return out


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, list[str]]]:
    """For each document (word ids, 0: not in the benchmark): merged spans of hit words as rows (from, to), and its items."""
    nothing = (np.zeros((0, 2), np.int64), [])
    out = [nothing] * len(docs)
    if not phrases.phrases or not docs:
        return out
    all_ids = np.concatenate([x for d in docs for x in (d, np.zeros(1, d.dtype))]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    known = all_ids > 0
    edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    keep = np.zeros(len(all_ids) + 1, np.int64)  # each stretch that is kept, and the separator after it
    keep[begin] += 1
    keep[end + 1] -= 1
    where = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    index = FMIndex(all_ids[where] + 1)  # 1: separator
    low, high = index.search(phrases.table + 1, phrases.lengths)
    count = high - low
    hit = np.flatnonzero(count > 0)
    if not len(hit):
        return out
    of = np.repeat(hit, count[hit])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    at = where[index.locate(low[of] + nth)]
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at, doc))
    at, doc, of = at[order], doc[order], of[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(doc))):
        d = int(doc[a])
        items = sorted({item for p in set(of[a:b].tolist()) for item in phrases.items[p]})
        out[d] = (merged(np.stack([at[a:b], at[a:b] + phrases.lengths[of[a:b]]], 1) - starts[d]), items)
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans (from, to) as disjoint spans in order; spans that touch become one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]], 1)


def without(text: str, spans: np.ndarray) -> str:
    """The text without those words and what stands between the words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, bound: int):
    """The benchmark's items in blocks of at most `bound` bytes of text, or of one longer item."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), common.text_of(benchmark, text_col)).toLocalIterator():
        n = len(r[1].encode("utf-8"))
        if block and size + n > bound:
            yield block
            block, size = [], 0
        block.append((r[0] or "", r[1]))
        size += n
    yield block


_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))]


def _scan(docs: DataFrame, sent, text_col: str, window: int, clean: bool) -> DataFrame:
    """One pass of a block: n_words, spans and items of each document, joined to those it brings along. With clean, for a
    benchmark of one block, the text loses its spans, and what is left is searched again until nothing is found."""
    names = docs.columns
    at, more = names.index(text_col), "spans" in names
    base = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]

    def run(batches):
        phrases = Phrases(sent.value, window)
        look = phrases.ids.get
        rows, held, n_words, size = [], [], [], 0

        def flush():
            found = search_shard(held, phrases)
            columns = {f.name: pa.concat_arrays([b.column(f.name) for b in rows]) for f in base} if rows else {}
            spans = [s for s, _ in found]
            names_ = [set(i) for _, i in found]
            if more:
                for j, (old, had) in enumerate(zip((x for b in rows for x in b.column("spans").to_pylist()), (x for b in rows for x in b.column("items").to_pylist()))):
                    spans[j] = merged(np.concatenate([np.array(old, np.int64).reshape(-1, 2), spans[j]]))
                    names_[j].update(had)
            if clean:
                texts = columns[text_col].to_pylist()
                todo = [j for j, (s, _) in enumerate(found) if len(s)]
                last = {j: found[j][0] for j in todo}
                while todo:
                    for j in todo:
                        texts[j] = without(texts[j], last[j])
                    again = search_shard([np.array([look(w, 0) for w in words_of(texts[j])], np.int32) for j in todo], phrases)
                    last = {j: s for j, (s, _) in zip(todo, again) if len(s)}
                    todo = list(last)
                columns[text_col] = pa.array(texts, columns[text_col].type)
            return pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(n_words, pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in names_], pa.list_(pa.string()))],
                [*columns, "n_words", "spans", "items"],
            )

        for b in batches:
            rows.append(b)
            for text in b.column(at).to_pylist():
                ws = words_of(text or "")
                n_words.append(len(ws))
                held.append(np.array([look(w, 0) for w in ws], np.int32))
                size += len(ws)
            if size >= SHARD_WORDS or len(held) >= SHARD_DOCS:
                yield flush()
                rows, held, n_words, size = [], [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, T.StructType([*base, *_ADDED]))


def _cut(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts without the words of their spans."""
    at, spans_at = docs.columns.index(text_col), docs.columns.index("spans")

    def run(batches):
        for b in batches:
            texts = [without(t, np.array(s, np.int64)) for t, s in zip(b.column(at).to_pylist(), b.column(spans_at).to_pylist())]
            yield b.set_column(at, b.schema.names[at], pa.array(texts, b.column(at).type))

    return docs.mapInArrow(run, docs.schema)


def _rounds(docs: DataFrame, search, text_col: str) -> DataFrame:
    """Texts that all blocks hit are cut and searched by all blocks again; each round holds only what the one before has cut."""
    added = [f.name for f in _ADDED]
    work = common.workspace(docs.sparkSession)
    now = common.saved(search(docs).withColumn("_first", F.struct(*added)), f"{work}/0")
    done, i = now, 0
    while not (hit := now.where(F.size("spans") > 0)).isEmpty():
        i += 1
        now = common.saved(search(_cut(hit, text_col).drop(*added)), f"{work}/{i}")
        done = done.where(F.size("spans") == 0).unionByName(now)
    return done.select(*docs.columns, *[F.col("_first")[c].alias(c) for c in added])


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """docs with n_words, spans (array of [from, to) in words) and items (sorted ids as strings) of what the benchmark hits.

    With clean, text has lost what is hit; n_words, spans and items are those of the text before."""
    common.small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "spans", "items")
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark, item_col, item_text, block_bytes)]

    def search(out):
        for block in sent:
            out = _scan(out, block, text_col, window, clean and len(sent) == 1)
        return out

    return _rounds(docs, search, text_col) if clean and len(sent) > 1 else search(docs)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` against every item of `benchmark`."""
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.element_at(s, 2) - F.element_at(s, 1))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


QUERIES = {"op4_decontam": op4_decontam}
SQL: dict[str, str] = {}
