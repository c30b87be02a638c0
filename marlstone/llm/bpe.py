"""Byte-level BPE with a rank queue made of hierarchical bitmaps.

Each pre-token is a doubly linked list of its parts. A bucket per merge rank holds the positions at which that merge is
possible; two levels of 256-bit words mark the buckets that are not empty, and find-first-set from the top down picks the
next rank. A merge changes two neighbouring pairs; their old entries stay in their buckets and are skipped as stale when
they come up. A pre-token of n bytes takes O(n log n) steps at worst, so very long ones do not matter.

The new short pre-tokens of an Arrow batch share one queue: the top word picks the lowest leaf (256 ranks) with entries, and
there each pre-token merges its own lowest rank, all of them at once in numpy. Pre-tokens don't touch each other and no lower
leaf has entries, so each one's merges come in the same order as alone.

Defined results: null text is empty and gives no ids; rows are independent, so repeated rows give repeated results and an
empty table an empty one. Other columns of the input are kept by encode() and decode() unless they have the names these add.
"""

from __future__ import annotations

import base64
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Entries of each of a task's two large caches (about 200 bytes an entry), and characters of the longest key they hold.
REMEMBERED, LONGEST = 700_000, 64
#: Bytes of the longest pre-token that shares a queue with others, and bytes of all that share one.
SHORT, TOGETHER = 64, 1 << 22

# Fixed value: the pattern whose matches never hold a blank but as their first character, unless they are blank altogether.
BLANKS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_models: dict = {}  # of a worker that keeps its caches, one at most
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank under two levels of bitmaps: a leaf word of 256 bits marks the ranks with entries, a bit of
    the top word marks a leaf that isn't 0. The lowest rank is found by find-first-set in the top word and in its leaf."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.leaf = ranks, [0] * ((max(ranks.values()) >> 8) + 1)
        self.two = {(*k,): v for k, v in ranks.items() if len(k) == 2}
        self.buckets: dict[int, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue is empty before and after."""
        n, leaf, buckets, ranks, get, top = len(piece), self.leaf, self.buckets, self.ranks, self.ranks.get, 0
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        pair = list(map(self.two.get, zip(piece, piece[1:])))  # the rank of merging the part at a position with the next one, if any
        pair += (None, None)
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # positions only grow here: still a heap
                else:
                    buckets[r] = [i]
                    leaf[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            t = (top & -top).bit_length() - 1
            w = leaf[t]
            rank = t << 8 | (w & -w).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaf[t] = w = w & (w - 1)
                if not w:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = nxt[i]
            k = nxt[i] = nxt[j]
            prv[k] = i
            pair[j] = None
            pair[i] = r = get(piece[i : nxt[k]]) if k < n else None
            if r is not None:
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    leaf[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
            if i:
                h = prv[i]
                pair[h] = r = get(piece[h:k])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        leaf[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out


class SharedQueue:
    """RankQueue over many short pre-tokens at once: entries by leaf under the top word, and per pre-token the lowest rank in it."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        self.single = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
        found = [(a << 32 | b, r) for k, r in ranks.items() for i in range(1, len(k)) if (a := get(k[:i])) is not None and (b := get(k[i:])) is not None]
        keys, made = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], -1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b, or -1."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none is empty), as little-endian unsigned 32-bit integers."""
        size = np.array([len(p) for p in pieces], np.int64)
        stop = np.cumsum(size)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if ids.min(initial=0) < 0:
            raise KeyError("a byte has no rank")
        n = len(ids)
        owner = np.repeat(np.arange(len(pieces)), size)
        start = stop - size
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.append(self.rank(ids[:-1], ids[1:]), -1)
        pair[stop - 1] = -1
        alive = np.ones(n, bool)
        leaves: dict[int, list[np.ndarray]] = {}
        top = 0

        def push(pos, leaf):
            nonlocal top
            order = np.argsort(leaf, kind="stable")
            pos, leaf = pos[order], leaf[order]
            cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(pos)]
            for t, x, y in zip(leaf[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if t in leaves:
                    leaves[t].append(pos[x:y])
                else:
                    leaves[t] = [pos[x:y]]
                    top |= 1 << t

        at = np.flatnonzero(pair >= 0)
        if len(at):
            push(at, pair[at] >> 8)
        while top:
            t = (top & -top).bit_length() - 1
            top &= top - 1
            got = leaves.pop(t)
            pos = np.concatenate(got) if len(got) > 1 else got[0]
            rank = pair[pos]
            live = rank >> 8 == t  # others are stale
            pos, rank = pos[live], rank[live]
            if not len(pos):
                continue
            key = np.sort((owner[pos] << 8 | rank & 255) << 32 | pos)
            pos, whose = key & 0xFFFFFFFF, key >> 40
            first = np.append(True, whose[1:] != whose[:-1])
            if not first.all():
                leaves[t] = [pos[~first]]
                top |= 1 << t
                pos, whose = pos[first], whose[first]
            j = nxt[pos]
            k = nxt[j]
            ids[pos] = pair[pos]
            nxt[pos], prv[k] = k, pos  # prv of a piece's first place is never read
            pair[j], alive[j] = -1, False
            on, back = k < stop[whose], pos > start[whose]
            right = np.full(len(pos), -1)
            right[on] = self.rank(ids[pos[on]], ids[k[on]])
            pair[pos] = right
            left = prv[pos[back]]
            pair[left] = before = self.rank(ids[left], ids[pos[back]])
            new, rank = np.concatenate([pos, left]), np.concatenate([right, before])
            live = rank >= 0
            if live.any():
                push(new[live], rank[live] >> 8)
        raw = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive)[stop - 1]).tolist()
        return [raw[x:y] for x, y in zip([0, *ends], ends)]


class Model:
    """Ranks, the queues and the caches of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.queue, self.shared = ranks, RankQueue(ranks), SharedQueue(ranks)
        self.find = regex.compile(pattern).findall
        self.tokens = common.Cache(self._token, remembered, LONGEST)
        self.spaced = common.Cache(self.by_pattern, remembered, LONGEST)  # stretches of several tokens
        self.by_stretch = pattern == BLANKS_FIRST

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        return self.queue.merge(piece) if whole is None else [whole]

    def _token(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8"))
        return _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.find(text)))

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of the pre-tokens; new short ones go through one queue."""
        known, ranks, out, new, size = self.tokens.known, self.ranks, {}, [], 0

        def share():
            for p, ids in zip(new, self.shared.merge([p.encode("utf-8") for p in new])):
                out[p] = ids
                self.tokens.put(p, ids)

        for p in pieces:
            if (ids := known(p)) is None:
                raw = p.encode("utf-8")
                if raw in ranks or not 0 < len(raw) <= SHORT:
                    ids = self.tokens[p]
                else:
                    new.append(p)
                    if (size := size + len(raw)) >= TOGETHER:
                        share()
                        new, size = [], 0
                    continue
            out[p] = ids
        if new:
            share()
        return out

    def _words(self, words: list[str]) -> list[bytes | None]:
        """Ids of the stretches that encode_column() makes, None where one is empty or begins or ends with white space."""
        token, spaced, out, new, pieces = self.tokens.known, self.spaced.known, [], [], set()
        for i, w in enumerate(words):
            ids = token(w) if w == "\n" or not w.isspace() else None  # white space is a token, but where it ends depends on what follows
            if ids is None and (ids := spaced(w)) is None and (w == "\n" or (bare := w[1:] if w[:1] == " " else w) and not (bare[0].isspace() or bare[-1].isspace())):
                found = self.find(w)
                new.append((i, w, found))
                pieces.update(found)
            out.append(ids)
        learnt = self._learn(pieces)
        for i, w, found in new:
            out[i] = ids = b"".join(map(learnt.__getitem__, found))
            if len(found) > 1:
                self.spaced.put(w, ids)
        return out

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids of all texts, and where each text's end. Where single spaces and line ends stand between other
        characters, BLANKS_FIRST always begins a new match, so Arrow splits the texts there (a NUL before each space and around each
        line end) and finds the different stretches, which go through caches; any other text or pattern goes whole."""
        if self.by_stretch:
            cut = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
            data, ends, bad = common.in_turn(pc.split_pattern(cut, "\0"), lambda words: pa.array(self._words(common.strings(words)), pa.large_binary()))
            whole = np.union1d(bad, np.flatnonzero(pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False))).tolist()
            if not whole:
                return data, ends
            out = common.binaries(data, ends).to_pylist()
        else:
            whole = range(len(texts))
            out = [b""] * len(texts)
        found = [self.find(texts[i].as_py()) for i in whole]
        learnt = self._learn(set().union(*found))
        for i, pieces in zip(whole, found):
            out[i] = b"".join(map(learnt.__getitem__, pieces))
        return _laid(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


def _laid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values after one another, and where each ends."""
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(x) for x in values], dtype=np.int64)


def _parts(ranks: dict[bytes, int]) -> pa.LargeBinaryArray:
    parts = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        parts[v] = k
    return pa.array(parts, pa.large_binary())


def _decoded(data: np.ndarray, ends: np.ndarray, parts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids whose own bytes are `data`, and where those of each text end."""
    got = parts.take(pa.array(np.frombuffer(data, "<u4")))
    stops = np.frombuffer(got.buffers()[1], np.int64)[ends // 4] if len(got) else np.zeros(len(ends), np.int64)
    return np.frombuffer(got.buffers()[2], np.uint8)[: stops[-1]] if len(got) else np.zeros(0, np.uint8), stops


#: What encode() can add besides the ids: the bytes that decode() gives for them, or whether those are the text.
BACK = {"": (), "decoded": (("decoded", T.BinaryType(), pa.binary()),), "round_trip": (("round_trip", T.BooleanType(), pa.bool_()),)}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", back: str = "", remembered: int = REMEMBERED, keep: bool = False) -> DataFrame:
    """docs with the column ids: the ids of each whole text as little-endian unsigned 32-bit integers. With back ("decoded" or
    "round_trip") also a column of that name, from the same pass; caches live as long as their task,
    or with keep as long as their worker, and hold `remembered` entries each at most; both change speed and memory only."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(load_ranks(ranks_path))
    added = (("ids", T.BinaryType(), pa.binary()), *BACK[back])
    kept = docs.drop(*(name for name, _, _ in added))
    at = kept.columns.index(text_col)

    def run(batches):
        key = (ranks_path, pattern, remembered)
        model, parts = _models.get(key) or Model(sent.value, pattern, remembered), _parts(sent.value)
        if keep:
            _models.clear()
            _models[key] = model
        for b in batches:
            texts = pc.fill_null(b.column(at).cast(pa.string()), "")
            data, ends = model.encode_column(texts)
            new = [common.binaries(data, ends)]
            if back:
                new.append(common.binaries(*_decoded(data, ends, parts)))
            if back == "round_trip":
                new[1] = pc.equal(new[1], texts.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(name for name, _, _ in added)])
            del b, texts, data, new

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind, _ in added)]))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """df with the column decoded: the bytes that the ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kept = df.drop("decoded")
    at = kept.columns.index(ids_col)

    def run(batches):
        parts = None
        for b in batches:
            parts = _parts(sent.value) if parts is None else parts
            yield pa.RecordBatch.from_arrays([*b.columns, common.binaries(*_decoded(*_laid(b.column(at).to_pylist()), parts))], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, encoded and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_of(None).alias("text"))
    return encode(docs, path, public_tokenizers.PATTERN, back="decoded", keep=True).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
SQL: dict[str, str] = {}
