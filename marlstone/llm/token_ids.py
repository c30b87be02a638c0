"""Token ids in a compact binary format: canonical length-limited Huffman codes from global counts.

The format is a folder with two Parquet tables. `codebook` has one row: the code length of every id (0: not used), from
which the canonical codes follow. `blocks` has a row per block, a run of whole documents in ascending doc_id order:
part and seq (order of blocks), part_offset (ids before the block in its part), doc_ids, n_tokens, payload (the codes, most
significant bit first) and checkpoints (the bit offset of every SPACING-th id). Blocks are decoded independently of each
other; inside a block all checkpoints are decoded side by side through one table of 2**MAX_BITS entries.

Defined results: null text is empty (only the end id is written); null doc_ids come first; rows with equal doc_id are
ordered by their ids; an empty table gives an empty file. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_BITS = 18
SPACING = 64
BLOCK_TOKENS = 1 << 16
PART_TOKENS = 1 << 22
MAX_PARTS = 20_000
CACHE_WORDS = 1_000_000

_tokenizers: dict = {}
# Fixed value: the pre-tokenizer's pattern for which words can be encoded one by one.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters of ISO 8859-1: NFC leaves them as they are, and each has one lower-case letter among them.
LATIN = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def _words_apart(spec: dict) -> bool:
    """Whether a text's ids are those of its words in turn, as _learn() takes it: white space leaves before the merges, runs of
    letters are pieces of their own, in lower case and NFC, and a piece's last id says that it is the last."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("content") == " "
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and (first.get("pattern") or {}).get("Regex") == LETTERS_APART
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and not spec.get("post_processor")
    )


def _tokenizer(json_text: str):
    """The tokenizer and one of the same model for bare letters, which ids end a word, the cache of words and the strings that are
    special, one of each per worker."""
    key = hash(json_text)
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(json_text)
        _tokenizers.clear()
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        spec, bare = json.loads(json_text), None
        if _words_apart(spec):
            spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            spec["model"] |= {"vocab": {}, "merges": []}
            bare = Tokenizer(tok.model)  # the model itself is shared
            bare.pre_tokenizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []})).pre_tokenizer
        _tokenizers[key] = ((tok, bare), ends, {"": b""}, special)
    return _tokenizers[key]


def _whole(tok, word: str, dtype: str) -> bytes:
    return np.array(tok.encode_batch_fast([word], add_special_tokens=False)[0].ids, dtype).tobytes()


def _learn_runs(tok, whole, ends: np.ndarray, cache: dict[str, bytes], letters: list[str], dtype: str) -> None:
    """Put the ids of runs of letters into the cache: they go to the library many at a time, with blanks between."""
    for i in range(0, len(letters), 2000):
        some = letters[i : i + 2000]
        ids = np.array(tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(some):
            raw, at = ids.tobytes(), [0, *(stops * ids.itemsize).tolist()]
            cache.update(zip(some, map(raw.__getitem__, map(slice, at, at[1:]))))
        else:
            cache.update((w, _whole(whole, w, dtype)) for w in some)


def _learn(toks, ends: np.ndarray, cache: dict[str, bytes], new: list[str], dtype: str) -> None:
    """Put the ids of new words into the cache. Lower-case letters of LATIN need no normalizer and no pattern. In other words the
    tokenizer ends a piece where letters and marks meet, so the letters of a word and the marks after it have ids of their own."""
    tok, bare = toks
    plain, rest, parts, letters = [], [], [], set()
    for w in new:
        (plain if w.isalpha() and w.islower() and max(w) <= "\xff" else rest).append(w)
    _learn_runs(bare, tok, ends, cache, plain, dtype)
    for w in rest:
        word = w if w.isalpha() else w.rstrip(string.punctuation)
        base = word.lower() if word.isascii() else unicodedata.normalize("NFC", word)
        if not base.lower().isalpha():
            cache[w] = _whole(tok, w, dtype)
            continue
        tail = w[len(word) :] if word is not w else ""
        if tail and tail not in cache:
            cache[tail] = _whole(tok, tail, dtype)
        if base not in cache:
            letters.add(base)
        if tail or base != w:
            parts.append((w, base, tail))
    _learn_runs(tok, tok, ends, cache, list(letters), dtype)
    for w, base, tail in parts:
        cache[w] = cache[base] + cache[tail] if tail else cache[base]


def encode_column(texts: pa.StringArray, json_text: str, dtype: str, end: bytes) -> pa.BinaryArray:
    """Ids of each text as the library gives them. This vocabulary drops white space before its merges, so a text's ids are
    those of its words in turn. Arrow splits the texts, finds the different words of a batch and, where a word is letters of LATIN
    and ASCII's marks after them, parts and lowers those; each different part goes to the library once
    per worker. Only ASCII's white space is split at: other kinds stay in a word that goes to the library as it is."""
    toks, ends, cache, special = _tokenizer(json_text)
    if not toks[1]:
        return pa.array([_whole(toks[0], t, dtype) + end for t in texts.to_pylist()], pa.binary())

    def known(parts):
        flat = parts.dictionary_encode()
        words = common.strings(flat.dictionary)
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache[""] = b""
        ids = [*map(cache.get, words)]
        if at := [i for i, x in enumerate(ids) if x is None]:
            new = [words[i] for i in at]
            _learn(toks, ends, cache, new, dtype)
            for i, w in zip(at, new):
                ids[i] = cache[w]
        return pa.array(ids, pa.large_binary()).take(flat.indices)

    def learn(words):
        letters, marks = pc.ascii_rtrim(words, string.punctuation), pc.utf8_ltrim(words, LATIN)
        plain = pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(words))  # nothing else stands in it
        first, rest = known(pc.if_else(plain, pc.utf8_lower(letters), words)), known(pc.if_else(plain, marks, ""))
        return pc.binary_join_element_wise(first, rest, pa.scalar(b"", pa.large_binary()))

    data, stops, _ = common.in_turn(pc.ascii_split_whitespace(texts), learn, end)
    out = common.binaries(data, stops)
    odd = np.zeros(len(texts), bool)
    for s in special:
        odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if not odd.any():
        return out
    return pa.array([_whole(toks[0], t, dtype) + end if x else ids for t, ids, x in zip(texts.to_pylist(), out.to_pylist(), odd.tolist())], pa.binary())


def encode_texts(texts: list[str], json_text: str, dtype: str, end: bytes) -> list[bytes]:
    """The same for a list."""
    return encode_column(pa.array(texts, pa.string()), json_text, dtype, end).to_pylist()


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id, as little-endian unsigned integers of 2 or 4 bytes."""
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        json_text = f.read()
    dtype = id_dtype(json_text)
    end = np.array([end_id], dtype).tobytes()
    sent = spark.sparkContext.broadcast(json_text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_column(b.column(1), sent.value, dtype, end)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_dtype(json_text: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(json_text).get_vocab_size() <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    levels, merged = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        merged = both[order]
    take, total = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):  # the first items of each level: its leaves gain a bit, its packages open two items below
        n = int(leaf[:take].sum())
        total[:n] += 1
        take = 2 * (take - n)
    lengths[used] = total
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        if len(ids):
            code <<= n - last
            codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
            code, last = code + len(ids), n
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every pattern of max_bits bits."""
    ids, bits = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    width = 1 << (max_bits - lengths[order].astype(np.int64))
    n = int(width.sum())
    ids[:n], bits[:n] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of a block."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    starts = ends - n_bits
    word = starts >> 5
    shifted = codes[ids] << (64 - (starts & 31) - n_bits).astype(np.uint64)  # within the two words from `word`; bits of codes don't overlap
    out = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted >> np.uint64(32), first)
        rest = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        out[word[first]] += sums
        out[word[first] + 1] += rest
    payload = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) >> 3] if len(ids) else b""
    return payload, starts[::SPACING].astype("<u8").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, table_ids: np.ndarray, table_bits: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The n ids of a block."""
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    raw = np.frombuffer(payload + bytes(max_bits // 8 + 12), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.empty((SPACING, len(at)), np.uint32)
    most, mask = len(window) - 1, (1 << max_bits) - 1
    for k in range(SPACING):
        code = (window[np.minimum(at >> 3, most)] >> (32 - max_bits - (at & 7)).astype(np.uint32)) & mask
        out[k] = table_ids[code]
        at += table_bits[code]
    return out.T.ravel()[:n]


_BLOCKS = "part int, seq long, part_offset long, n_total long, doc_ids array<bigint>, n_tokens array<bigint>, checkpoints binary, payload binary"


def write_ids(tokens: DataFrame, path: str, vocab_size: int, dtype: str) -> None:
    """Write (doc_id, ids) to path in the format of this module. Reads tokens three times: give a table, not a plan."""
    spark = tokens.sparkSession

    def count(batches):
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(x or b"" for x in b.column(0).to_pylist()), dtype)
            total += np.bincount(ids, minlength=vocab_size)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(total[got], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary at most
    counts = np.zeros(vocab_size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS)], "lengths binary, max_bits int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(lengths)

    def encode(batches):
        lengths = sent.value
        codes, part = canonical_codes(lengths), TaskContext.get().partitionId()
        docs, parts, size, seq, offset = [], [], 0, 0, 0

        def block():
            ids = np.concatenate(parts)
            payload, checkpoints = pack(ids, codes, lengths)
            cols = [[part], [seq], [offset], [len(ids)], [docs], [[len(p) for p in parts]], [checkpoints], [payload]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "seq", "part_offset", "n_total", "doc_ids", "n_tokens", "checkpoints", "payload"])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype)
                docs.append(doc)
                parts.append(ids)
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield block()
                    docs, parts, offset, size, seq = [], [], offset + size, 0, seq + 1
        if docs:
            yield block()

    n_parts = int(min(MAX_PARTS, max(1, -(-int(counts.sum()) // PART_TOKENS))))
    (
        tokens.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(encode, _BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start the number of ids of all documents before."""
    book = spark.read.parquet(f"{path}/codebook").collect()[0]  # one row
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_total").alias("n")).collect())  # MAX_PARTS rows at most
    bases, total = {}, 0
    for part, n in sums:
        bases[part], total = total, total + n
    sent = spark.sparkContext.broadcast((np.frombuffer(bytes(book["lengths"]), np.uint8), book["max_bits"], bases))

    def decode(batches):
        lengths, max_bits, bases = sent.value
        ids_of, bits_of = decode_table(lengths, max_bits)
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = unpack(r["payload"], r["checkpoints"], int(ends[-1]), ids_of, bits_of, max_bits).astype("<u4").tobytes()
                ids = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                starts = bases[r["part"]] + r["part_offset"] + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, encoded, written in the format above and read back."""
    import public_tokenizers

    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    vocab = Tokenizer.from_file(name)
    size = vocab.get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    work = common.workspace(spark)
    tokens = common.saved(tokenize(common.table(spark, sf_dir, "documents"), name, 1), f"{work}/tokens")
    write_ids(tokens, f"{work}/ids", size, dtype)
    common.forget(spark, f"{work}/tokens")
    return read_ids(spark, f"{work}/ids").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_ids": op1_token_ids}
SQL: dict[str, str] = {}
