"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, common, decontam, induced, langid, licenses, line_dedup, minhash, quality, suffix_dedup, token_ids, winnowing

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["Hello  World\nélan 12", None, "", "Hello  World\nélan 12", "x" * 5000, "a b c 'S don't\t\n\n", "😀 naïve ﬁ"]


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------------------------------
def ids_file(spark, df):
    from tokenizers import Tokenizer

    work = common.workspace(spark)
    tokens = common.saved(token_ids.tokenize(df, WORD, 1), f"{work}/t")
    token_ids.write_ids(tokens, f"{work}/ids", Tokenizer.from_file(WORD).get_vocab_size(), "<u2")
    return token_ids.read_ids(spark, f"{work}/ids")


def test_token_ids_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = [*TEXTS, "<|endoftext|> \x1c x", words(1, 40_000)]
    got = {r["doc_id"]: r for r in ids_file(spark, docs(spark, texts, ids="clash", start=1)).collect()}
    start = 0
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(want))
        start += len(want)


def test_token_ids_empty_table_null_and_repeated_ids(spark):
    assert ids_file(spark, docs(spark, []).where("false")).count() == 0
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, "c")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"]) for r in ids_file(spark, df).collect())
    assert got == [(0, None), (2, None), (4, 1), (6, 1)]


@pytest.mark.parametrize("counts", [[0], [5], [1, 1], [1, 2, 4, 8, 16, 32], list(range(300)), [2**i for i in range(30)]])
def test_huffman_codes(counts):
    counts = np.array(counts)
    lengths = token_ids.code_lengths(counts)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= token_ids.MAX_BITS
    assert (2**-used).sum() <= 1 + 1e-12
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 50)).astype(np.uint32)
    np.random.default_rng(0).shuffle(ids)
    payload, checkpoints = token_ids.pack(ids, token_ids.canonical_codes(lengths), lengths)
    assert (token_ids.unpack(payload, checkpoints, len(ids), *token_ids.decode_table(lengths)) == ids).all()


# 2 ------------------------------------------------------------------------------------------------------------------------
def test_bpe_equals_tiktoken(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE), special_tokens={})
    r = random.Random(3)
    texts = [*TEXTS, "a" * 30_000, "abcab" * 2000, *("".join(r.choice("ab 's\n\t  é1²😀.") for _ in range(r.randrange(20))) for _ in range(400))]
    df = bpe.decode(bpe.encode(docs(spark, texts, ids="clash", decoded=2), BYTE, P.PATTERN), BYTE)
    for row in df.collect():
        text = texts[row["doc_id"]] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == enc.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()
    same = bpe.encode(docs(spark, texts), BYTE, P.PATTERN, back="decoded", remembered=50, keep=True).select("doc_id", "ids", "decoded")
    assert same.exceptAll(df.select("doc_id", "ids", "decoded")).count() == 0
    assert bpe.encode(docs(spark, ["x"]).where("false"), BYTE, P.PATTERN).count() == 0


def test_rank_queue_merges_in_order_and_ends_empty():
    ranks, r = bpe.load_ranks(BYTE), random.Random(1)
    q = bpe.RankQueue(ranks)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            got = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not got or min(got)[0] == 1 << 30:
                return [ranks[x] for x in parts]
            i = min(got)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        piece = bytes(r.choice(b"abethe ning\xc3\xa9") for _ in range(r.randrange(1, 40)))
        assert q.merge(piece) == plain(piece) and not q.buckets and not any(q.leaf)


def test_new_pieces_share_a_queue_and_merge_as_alone():
    ranks, r = bpe.load_ranks(BYTE), random.Random(2)
    alone, shared = bpe.RankQueue(ranks), bpe.SharedQueue(ranks)
    pieces = [bytes(r.choice(b"abethe ning\xc3\xa9") for _ in range(r.randrange(1, 64))) for _ in range(2000)] + [b"a" * 64, b"x", b"ab" * 30, b"x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in shared.merge(pieces)] == [alone.merge(p) for p in pieces]
    odd = {bytes([i]): i + 600 for i in range(256)} | {b"bc": 3, b"ab": 2, b"abc": 900, b"cd": 1, b"bcd": 0, b"aa": 5, b"aaa": 4}  # merges that make lower ranks
    alone, shared = bpe.RankQueue(odd), bpe.SharedQueue(odd)
    pieces = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 20))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in shared.merge(pieces)] == [alone.merge(p) for p in pieces]


def test_a_batch_asks_for_each_stretch_once_and_known_blanks_do_not_split():
    import pyarrow as pa

    model, asked = bpe.Model(bpe.load_ranks(BYTE), P.PATTERN), []
    known = model._words
    model._words = lambda words: (asked.append(sorted(words)), known(words))[1]
    data, ends = model.encode_column(pa.array(["some word word.\nsome word", "some word"] * 50))
    assert asked == [["\n", " word", " word.", "some"]] and len(ends) == 100
    for text in ["  ", "\t", "a  b", "a \n b", "a\n\n b ", "a\n", " a", "", "a\0 b", "\0", "x \t y", "a\u3000 b", "a \u3000b"] * 2:  # the second time their blanks are known
        assert model.encode(text) == model.by_pattern(text), text


def test_words_of_a_batch_are_learnt_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(WORD) as f:
        json_text = f.read()
    tok, learn, asked = Tokenizer.from_file(WORD), token_ids._learn, []
    monkeypatch.setattr(token_ids, "_learn", lambda tok, ends, cache, new, dtype: (asked.extend(new), learn(tok, ends, cache, new, dtype)))
    token_ids._tokenizers.clear()
    texts = ["Some words, some words", "", " \n", "words\x1cwords some\u3000words \x85", "<|endoftext|> words", "l'\u00e9te\u0301 1²3 it's"] * 30
    got = token_ids.encode_column(pa.array(texts), json_text, "<u2", b"\1\0").to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert len(asked) == len(set(asked)) and "words" in asked
    assert token_ids.encode_column(pa.array([], pa.string()), json_text, "<u2", b"\1\0").to_pylist() == []
    token_ids._tokenizers.clear()


def test_case_and_marks_are_parted_before_words_are_learnt(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(WORD) as f:
        json_text = f.read()
    tok, learn, asked = Tokenizer.from_file(WORD), token_ids._learn, []
    monkeypatch.setattr(token_ids, "_learn", lambda tok, ends, cache, new, dtype: (asked.extend(new), learn(tok, ends, cache, new, dtype)))
    token_ids._tokenizers.clear()

    def ids(texts):
        return [np.frombuffer(x, "<u2").tolist() for x in token_ids.encode_column(pa.array(texts), json_text, "<u2", b"").to_pylist()]

    texts = ["Words words, WORDS!! words", "\u00c9t\u00e9, \u00e9t\u00e9 \u00c9T\u00c9!! , !!"]
    assert ids(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == ["!!", ",", "words", "\u00e9t\u00e9"]
    rng = random.Random(7)  # h and U+0331 compose only in lower case; U+0130 has two letters in it; U+00AA and U+00B5 are lower-case letters without an upper one in ISO 8859-1
    signs = ["a", "H", "h\u0331", "H\u0331", "s", "S", "t", "I\u0307", "\u0130", "\u03a3", "\u03c3", "\u00df", "\u00ff", "\u0178", "\u00c0", "A\u0300", "\u0301", "\u00aa", "\u00ba", "\u00b5", "\u00d7", "\u00f7", "\u00ad", "\u212a", "\ufb01", "1", "\u00b2", "'", "'S", ",", ".", "-", "\0", "\u00a0", "\u4e2d", "\U0001f600"]
    texts = [" ".join("".join(rng.choices(signs, k=rng.randint(1, 5))) for _ in range(6)) for _ in range(3000)]
    assert ids(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    token_ids._tokenizers.clear()


def test_another_pattern_goes_whole_and_caches_stay_small(spark):
    got = bpe.Model(bpe.load_ranks(BYTE), r"\s+|\S", 20)
    text = " ".join(words(i, 30) for i in range(20))
    assert got.encode(text) == got.by_pattern(text) and not got.by_stretch
    own = bpe.Model(bpe.load_ranks(BYTE), P.PATTERN, 20)
    assert own.by_stretch and own.encode(text) == own.by_pattern(text)
    assert max(len(c) + len(c.old) for c in (own.tokens, own.spaced)) <= 21
    flags = bpe.encode(docs(spark, TEXTS), BYTE, P.PATTERN, back="round_trip").select("round_trip").distinct().collect()
    assert [x[0] for x in flags] == [True]


def test_special_strings_are_the_librarys_business(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y z", "<|endoftext|", "plain words"]
    rows = token_ids.tokenize(docs(spark, texts), WORD, 1).collect()
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in sorted(rows)] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_another_tokenizer_goes_whole():
    import json

    with open(WORD) as f:
        spec = json.load(f)
    assert token_ids._words_apart(spec)
    spec["normalizer"]["normalizers"].pop()
    assert not token_ids._words_apart(spec)
    text = json.dumps(spec)
    got = token_ids.encode_texts(["Some Words, Here"], text, "<u4", b"")
    from tokenizers import Tokenizer

    assert np.frombuffer(got[0], "<u4").tolist() == Tokenizer.from_str(text).encode("Some Words, Here", add_special_tokens=False).ids
    token_ids._tokenizers.clear()


# 3 and 5 ------------------------------------------------------------------------------------------------------------------
def test_quality_learns_and_survives_odd_input(spark):
    good = [words(i, 60) for i in range(150)]
    bad = [" ".join(f"JUNK{i % 7}!!" for i in range(60)) + str(k) for k in range(150)]
    df = docs(spark, [*good, *bad, None, ""], score="clash")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i < 150) for i in held) >= 0.95 * len(held)
    one = quality.fit(df, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(df, one).collect()} == {1.0}
    assert quality.score(df, quality.fit(df, labels.where("false"))).first()["score"] == 0.5
    assert quality.score(df.where("false"), model).count() == 0


def test_long_texts_ties_and_repeated_rows_of_classifiers(spark, monkeypatch):
    long = " ".join(words(i, 2000) for i in range(30))
    df = docs(spark, [long, "two words", "two words", long[:5000]])
    df = df.unionAll(df)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    rows = quality.score(df, quality.fit(df, labels)).collect()
    assert len(rows) == 8 and all(len({r["score"] for r in rows if r["text"] == t}) == 1 for t in {r["text"] for r in rows})
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()} == {("aa", 0.5)}
    logs = np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype(np.float32)
    whole = langid.log_likelihoods([long, "", "two words", long], logs)
    monkeypatch.setattr(langid, "SLICE", 100)
    assert np.allclose(whole, langid.log_likelihoods([long, "", "two words", long], logs)) and len(long) > 100_000


def test_langid(spark):
    en, es = ["the cat of thing and that", "el gato que tiene la cosa"]
    rows = [(i, (en if i % 2 else es) + f" {i}", "en" if i % 2 else "es", "s", 0) for i in range(80)] + [(100, None, "en", "s", 0), (101, "123 !!", None, "s", 0), (102, "", "es", "s", 0), (None, en, None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(df)
    got = [(r["doc_id"], r["lang"], r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()]
    assert len(got) == 84
    for i, lang, pred, s in got:
        assert 0 <= s <= 1
        assert pred == ("und" if i in (100, 101, 102) else lang or "en")
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.where("false"))).collect()} == {"und"}


# 4 ------------------------------------------------------------------------------------------------------------------------
def brute_hits(text, items, window=10):
    ws, hit, found = decontam.words_of(text or ""), set(), set()
    for item, t in items:
        b = decontam.words_of(t or "")
        for i in range(max(1, len(b) - window + 1)) if b else ():
            p = b[i : i + window]
            for j in range(len(ws) - len(p) + 1):
                if ws[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    items = [(1, words(1, 25, 30)), (2, "Short ITEM"), (3, None), (4, "..."), (5, words(1, 25, 30)[20:]), (6, "a a a a a a a a a a a a")]
    texts = [None, "", items[0][1], f"x {items[0][1].upper()} tail, short item", words(2, 300, 30), "a " * 40, "it was a short-item; short", "a a a a a a a a a a x a a a", f"{words(1, 12, 30)} q {items[0][1]}"]
    df, bench = docs(spark, texts, spans="clash", items=1), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find(df, bench, block_bytes=block).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], sum(b - a for a, b in r["spans"]), r["items"]) == brute_hits(texts[r["doc_id"]], items)
    clean = decontam.find(df, bench, block_bytes=1 << 20, clean=True).collect()
    assert all(brute_hits(r["text"], items)[1] == 0 for r in clean)
    assert {r["doc_id"]: r["text"] for r in clean}[4] == texts[4] or brute_hits(texts[4], items)[1]
    assert decontam.find(df, bench.where("false")).where("size(spans) > 0").count() == 0
    assert decontam.find(df.where("false"), bench).count() == 0


def test_cleaning_by_blocks(spark):
    w = [f"w{i}" for i in range(1, 20)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[7:])), (3, "left right"), (4, "short item")]
    texts = [" ".join(w), f"left {' '.join(w[:12])} right", f"a left {' '.join(w)} right b", "short left short item right item c", None, "", "nothing here"]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    whole = sorted(map(str, decontam.find(df, bench, clean=True).collect()))
    for block in (60, 1):
        got = decontam.find(df, bench, block_bytes=block, clean=True).collect()
        assert {r["doc_id"]: r["text"] and r["text"].split() for r in got} == {0: "", 1: "", 2: ["a", "b"], 3: ["c"], 4: None, 5: "", 6: ["nothing", "here"]}
        assert sorted(map(str, got)) == whole


# 6 ------------------------------------------------------------------------------------------------------------------------
def test_induced_sorting_equals_plain_sorting():
    r = random.Random(1)
    for _ in range(300):
        s = bytes(r.choice(r.choice([b"ab", b"abc", b"\0ab\xff", b"abcdefgh", b"a"])) for _ in range(r.randrange(60))) * r.randrange(1, 3)
        order, lcp = induced.suffix_array(np.frombuffer(s, np.uint8))
        want = sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023
        assert order.tolist() == want
        for a, b, k in zip(want, want[1:], lcp[1:].tolist()):
            assert s[a : a + k] == s[b : b + k] and s[a + k : a + k + 1] != s[b + k : b + k + 1]


def test_queues_on_disk(monkeypatch):
    s = np.frombuffer(words(4, 3000).encode(), np.uint8)
    whole = induced.suffix_array(s)
    monkeypatch.setattr(induced, "MEMORY", 1000)
    assert all((a == b).all() for a, b in zip(whole, induced.suffix_array(s)))


def test_a_shard_of_usual_size_uses_the_file(monkeypatch):
    import tempfile

    made, make = [], tempfile.mkstemp
    monkeypatch.setattr(tempfile, "mkstemp", lambda *a, **b: made.append(1) or make(*a, **b))
    s = np.random.default_rng(1).integers(97, 123, suffix_dedup.SHARD_BYTES, dtype=np.uint8)
    order, lcp = induced.suffix_array(s)
    assert made and (np.bincount(order, minlength=len(s)) == 1).all()
    at = np.random.default_rng(2).integers(1, len(s), 2000)
    raw = s.tobytes()
    for a, b, k in zip(order[at - 1].tolist(), order[at].tolist(), lcp[at].tolist()):
        assert raw[a : a + k] == raw[b : b + k] and raw[a + k : a + k + 1] < raw[b + k : b + k + 1]


@pytest.mark.parametrize("length", [401, 5000])
def test_long_lengths_are_counted_whole(spark, length):
    shared = words(70, 2000)[:6000]
    texts = ["a " + shared + " b", "c " + shared, "x" * 9000, words(71, 20_000)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(docs(spark, texts), length=length).collect()}
    assert [got[i] for i in range(4)] == [b"a b", b"c", b"", texts[3].encode()]
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs(spark, texts), length=40_000)


def brute_cut(raws, length):
    from collections import Counter

    n = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if n[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(r, gone) if not g))
    return out


def test_only_starts_that_may_repeat_are_sorted(monkeypatch):
    r, length = random.Random(5), 40
    text = lambda n: bytes(r.choice(b"ab\0c") for _ in range(n))
    same = text(60)
    contexts = [text(90) for _ in range(200)] + [same + text(30), text(7) + same + text(23), same + text(1), text(25) * 4]
    owned = [len(c) - length + 1 for c in contexts]
    owned[0] = 3
    seen: dict[bytes, int] = {}
    for c, n in zip(contexts, owned):
        for i in range(n):
            seen[c[i : i + length]] = seen.get(c[i : i + length], 0) + 1
    want = [[i for i in range(n) if seen[c[i : i + length]] > 1] for c, n in zip(contexts, owned)]
    sizes, sort = [], induced.suffix_array
    monkeypatch.setattr(induced, "suffix_array", lambda t, wanted=0: (sizes.append(len(t)), sort(t, wanted))[1])
    assert [x.tolist() for x in suffix_dedup.repeats_in_shard(contexts, owned, length)] == want and any(want)
    assert sizes and sizes[0] < 500  # of 18,000
    assert [len(x) for x in suffix_dedup.repeats_in_shard(contexts[:5], owned[:5], length)] == [0] * 5 and len(sizes) == 1
    monkeypatch.setattr(suffix_dedup, "_string_hashes", lambda t, at, length: np.zeros(len(at), np.uint64))  # all hashes clash
    assert [x.tolist() for x in suffix_dedup.repeats_in_shard(contexts, owned, length)] == want


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_suffix_dedup(spark, hot):
    common_text = words(5, 200)
    texts = [None, "", "short", common_text, "x " + common_text[7:] + " y", "é" * 500, "de " * 300, words(6, 150), words(6, 150) + "!", common_text, "\0" * 450]
    df = docs(spark, texts, spans=1)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(df, hot_bytes=hot).collect()}
    want = brute_cut([(t or "").encode() for t in texts], 400)
    assert [got[i] for i in range(len(texts))] == want
    twice = df.where("doc_id = 7").unionAll(df.where("doc_id = 7"))
    assert [bytes(r["kept"]) for r in suffix_dedup.dedup(twice).collect()] == [b"", b""]
    assert suffix_dedup.dedup(df.where("false")).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------------
def brute_groups(texts, shingle, percent=80):
    sets = []
    for t in texts:
        ws = (t or "").encode().translate(minhash._LOWER).split()
        sets.append({tuple(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))} if ws else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("shingle", [2, 5])
@pytest.mark.parametrize("block", [1500, 4])
def test_near_duplicates(spark, shingle, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, texts = random.Random(7), [None, "", " \n", "one", "One", "a b", "A  B", words(9, 3000)]
    for k in range(6):
        base = words(100 + k, 120).split()
        for _ in range(8):
            copy = base[:]
            for _ in range(r.randrange(9)):
                copy[r.randrange(len(copy))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs(spark, texts, key="clash", sig=1), shingle).collect()}
    want = brute_groups(texts, shingle)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i][1] == i) for i in got)


def test_one_large_group_makes_few_pairs(spark, monkeypatch):
    """5,000 near copies share their buckets: pairs stay in proportion to the copies, not to their square."""
    n, r = 5000, random.Random(11)
    base = words(12, 200, 5000).split()
    texts = []
    for i in range(n):
        copy = base[:]
        copy[r.randrange(200)] = f"z{i}"
        texts.append(" ".join(copy))
    made, call = [], minhash._Verifier.__call__
    monkeypatch.setattr(minhash._Verifier, "__call__", lambda self, pairs, *a, **b: made.append(pairs.count()) or call(self, pairs, *a, **b))
    got = minhash.near_duplicates(docs(spark, texts), 2)
    assert got.where("kept").count() == 1 and sum(made) <= 4 * n


def test_wide_signatures_bound_similarity():
    r = np.random.default_rng(3)
    for share in (0.5, 0.7, 0.8, 0.9):
        n = 2000
        both = int(n * 2 * share / (1 + share))
        x = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        assert abs(float((minhash.wide_signature(a) == minhash.wide_signature(b)).mean()) - share) < 0.06
    assert minhash.least_matches(1024, 80, 1e-5) < 0.8 * 1024 and minhash.least_matches(10, 100) == 10


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "a b c"), (2, "a b c"), (9, None)], "doc_id long, text string")
    got = sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in minhash.near_duplicates(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (3, 2, False), (9, 9, True)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    key = lambda i: bytearray(i.to_bytes(2, "big"))
    edges = [(key(i), key(i + 1)) for i in range(60)] + [(key(500), key(i)) for i in range(501, 600)]
    got = minhash.components(spark.createDataFrame(edges, "u binary, v binary"), common.workspace(spark)).collect()
    assert {int.from_bytes(r["root"], "big") for r in got} == {0, 500} and len(got) == 60 + 99


# 8 ------------------------------------------------------------------------------------------------------------------------
def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu", "h", 0) for i in range(10)] + [(20, None, "h", 0), (21, "", None, 0), (22, "menu\nx", "other", 0), (23, "menu", "h", 0), (23, "menu", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(df, ratio=0.5).orderBy("doc_id").collect()]
    assert got[:10] == [(i, f"own {i}\n", 4, 2) for i in range(10)]
    assert got[10:] == [(20, None, 0, 0), (21, "", 1, 0), (22, "menu\nx", 2, 0), (23, "", 1, 1), (23, "", 1, 1)]
    assert line_dedup.drop_lines(df.where("false")).count() == 0
    urls = spark.createDataFrame([("https://user@WWW.Example.org:80/a?b",), ("nothing",)], "u string")
    assert [r[0] for r in urls.select(line_dedup.host_of(F.col("u"))).collect()] == ["example.org", ""]


def test_copies_are_no_boilerplate(spark):
    import corpus_pipeline

    copied = "\n".join(["footer", *(words(900 + k, 12, 500) for k in range(5))])
    own = [f"footer\n{words(1000 + i, 40, 500)}" for i in range(200)]
    df = docs(spark, [copied] * 100 + own, source="h", n_chars=0)
    lines = corpus_pipeline.line_filter(spark, df, None)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t.removeprefix("footer\n") for i, t in enumerate([copied] * 100 + own)}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicate_filter(spark, lines, None).collect()}
    assert sorted(left) == [0, *range(100, 300)] and left[0] == copied.removeprefix("footer\n")


def test_line_dedup_of_clashing_names_long_texts_and_one_large_host(spark):
    long = "\n".join(words(300 + i, 50) for i in range(2000))
    rows = [(i, f"menu\nown {i}", "h", "a", "b", "c", "d") for i in range(20)] + [(99, long, "h", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _hashes string, _host string, _kept string, _LINES string")
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(df, ratio=0.5).collect()}
    assert got[99]["text"] == long and (got[99]["n_lines"], got[99]["n_dropped"]) == (2000, 0)
    assert all((got[i]["text"], got[i]["_hashes"], got[i]["_host"], got[i]["_kept"], got[i]["_LINES"]) == (f"own {i}", "a", "b", "c", "d") for i in range(20))


# 9 ------------------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    model = licenses.train([words(i, 12) for i in range(200)])
    texts = [None, "", words(1, 50), "Intro\nReleased under the MIT License.\nEnd", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "His driver's license expired, says the county.", words(2, 5000), "All rights reserved."]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts, licences="clash"), model).collect()}
    sure = [sorted(x["family"] for x in rows[i]["licences"] if x["confirmed"]) for i in range(len(texts))]
    assert sure == [[], [], [], ["mit"], ["gpl"], ["apache-2.0"], ["cc-by-nc"], [], [], ["proprietary"]]
    assert rows[3]["licences"][0]["line"] == 1 and rows[0]["n_paragraphs"] == 0 and rows[8]["n_paragraphs"] > 100
    assert licenses.scan(docs(spark, ["x"]).where("false"), model).count() == 0 and licenses.train([]).weights.any()


def test_licences_of_no_known_family_and_repeated_rows(spark):
    plain = [words(i, 12) for i in range(200)]
    model = licenses.train(plain)
    texts = ["Licensed under the Foo Public License, version 9", "This work is licensed under the Seaside Commons Licence 3.1", "This work is licensed under the GNU General Public License, version 3", words(3, 40)]
    df = docs(spark, [*texts, *texts])
    rows = {r["doc_id"]: [(x["family"], x["confirmed"]) for x in r["licences"]] for r in licenses.scan(df, model).collect()}
    assert [rows[i] for i in range(4)] == [[("unknown", False)], [("unknown", False)], [("gpl", True)], []] == [rows[i] for i in range(4, 8)]
    rng, found = np.random.default_rng(5), []
    for t in licenses.OTHERS[licenses.UNKNOWN_TRAINED :]:  # families that training never saw
        p = licenses._softmax(model.logits(licenses.variations(rng, t, [], 20)))
        best = p.argmax(1)
        found += [model.families[k] == "unknown" or (model.families[k] != "none" and p[i, k] < model.least) for i, k in enumerate(best)]
    assert sum(found) >= 0.7 * len(found)
    lines = licenses.sample_lines(docs(spark, ["b\na\n\n", "a\nc" * 2, None, "", *["same line"] * 50]), 10)
    assert sorted(lines) == ["a", "b", "c", "ca", "same line"] and licenses.sample_lines(docs(spark, ["x"]).where("false")) == []


# 10 -----------------------------------------------------------------------------------------------------------------------
def test_winnowing_matches_brute_force():
    r = random.Random(5)
    for n in [0, 1, 5, 11, 12, 13, 35, 36, 37, 300]:
        codes = winnowing.code_points("".join(r.choice("ab") for _ in range(n)))
        h, at = winnowing.winnow(codes)
        if n == 0:
            assert len(h) == 0
            continue
        every = winnowing.hashes(codes, min(winnowing.K, n)).tolist()
        w = min(winnowing.WINDOW, len(every))
        want = sorted({max(i for i in range(s, s + w) if every[i] == min(every[s : s + w])) for s in range(len(every) - w + 1)})
        assert at.tolist() == want and h.tolist() == [every[i] for i in want]


def test_winnowing_guarantee():
    shared = words(8, 8)[: winnowing.K + winnowing.WINDOW - 1]
    a, b = (winnowing.winnow(winnowing.code_points(words(i, 30) + shared + words(i + 50, 30)))[0] for i in (1, 2))
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprints_of_edited_texts(spark):
    texts = ["one two three four", None, "", "é" * 9, words(1, 300), words(1, 300), "z"]
    got = {r["doc_id"]: r for r in winnowing.with_next(docs(spark, texts, part=1, after=2), winnowing._digest, winnowing._SCHEMA).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        edited = t[: len(t) - len(t) // 4] + plain[(i + 1) % len(plain)][: len(t) // 4]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0 and got[4]["near_edited"] > 0.5
    one = winnowing.with_next(docs(spark, ["abcdefgh"]), winnowing._digest, winnowing._SCHEMA).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert winnowing.with_next(docs(spark, ["x"]).where("false"), winnowing._digest, winnowing._SCHEMA).count() == 0
    odd = spark.createDataFrame([(None, "b"), (1, "d"), (1, "c")], "doc_id long, text string")
    assert sorted(r["n_chars"] for r in winnowing.with_next(odd, winnowing._digest, winnowing._SCHEMA).collect()) == [1, 1, 1]
    assert winnowing.fingerprints(docs(spark, texts, fingerprint=3)).count() == len(texts)
