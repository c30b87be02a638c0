"""Whitening, collocations and media columns against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from marlstone.llm import collocations, common, media, queries, whitening


# 11 -----------------------------------------------------------------------------------------------------------------------
def exact_moments(x):
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - b for a, b in zip(row, s)] for row in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(len(s))] for i in range(len(s))]
    return n, d, np.array([[float(c) for c in r] for r in cov])


def check_whitening(rows, vectors):
    """rows of whiten() against exact whole numbers; vectors: (id, list of finite floats) that remain."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    n, d, cov = exact_moments(x)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = collections.defaultdict(list)
    z = (np.array(d, float) / n) @ u / np.sqrt(e)
    for (i, _), dev, zs in zip(vectors, d, z):
        want[i].append((sum(c * c for c in dev), zs))
    got = collections.defaultdict(list)
    for r in rows:
        got[r["vec_id"], r["component"]].append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-9)
    assert set(got) == {(i, k + 1) for i in want for k in range(len(e))}
    signs = {}
    for i in want:
        for k in range(len(e)):
            mine, theirs = sorted((r["deviation"], abs(r["whitened"])) for r in got[i, k + 1]), sorted((dev, abs(zs[k])) for dev, zs in want[i])
            assert [m[0] for m in mine] == [t[0] for t in theirs]
            assert [m[1] for m in mine] == pytest.approx([t[1] for t in theirs], rel=1e-6, abs=1e-9)
            if len(want[i]) == 1 and abs(want[i][0][1][k]) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(want[i][0][1][k] * got[i, k + 1][0]["whitened"]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_embeddings(spark, sf):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    check_whitening(queries.queries()["op11_whitening"](spark, sf).collect(), vectors)


def test_whitening_drops_what_is_no_vector_and_keeps_repeats(spark):
    r = random.Random(1)
    good = [(i % 40 if i % 9 else None, [r.gauss(0, 10 ** (k - 1)) for k in range(3)]) for i in range(80)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 2.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in [*good, *bad]], "vec_id long, embedding array<double>, component string, n int")
    check_whitening(whitening.whiten(df).collect(), good)


def test_whitening_without_variance_and_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 4.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in rows} == {(1, False), (2, True)} and all(r["identity_error"] < 1e-9 for r in rows)
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert len(one) == 2 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0


def test_double_double_keeps_what_doubles_lose():
    r = random.Random(2)
    x = np.array([[r.uniform(-1, 1) * 10.0 ** r.randint(-8, 8) for _ in range(3)] for _ in range(100)])
    zero = np.zeros_like(x)
    i, j = np.triu_indices(3)
    parts = [whitening.Moments.of((x[a : a + 7], zero[a : a + 7]), i, j) for a in range(0, 100, 7)]
    m = parts[0]
    for p in parts[1:]:
        m = m.join(p, i, j)
    mean = [sum(map(Fraction, c)) / 100 for c in x.T]
    for k, (a, b) in enumerate(zip(i, j)):
        want = sum((Fraction(p) - mean[a]) * (Fraction(q) - mean[b]) for p, q in zip(x[:, a], x[:, b]))
        got = Fraction(m.products[0][k]) + Fraction(m.products[1][k])
        assert abs(got - want) <= abs(want) * Fraction(1, 2**88)
    assert whitening.deviations(np.array([[1 << 40, 0]]), 1 << 20, [0, 0]) == [None] and whitening.deviations(np.array([[3, 5]]), 2, [4, 8]) == [8]


# 12 -----------------------------------------------------------------------------------------------------------------------
def plain_collocations(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    inside = collections.defaultdict(int)
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and inside[lang, p] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def odd_texts():
    r = random.Random(3)
    words = ["Ab", "ab", "ÉÉ", "x\x1cy", "c d", "e", "\x00f", "naïve", "日本", "~"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "! ", ":"]
    for i in range(60):
        text = "".join(r.choice(words[: 3 + i % 8]) + r.choice([" "] * 12 + ends) for _ in range(r.randint(1, 80)))
        yield text, r.choice(["en", "de", None, "und", ""])
    yield from [(None, "en"), ("", "en"), (" \t.\n", None), ("a b " * 20_000, "long"), ("same same same same", "en"), ("same same same same", "en")]


@pytest.mark.parametrize("least", [2, 7])
def test_collocations_of_odd_texts(spark, least):
    rows = list(odd_texts())
    df = spark.createDataFrame([(t, x, i, "z") for i, (t, x) in enumerate(rows)], "text string, lang string, n int, phrase string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(df, least=least).collect()))
    assert got == plain_collocations(rows, least)
    few = sorted(map(tuple, collocations.collocations(df, least=least, top=3).collect()))
    assert few == [x for x in got if x[1] <= 3]


def test_many_automata_and_small_counters_change_nothing(spark, monkeypatch):
    rows = list(odd_texts())
    df = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(map(tuple, collocations.counted(df, least=3)[0].collect()))
    monkeypatch.setattr(collocations, "AUTOMATON_BYTES", 900)
    monkeypatch.setattr(collocations, "HELD", 20)
    monkeypatch.setattr(collocations, "FLUSH", 500)
    assert sorted(map(tuple, collocations.counted(df, least=3)[0].collect())) == want and len(want) > 100


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------------
def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 100_000])
def test_pictures_round_trip(n):
    payload = media.payload_of(random.Random(n).randbytes(n))
    made = media.encode(payload)
    assert media.decode(made) == payload and len(payload) % 576 == 0 and payload
    assert media.header(made[: media.HEADER]) == {"width": 576, "height": len(payload) // 576, "bits": 8, "channels": 1}
    damaged = bytearray(made)
    damaged[len(made) // 2] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(damaged))


def test_media_of_documents(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = queries.queries()["op13_media"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        p = padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(p))
        assert (r["payload_sha256"], r["tail_crc32"], r["feature"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), media.feature(p))
        made = media.encode(p)
        assert (r["media_bytes"], r["media_sha256"], r["digest"]) == (len(made), hashlib.sha256(made).hexdigest(), hashlib.sha256(made).hexdigest())
        assert (r["width"], r["height"], r["media_length"]) == (576, len(p) // 576, len(made))


def test_each_text_is_stored_once_and_found_in_the_shards(spark, monkeypatch):
    monkeypatch.setattr(media, "REMEMBERED", 2)
    texts = [None, "", "a", "b", "a", "c" * 5000, None, "d", "a", "é" * 400_000, "é" * 400_000]
    df = spark.createDataFrame([(i if i % 4 else None, t, b"x", i) for i, t in enumerate(texts)], "doc_id long, text string, digest binary, N_BYTES int").repartition(4)
    folder = f"{common.workspace(spark)}/media"
    rows, index = media.store(df, folder)
    assert rows.columns == ["doc_id", "text", "digest", "n_bytes", "text_digest"] and rows.count() == len(texts)
    different = {t or "" for t in texts}
    assert index.count() == len(different)
    stored = {r["digest"]: bytes(r["media"]) for r in media.unpack(spark, folder).collect()}
    assert {d: hashlib.sha256(m).hexdigest() for d, m in stored.items()} == {d: d for d in stored} and len(stored) == len(different)
    assert {media.decode(m) for m in stored.values()} == {padded(t) for t in different}
    found = rows.select("doc_id", "text", "n_bytes", "text_digest").join(media.features(media.by_place(index), folder), "text_digest").collect()
    assert len(found) == len(texts)
    assert all(r["payload_sha256"] == hashlib.sha256(padded(r["text"])).digest() and r["n_bytes"] == len((r["text"] or "").encode()) for r in found)


def test_media_of_nothing(spark):
    folder = f"{common.workspace(spark)}/media"
    rows, index = media.store(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert rows.count() == index.count() == media.headers(media.by_place(index), folder).count() == 0
