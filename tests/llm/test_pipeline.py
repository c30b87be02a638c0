"""Every stage of the pipeline with nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def words(seed, n, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


NAMES = "doc_id long, text string, lang string, source string, n_chars long, score string, _hashes string, _host string, _kept string, n_lines string, n_dropped string, spans string, items string, n_words string, key string, sig string, ids string, decoded string, kept_apart string"
LONG = "\n".join(words(50 + i, 4000) for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [words(i, 60) for i in range(12)] + [None, "", " \n ", LONG, words(1, 60), words(1, 60)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "") or None, *("mine" if i % 4 else None for _ in range(14))) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, words(2, 60), None, None, None, *[None] * 14), (None, None, None, None, None, *[None] * 14), (None, None, None, None, None, *[None] * 14)]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    passage = " ".join(words(5, 60).split()[20:40])
    spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "never there at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, folder, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, folder)
    rows = got.collect()
    if name == "encode":
        assert len(rows) == odd.count() and all(r["round_trip"] for r in rows) and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (12, 13))
        return
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    mine = {(r["doc_id"], *(r[c] for c in odd.columns[5:])) for r in odd.collect()}
    assert {(r["doc_id"], *(r[c] for c in odd.columns[5:])) for r in rows} <= mine
    if name in ("line_dedup", "decontaminate"):
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    else:
        assert {(r["doc_id"], r["text"], r["n_chars"]) for r in rows} <= {(r["doc_id"], r["text"], r["n_chars"]) for r in odd.collect()}
    n = {i: sum(r["doc_id"] == i for r in rows) for i in (1, 3, 12, 13, 14, 15, 16, 17, None)}
    if name in ("line_dedup", "decontaminate"):
        assert n == {1: 1, 3: 3, 12: 1, 13: 1, 14: 1, 15: 1, 16: 1, 17: 1, None: 3}
    if name == "near_dedup":
        assert n == {1: 1, 3: 1, 12: 1, 13: 1, 14: 1, 15: 1, 16: 0, 17: 0, None: 2}
    text = {r["doc_id"]: r["text"] for r in rows}
    if name == "decontaminate":
        assert text[15] == LONG and len(text[5].split()) == 40 and text[12] is None
    if name == "line_dedup":
        assert text[12] is None and text[13] == ""


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, odd, folder, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.where("false"), folder).count() == 0


def test_only_the_four_columns(spark, odd, folder):
    docs = odd.select("doc_id", "text", "source")
    for name, stage in corpus_pipeline.STAGES:
        docs_after = stage(spark, docs, folder)
        assert name == "encode" or docs_after.columns == docs.columns


def test_without_labels_all_documents_have_one_score(spark, odd, folder, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_filter(spark, odd, str(tmp_path)).count() == odd.count()


def test_rows_that_are_there_twice_end_once(spark, folder):
    once = spark.createDataFrame([(i, words(i, 80), "en", "s", 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_filter(spark, once.unionAll(once), folder)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40))


def test_working_tables_go(spark, odd, folder):
    from marlstone.llm import common

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/marlstone")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def tables():
        out, it = set(), fs.listFiles(path, True)
        while it.hasNext():
            p = it.next().getPath().toString()
            if p.endswith(".parquet"):
                out.add(p.rpartition("/")[0].rpartition("/")[2])
        return out

    before = tables()
    corpus_pipeline.near_duplicate_filter(spark, odd, folder).count()
    corpus_pipeline.quality_filter(spark, odd, folder).count()
    assert tables() - before <= {"gone"}
    assert odd.where(F.col("doc_id") == 1).count() == 1


def near_copies(n, group):
    """n texts of twelve lines, alike but for a word in each of two lines."""
    base = [words(900 + 20 * group + j, 12) for j in range(12)]
    out = []
    for i in range(n):
        r, lines = random.Random(1000 * group + i), list(base)
        for j in r.sample(range(12), 2):
            w = lines[j].split()
            w[r.randrange(12)] = f"x{group}y{i}"
            lines[j] = " ".join(w)
        out.append("\n".join(lines))
    return out


def test_near_copies_keep_their_lines_and_boilerplate_goes(spark, folder):
    banner = "all rights reserved by the site and its owners"
    own = ["\n".join([words(3000 + i, 40), *([banner] if i % 2 else []), words(5000 + i, 40)]) for i in range(120)]
    copies = near_copies(90, 1) + near_copies(12, 2)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(copies + own)], "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.line_filter(spark, docs, folder)
    text = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(text[i] == t for i, t in enumerate(copies))
    assert all(text[i + len(copies)] == t.replace(banner + "\n", "") for i, t in enumerate(own))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_filter(spark, after, folder).collect()}
    assert set(range(102, 222)) <= kept and 0 in kept and 90 in kept
