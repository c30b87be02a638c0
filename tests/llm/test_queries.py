"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontam, queries


@pytest.fixture(scope="module")
def rows(sf):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op11_whitening", "op12_collocations"}))
def test_one_row_per_document(spark, sf, rows, name):
    got = [r["doc_id"] for r in queries.queries()[name](spark, sf).select("doc_id").collect()]
    assert sorted(got) == sorted(rows)


def test_rows_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in res.fetchall())


def test_digests_equal_plain_ones(spark, sf, rows):
    import public_tokenizers as P
    import tiktoken

    from marlstone.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in queries.queries()["op2_byte_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_token_id_digests(spark, sf, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r in queries.queries()["op1_token_ids"](spark, sf).orderBy("doc_id").collect():
        ids = [*tok.encode(rows[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns, df = before.columns, before
    n = [df.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, sf).write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        n.append(df.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == columns
        if name == "decontaminate":
            found = decontam.find(df, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert found.where("size(spans) > 0").count() == 0
    assert n[0] > n[1] == n[2] > n[3] == n[4] == n[5]
    assert df.where(~F.col("round_trip")).count() == 0
    whole = corpus_pipeline.run(spark, sf)
    assert whole.exceptAll(df).count() == 0 and df.exceptAll(whole).count() == 0
