"""Documents to token ids: quality, boilerplate lines, near duplicates, benchmark passages, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before has kept and returns the columns of
`documents` (the last one adds ids). Where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, common, decontam, line_dedup, minhash, quality

BROADCAST_IDS = 1_000_000
#: Entries of the encoder's caches: the stages before leave less memory than the encoder has alone.
REMEMBERED = 150_000
#: A line leaves a source if it stands on more than this share of its texts and on so many at least, near copies counted by classes:
#: a group of near copies of any size then keeps its lines for the stage after, which keeps one of them.
LINE_RATIO = 0.1
LINE_LEAST = 10
LINE_CLASSES = 3

#: SQL has no compression, no MinHash and no BPE: the stages are tested one by one against plain Python instead.
ORACLE_SQL = None


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with its columns but `used` packed into one, so that no operator's own columns can meet them; and what unpacks a result
    to the columns of docs; with recount, n_chars is counted again where there is one."""
    others = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("kept_apart")] if others else []))

    def back(out: DataFrame, recount: bool = True) -> DataFrame:
        cols = {c: F.col(c) if c in used else F.col("kept_apart").getField(c) for c in docs.columns}
        if recount and "n_chars" in others:
            cols["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        return out.select(*[cols[c].alias(c) for c in docs.columns])

    return packed, back


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored as empty texts, very long ones piece by piece; null ids are never learned from; rows that tie at
    the threshold stay; repeated rows get the same decision; an empty table gives an empty one. Without labels of both kinds all
    rows have one score, so all stay or none."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    packed, back = _apart(docs, "doc_id", "text")
    return back(quality.score(packed, model).where(F.col("score") >= quality.THRESHOLD), recount=False)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; exact copies, which are still there, count as one page, and near
    copies as few (LINE_CLASSES).

    Null texts stay null and empty ones empty; a text may become empty and stays; a null source is a source of its own; a line whose
    share ties with the limit stays; repeated rows and ids are copies; an empty table gives an empty one."""
    packed, back = _apart(docs, "doc_id", "text", "source")
    return back(line_dedup.drop_lines(packed, ratio=LINE_RATIO, least=LINE_LEAST, once=True, alike=LINE_CLASSES))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id and a text are one document. Null, empty and wordless texts are in no group and stay; so do rows with a null
    id, once per text; very long texts are compared whole; pairs of similarity 0.8 exactly belong together; an empty table gives an
    empty one."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    work = common.workspace(spark)
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), work=work).where(~F.col("kept")).select("doc_id").distinct()
    gone = common.saved(gone, f"{work}/gone")
    minhash.forget(spark, work)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items they hold.

    Null texts stay null; a text that is all passage becomes empty and stays; very long texts are searched whole; items that
    overlap or tie lose one span together; repeated rows are cut alike; an empty table or benchmark changes nothing."""
    packed, back = _apart(docs, "doc_id", "text")
    return back(decontam.find(packed, common.table(spark, sf_dir, "benchmark"), clean=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and whether they decode to its text.

    Null and empty texts have no ids; very long ones are encoded whole; rows are independent, repeated ones too; an empty table
    gives an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, back="round_trip", remembered=REMEMBERED)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality_filter), ("line_dedup", line_filter), ("near_dedup", near_duplicate_filter), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    work = common.workspace(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = common.saved(stage(spark, docs, sf_dir), f"{work}/{name}")
        if i:
            common.forget(spark, f"{work}/{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
