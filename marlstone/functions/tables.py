"""Table functions and scalar functions for SQL: register() makes them known to a session.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text) c
    SELECT p.page_id, x.* FROM pages p, LATERAL page_passages(p.html) x

chunk_text(text[, target[, most]]) gives a row (position, chunk) per chunk, page_passages(html) the same for the risk section of a page.
A null or empty text gives none. html_to_text(html) and risk_factors(text) are scalar. Rows are handed over in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from marlstone.functions import text as X


@udtf(returnType="position int, chunk string")
class ChunkText:
    def eval(self, text: str, target: int = 1200, most: int = 1800):
        yield from enumerate(X.chunks(text, target, most))


@udtf(returnType="position int, chunk string")
class PagePassages:
    def eval(self, html: str):
        yield from enumerate(X.chunks(X.risk_factors(X.html_to_text(html))))


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("page_passages", PagePassages)
    spark.udf.register("html_to_text", X.html_to_text_udf)
    spark.udf.register("risk_factors", X.risk_factors_udf)
