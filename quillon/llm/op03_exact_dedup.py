"""Exact dedup with the frequent digests split off.

A Misra-Gries summary (Spark's ``approx_top_k``: counters that are decremented together when the
summary is full, merged across partitions) proposes frequent digests. Exact counts verify them, and
the verified ones, at most ``capacity`` rows, are broadcast: their copies are settled map-side and
never shuffled. The remaining digests, none of them frequent, take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.settle import settle


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, capacity: int = 1024, min_copies: int = 16) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise`` (a function of a Column; none by default);
    a null text counts as empty. Of equal texts the largest id stays. A null id never beats another
    id; where a whole group has null ids, keep_id is null and all its rows are kept. Rows that repeat
    both id and text are one document: all of them have the same ``kept``. An empty table gives no
    rows. Other columns are ignored, whatever their names.

    ``capacity`` bounds both the summary and the broadcast; digests it misses take the shuffle, so it
    affects speed only. ``min_copies``: a verified winner has at least so many rows.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    digests = settle(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalise(text) if normalise else text, 256).alias("text_sha256")))

    proposed = digests.agg(F.expr(f"approx_top_k(text_sha256, {capacity}, {8 * capacity})").alias("top"))
    proposed = proposed.select(F.explode("top").alias("t")).where(F.col("t.count") >= min_copies).select(F.col("t.item").alias("text_sha256"))
    group = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = settle(digests.join(F.broadcast(proposed), "text_sha256").groupBy("text_sha256").agg(*group).where(F.col("group_size") >= min_copies))

    hot = digests.join(F.broadcast(winners), "text_sha256")
    cold = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    cold = cold.join(cold.groupBy("text_sha256").agg(*group), "text_sha256")
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
