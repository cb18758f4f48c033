"""A corpus pipeline of five stages; each one's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.near_copies import one_of_each
from quillon.llm.op04_mixing import mix
from quillon.llm.op05_line_dedup import line_dedup
from quillon.llm.op07_bpe import bpe, vocabulary
from quillon.llm.op09_toxicity import toxicity
from quillon.plans.settle import discard, new_path, scratch, writer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go, but for one; n_chars follows the text."""
    out = line_dedup(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays:
    SimHash links, verified, then an exact join of what fingerprints keep apart."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the target weights; no document is taken twice."""
    return mix(docs, share=0.9, max_epochs=1).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of what they decode to."""
    return bpe(docs, **vocabulary(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: A trained classifier, XXH64 fingerprints and byte-level BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has settled for itself goes once its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            writer(made).parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
