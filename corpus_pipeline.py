"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on, with the columns of
``documents``; the last gives the digests of ids and decoded bytes. Rows with a null text go in the first stage (no words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, mixing, neardup, quality, queries, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least id."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of earlier passages; a document of which nothing is left goes. n_chars follows the text."""
    columns = docs.columns
    kept = substring.without_repeats(docs).filter("text <> ''")
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every pass that takes it, in training order."""
    return mixing.mix(docs, carry=True).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    ranks = queries.byte_ranks(spark)
    return queries.digests(bpe.encoded(docs, ranks), ranks)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mixed_sources), ("byte-level BPE", byte_bpe)]

#: Near-duplicate classes are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    from emberline.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
