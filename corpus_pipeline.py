"""The corpus pipeline: from raw documents to encoded, unique, uncontaminated ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of ``documents``; columns beyond those are kept, whatever
their names.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, common, decontam, exact_dedup, lang_id, queries, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones teach go: no text, no letter in it, or n-grams that no language's filter holds.

    So null and empty texts go; a null id or language, repeated rows and very long texts make no difference.
    """
    common.small_batches(spark)
    return lang_id.keep_known(docs, lang_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the most code points, then the smallest id (null last), then any one.

    Null counts as the empty text.  Rows are told apart even where ids repeat.
    """
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest id (null last), then any one.

    Null, empty and blank texts are near copies of each other.  Rows are told apart even where ids repeat.
    """
    common.small_batches(spark)
    return simhash.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; null, empty and wordless items are held by none.  Each row is judged on its own.
    """
    common.small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.drop_leaks(docs, decontam.fit(docs, benchmark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, encoded: doc_id, token counts and digests of ids and of the decoded text.

    One row per row, null ids and repeated rows included; a null text has no tokens.
    """
    common.small_batches(spark)
    return bpe.encode_decode(docs, queries.vocabulary(), want=("ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("bpe", encoding)]

#: SQL can't express SimHash, latent retrieval or BPE; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
