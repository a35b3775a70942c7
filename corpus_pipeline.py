"""A corpus pipeline of five operators: quality rules, near-dedup, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results, in every stage: a null text is an empty one, has no words and goes in the first stage; null ids, sources and
other columns stay as they are; of rows that are equal in id and text near-dedup keeps one; ties are settled by id, then by a hash of
the row; columns beside those of documents come through whatever their names, in all stages but the last; an empty table gives
no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import best_fit_packing, quality_rules, secret_scan, simhash_dedup, source_mix
from wayfold.llm.common import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows the text; no document goes."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from not at all to twice, in the order of the schedule."""
    return source_mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, first, size, bin, offset, capacity): where each piece of a document goes."""
    return best_fit_packing.pack(docs)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("secret_scan", secrets), ("source_mix", mix), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what a stage returns is kept in the checkpoint folder that all executors share."""
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The forest, the shuffle by hash and the packing have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None
