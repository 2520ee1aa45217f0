"""Training corpus from ``documents``: classify, near-dedup, redact, mix, pack.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
between stages a table is written to the shared folder and read back.  An empty table
gives an empty one; further columns go along until the last stage.
"""

from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import packing, quality_perplexity, secret_scan, simhash_dedup, source_mixing
from tidewarden.sources.stage import stage

#: Contract of the near-dedup stage.
SHINGLE, MAX_BITS = 3, 2


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's threshold allows; those without text go.

    Rows that share an id go only where all are rejected; rows without one are judged together.
    """
    return quality_perplexity.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; one row of a repeated id; rows without one stay."""
    return simhash_dedup.keep_one(docs, SHINGLE, MAX_BITS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced; null texts stay null."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix deals it; a null source is a source."""
    return source_mixing.resampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece, with its sequence and place there; a null text has the end token only, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", dedup), ("secret_scans", redact),
          ("mixing_sources", mix), ("best_fit_packing", pack)]

#: Perplexity, fingerprints and tokens are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
