"""Scores of regulations as they arrive.

Each batch of documents is extracted and scored against written tables of holdings and
facts.  A batch writes a folder of its own number and replaces it when it is run again
after a stop, so every document is scored once.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract as E
from ..plans import impact as I
from ..sources.stage import released, stage


def score_stream(documents: DataFrame, holdings: DataFrame, facts: DataFrame, out: str, checkpoint: str,
                 coverage: DataFrame | None = None) -> StreamingQuery:
    """Score every new document (reg_id, portfolio_id, name, ext, text) below ``out``.

    ``holdings``, ``facts`` and ``coverage`` are written tables, read anew by each batch; with
    ``coverage`` documents come without a portfolio.  A document that arrives twice is
    scored twice.  The work tables of a batch are removed with its end.
    """
    def score(batch: DataFrame, number: int) -> None:
        with released():
            documents_ = batch if coverage is None else batch.drop("portfolio_id")
            regs = stage(E.extract_documents(documents_))
            scored = I.full_impact(holdings, regs, facts, coverage=coverage)
            scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (documents.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """All scores written so far, with the number of their batch."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")
