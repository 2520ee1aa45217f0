"""Extraction over documents as they arrive.

``extract_documents`` has no shuffle and no state, so the batch plan is the
streaming plan; exactly-once output comes from the query checkpoint.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_documents


def extract_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the extraction record of every new document to a Parquet folder."""
    return (extract_documents(documents).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
