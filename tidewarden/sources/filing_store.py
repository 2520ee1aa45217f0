"""Filings as a table laid out for its readers.

Folders by year and type, which the attribute filter prunes; inside them buckets by
ticker, so that filings and facts or holdings bucketed alike join without an exchange.
"""

from pyspark.sql import DataFrame, SparkSession

FOLDERS = ["fiscal_year", "filing_type"]
#: Rows of a bucket, which one task sorts: 100 MB of filings of two thousand characters.
BUCKET_ROWS = 50_000


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets for so many rows, so that a bucket stays small however many there are."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "ticker", buckets: int = 200,
                   folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` as the table ``table`` at ``path`` in ``buckets`` by ``key``; returns the table.

    Rows are dealt by bucket first, so a folder has at most one file a bucket.  ``buckets``
    is to be the same for all tables that are to be joined; some 200 MB a bucket are right.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def write_filings(filings: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Filings (ticker, fiscal_year, filing_type, text and more) in folders and buckets."""
    return write_bucketed(filings, table, path, "ticker", buckets, FOLDERS)


def open_filings(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table, where the session's catalog knows it; else its folders, which prune alike but hold no buckets."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.read.parquet(path)
