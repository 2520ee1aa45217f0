"""Readers for regulation documents and filing trees."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as C
from .stage import stage


def utf8_ignore(content: Column) -> Column:
    """Decode bytes as UTF-8 and leave out what is invalid."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text after the last dot; the whole name when there is none."""
    return F.substring_index(name, ".", -1)


def read_regulations(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """One row per file: name, extension, text (invalid bytes ignored).

    ``name``: of a file, from its column ``path``; by default the last part of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = _file_name(F.col("path")) if name is None else name
    return files.select(name.alias("name"), extension(name).alias("ext"),
                        utf8_ignore(F.col("content")).alias("text"))


#: Documents that a task writes as files: each costs a folder, a file and their entries, however short it is.
WRITTEN = 500


def write_documents(docs: DataFrame, path: str) -> None:
    """Columns name and text as one folder per name with files in it.

    Documents are dealt to tasks by their number, since by their size all would go to a few
    tasks; and each task moves its own folders to their place, not the driver one by one.
    """
    docs = stage(docs)
    (docs.repartition(docs.count() // WRITTEN + 1, "name").write
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(path))


def add_pasted(regulations: DataFrame, pasted: DataFrame) -> DataFrame:
    """Append pasted texts (column ``text``); blank ones are left out."""
    rows = pasted.filter(F.btrim("text") != "").select(
        F.lit("Manual Input").alias("name"), F.lit("txt").alias("ext"), "text")
    return regulations.select("name", "ext", "text").unionByName(rows)


def pick_filings(files: DataFrame, *more: str) -> DataFrame:
    """One file per ticker: a name that looks like an annual report first, then
    the first name in order.

    Input columns: ticker, name and ``more``, which come along.  Only names are aggregated, with a partial
    minimum per task, so no file content moves and a ticker with many files
    stays small.
    """
    mark = F.lower("name")
    other = ~(mark.contains(C.FILING_NAME_MARKS[0]) | mark.contains(C.FILING_NAME_MARKS[1]))
    return (files.groupBy("ticker").agg(F.min(F.struct(other.alias("other"), "name", *more)).alias("best"))
            .select("ticker", *[F.col(f"best.{c}").alias(c) for c in ("name", *more)]))


def _literal(path: str) -> str:
    """A listed path as one to read, without pattern characters."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_filings(spark: SparkSession, root: str, ticker: Column | None = None, name: Column | None = None) -> DataFrame:
    """The chosen filing of each ticker below ``root``: ticker, name, text.

    ``ticker`` and ``name``: of a file, from its column ``path``; by default files lie in
    ``<root>/<TICKER>/<file>``.  Files are chosen by their paths alone, without being
    opened; then only the chosen ones are read, so no content meets a join or a shuffle.
    The driver holds one path per ticker, as it does for any list of files that it reads.
    """
    named = {"ticker": F.element_at(F.split("path", "/"), -2) if ticker is None else ticker,
             "name": _file_name(F.col("path")) if name is None else name}
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
              .select("path").withColumns(named))
    chosen = pick_filings(listed, "path")
    paths = [_literal(r.path) for r in chosen.select("path").toLocalIterator()]
    empty = spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").load(paths) if paths else empty
    return files.withColumns(named).select("ticker", "name", utf8_ignore(F.col("content")).alias("text"))
