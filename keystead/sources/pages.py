"""Stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystead import schemas
from keystead.operators.extract import decode_page
from keystead.sources.files import write_row_files


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str, charset: str = "utf-8", glob: str = "*.html") -> DataFrame:
    """Pages saved as files, decoded by charset; the path stands for the URL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("path").alias("url"), decode_page("content", charset).alias("html"), F.col("modificationTime").alias("ts")
    )


def write_page_files(pages: DataFrame, path: str, file: str = "file", html: str = "html") -> None:
    """Save pages as files in UTF-8, named by a column of distinct relative paths."""
    write_row_files(pages.select(F.col(file).alias("path"), F.encode(html, "utf-8").alias("content")), path)
