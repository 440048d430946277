"""Crawl logs, error pages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keystead import schemas
from keystead.functions.text import extract, strip
from keystead.sources.files import read_row_files, write_row_files


def append_crawl_log(rows: DataFrame, path: str) -> None:
    """Append log rows as JSON lines, one folder per day."""
    rows.withColumn("date", F.date_format("timestamp", "yyyyMMdd")).write.mode("append").partitionBy("date").json(path)


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CRAWL_LOG).json(path).drop("date")


def crawl_log_rows(url: Column, ok: Column, model: Column, error: Column, ts: Column) -> list[Column]:
    """Columns of a log row: SUCCESS or FAILURE with the error text."""
    return [
        ts.alias("timestamp"), url.alias("url"),
        F.when(ok, "SUCCESS").otherwise("FAILURE").alias("status"), model.alias("model"),
        F.when(~ok, error.cast("string")).alias("error"),
    ]


def meta_field(text: Column | str, name: str) -> Column:
    """Value of a ``Name: value`` line; "unknown" when there is no such line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(strip(extract(text, rf"(?m)^{name}:(.*)$")), F.lit("unknown"))


def read_error_pages(spark: SparkSession, path: str) -> DataFrame:
    """Error-page notes: source folder, file, URL, reason and time.

    A note without a time takes the time of its file.
    """
    notes = read_row_files(spark, path, "_meta.txt").withColumnRenamed("content", "value")
    name = F.col("path")
    stamp = F.try_to_timestamp(meta_field("value", "Timestamp"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return notes.select(
        F.regexp_extract(name, "([^/]+)/[^/]+$", 1).alias("company_type"),
        F.regexp_replace(F.regexp_extract(name, "([^/]+)$", 1), "_meta\\.txt$", ".html").alias("file"),
        meta_field("value", "URL").alias("url"),
        meta_field("value", "Reason").alias("reason"),
        F.coalesce(stamp, F.col("modified")).alias("ts"),
    )


def write_error_pages(errors: DataFrame, path: str) -> None:
    """Write error rows (see ``extract.error_rows``) as notes, one file each: folder/file_meta.txt."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")), F.lit("\n"))
    note = F.concat(
        line("URL", F.col("url")), line("Reason", F.col("reason")),
        F.when(F.col("ts").isNull(), "").otherwise(line("Timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))),
    )
    write_row_files(errors.select(F.concat("company_type", F.lit("/"), "file", F.lit("_meta.txt")).alias("path"), note.alias("content")), path)


def append_prediction_errors(errors: DataFrame, path: str) -> None:
    """Append prediction errors as CSV."""
    errors.write.mode("append").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write an aggregate as JSON; a report has a row per source, so one file."""
    report.coalesce(1).write.mode("overwrite").json(path)
