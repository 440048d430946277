"""Runs of activity in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def activity_cells(df: DataFrame, by: list[str], ts: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """(by, _cell, _first, _last, _n): rows folded into cells as wide as the gap."""
    cell = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (gap_seconds * 1000000))
    return df.groupBy(*by, cell.alias("_cell")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))


def sessions_of_cells(cells: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """Sessions per key from its cells, each cell once."""
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    w = Window.partitionBy(*by).orderBy("_cell")
    opens = F.when(F.col("_first") <= F.lag("_last").over(w) + gap, 0).otherwise(1)
    numbered = cells.withColumn("_open", opens).withColumn(
        "_session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*by, "_session").agg(
        F.min("_first").alias("started"), (F.max("_last") + gap).alias("ended"), F.sum("_n").alias("n")
    ).drop("_session")


def activity_sessions(df: DataFrame, by: list[str], ts: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """Sessions per key: (by, started, ended, n), split where nothing happened for longer than the gap.

    Rows are first folded into cells as wide as the gap.  All rows of a cell are
    less than the gap apart, so they belong to one session, and a key never has
    more rows than its time span has cells, however hot it is.
    """
    return sessions_of_cells(activity_cells(df, by, ts, gap_seconds), by, gap_seconds)
