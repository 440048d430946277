"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space and the letters of the contracts, in natural order.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

LONG_TEXT = 1 << 22  # bytes of a text that is taken in pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def shuffle_shards(spark: SparkSession) -> int:
    """A power of two not below the shuffle partitions, which the cluster sets by its data."""
    return power_of_two(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def pieces(data: bytes, size: int = LONG_TEXT) -> Iterator[bytes]:
    """data cut at white space into pieces of about size bytes; no word is cut."""
    start = 0
    while len(data) - start > size:
        window = data[start : start + size]
        cut = max(window.rfind(c.encode()) for c in WHITE_SPACE)
        if cut < 0:  # one word longer than a piece
            cut = min((p for p in (data.find(c.encode(), start) for c in WHITE_SPACE) if p >= 0), default=len(data))
            cut -= start
        yield data[start : start + cut + 1]
        start += cut + 1
    yield data[start:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_chunks(text: str) -> Iterator[str]:
    """The text itself if it is short, else pieces cut at white space."""
    if len(text) <= LONG_TEXT // 4:
        yield text
    else:
        yield from (p.decode("utf-8", "replace") for p in pieces(text.encode("utf-8", "replace")))


def prefix_bitmap(fingerprints: DataFrame, column: str, bits: int) -> DataFrame:
    """(slot, word): the set of the leading `bits` bits of a long column, 64 to a row.

    At most 2 ** (bits - 6) rows whatever the input, so it may be broadcast.  It says
    yes to every fingerprint of the input and to few others.
    """
    prefix = F.shiftrightunsigned(F.col(column), 64 - bits)
    return (
        fingerprints.select(F.shiftrightunsigned(prefix, 6).alias("slot"), prefix.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("slot")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
    )


def routed(rows: DataFrame, column: str, bitmap: DataFrame, bits: int, keep: bool = True) -> DataFrame:
    """The rows whose leading bits are in the bitmap, or the others with keep=False.

    The bitmap is broadcast: `prefix_bitmap` bounds it by 2 ** (bits - 6) rows.
    """
    names = rows.columns
    own = bitmap.select(F.col("slot").alias("_slot"), F.col("word").alias("_word"))
    prefix = F.shiftrightunsigned(F.col(column), 64 - bits)
    marked = rows.withColumn("_at", F.shiftrightunsigned(prefix, 6)).join(F.broadcast(own), F.col("_at") == F.col("_slot"), "left")
    bit = F.expr(f"coalesce(getbit(_word, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int)), 0)")
    return marked.where(bit == (1 if keep else 0)).select(*[F.col(f"`{n}`") for n in names])


def sorted_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], first
