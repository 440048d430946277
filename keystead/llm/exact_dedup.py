"""Exact duplicates by counting quotient filters.

Every task builds a counting quotient filter of its fingerprints: the leading bits
of a fingerprint (the quotient) choose a run, the run keeps the other bits (the
remainders) in order, and a repeated remainder has a counter.  A filter is cut into
blocks by ranges of quotients; the blocks of one range meet in one task, which
merges them by their sorted remainders without loss.  Fingerprints counted more
than once send their rows to a grouping by the bytes of the text itself.

Nulls: a null text counts as empty.  A null doc_id is larger than any other and can
stay when its group has no other row.  Of rows that repeat doc_id and text one stays.
An empty table gives no rows.  Other columns are ignored by `duplicate_rows` and
carried along by `distinct_rows`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import WHITE_SPACE, prefix_bitmap, routed, shuffle_shards, sorted_runs, text_or_empty
from keystead.session import stage

QUOTIENT_BITS = 28  # leading bits of a fingerprint that choose its run
ROUTE_BITS = 24  # leading bits of repeated fingerprints that send a row to verification
BLOCKS = "shard long, block binary"
HELD = 1 << 20  # fingerprints a task holds before it merges them into its filter


class CountingFilter:
    """Sorted runs of remainders by quotient, with a count each; fingerprints are uint64."""

    HEAD = struct.Struct("<BQQQ")

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, quotient_bits: int = QUOTIENT_BITS):
        self.quotients, self.remainders, self.counts, self.bits = quotients, remainders, counts, quotient_bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int = QUOTIENT_BITS) -> CountingFilter:
        values = np.sort(fingerprints.astype(np.uint64, copy=False))
        distinct, first = sorted_runs(values)
        counts = np.diff(np.append(first, len(values))).astype(np.int64)
        return cls._of_distinct(distinct, counts, quotient_bits)

    @classmethod
    def _of_distinct(cls, distinct: np.ndarray, counts: np.ndarray, bits: int) -> CountingFilter:
        low = np.uint64(64 - bits)
        return cls(distinct >> low, distinct & ((np.uint64(1) << low) - np.uint64(1)), counts, bits)

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(64 - self.bits)) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingFilter]) -> CountingFilter:
        """All runs put together in order of quotient and remainder; equal remainders add their counts."""
        keys = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # the parts are sorted: this merges runs
        distinct, first = sorted_runs(keys[order])
        sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        return cls._of_distinct(distinct, sums, filters[0].bits)

    def to_bytes(self) -> bytes:
        """Occupied quotients from the first one on, ends of runs, remainders, then the counters above one."""
        if not len(self.quotients):
            return self.HEAD.pack(self.bits, 0, 0, 0)
        base = int(self.quotients[0])
        occupied, first = sorted_runs(self.quotients)
        gaps = np.diff(occupied, prepend=occupied[:1]).astype(np.uint32)
        ends = np.zeros(len(self.quotients), dtype=np.uint8)
        ends[np.append(first[1:], len(ends)) - 1] = 1
        width = (64 - self.bits + 7) // 8
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        more = np.flatnonzero(self.counts > 1).astype("<u4")
        return b"".join((
            self.HEAD.pack(self.bits, base, len(ends), len(occupied)),
            gaps.astype("<u4").tobytes(), np.packbits(ends).tobytes(), np.ascontiguousarray(slots).tobytes(),
            more.tobytes(), self.counts[more].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingFilter:
        bits, base, n, runs = cls.HEAD.unpack_from(data)
        empty = np.zeros(0, dtype=np.uint64)
        if not n:
            return cls(empty, empty, np.zeros(0, dtype=np.int64), bits)
        at = cls.HEAD.size
        gaps = np.frombuffer(data, "<u4", runs, at)
        at += 4 * runs
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n)
        at += (n + 7) // 8
        width = (64 - bits + 7) // 8
        slots = np.zeros((n, 8), dtype=np.uint8)
        slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        repeated = (len(data) - at) // 12
        counts = np.ones(n, dtype=np.int64)
        counts[np.frombuffer(data, "<u4", repeated, at)] = np.frombuffer(data, "<i8", repeated, at + 4 * repeated)
        occupied = np.uint64(base) + np.cumsum(gaps).astype(np.uint64)
        run = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64)
        return cls(occupied[run], slots.view("<u8").ravel().astype(np.uint64), counts, bits)

    def split(self, shards: int) -> Iterator[tuple[int, CountingFilter]]:
        """Blocks by equal ranges of quotients."""
        shift = np.uint64(self.bits - (shards.bit_length() - 1))
        for shard, begin, end in _ranges((self.quotients >> shift).astype(np.int64)):
            yield shard, CountingFilter(self.quotients[begin:end], self.remainders[begin:end], self.counts[begin:end], self.bits)


def _ranges(shard_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    values, first = sorted_runs(shard_of)
    for value, begin, end in zip(values.tolist(), first.tolist(), [*first.tolist()[1:], len(shard_of)]):
        yield value, begin, end


def partition_filters(fingerprints: DataFrame, column: str = "fp", shards: int | None = None) -> DataFrame:
    """(shard, block): one counting filter per task over a long column, cut into blocks."""
    shards = shards or shuffle_shards(fingerprints.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return filter_blocks((b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), shards)

    return fingerprints.select(F.col(column).cast("long")).mapInArrow(build, BLOCKS)


def filter_blocks(parts: Iterator[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one task's filter over arrays of uint64 fingerprints."""
    held, waiting, n = [], [], 0
    for part in parts:
        waiting.append(part)
        n += len(part)
        if n >= HELD:
            held = [CountingFilter.merged([*held, CountingFilter.of(np.concatenate(waiting))])]
            waiting, n = [], 0
    if n:
        held.append(CountingFilter.of(np.concatenate(waiting)))
    if held:
        for shard, block in CountingFilter.merged(held).split(shards):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "block": pa.array([block.to_bytes()], pa.binary())})


def merge_filters(blocks: DataFrame) -> DataFrame:
    """(shard, block, n_distinct, n_total): the blocks of each range of quotients merged."""

    def merge(group: pa.Table) -> pa.Table:
        whole = CountingFilter.merged([CountingFilter.from_bytes(b) for b in group.column("block").to_pylist()])
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "block": pa.array([whole.to_bytes()], pa.binary()),
            "n_distinct": pa.array([len(whole.counts)], pa.int64()), "n_total": pa.array([int(whole.counts.sum())], pa.int64()),
        })

    return blocks.groupBy("shard").applyInArrow(merge, "shard long, block binary, n_distinct long, n_total long")


def repeated_fingerprints(merged: DataFrame) -> DataFrame:
    """(fp, n): fingerprints that the merged filters count more than once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                whole = CountingFilter.from_bytes(data)
                more = whole.counts > 1
                yield pa.RecordBatch.from_pydict({"fp": pa.array(whole.fingerprints()[more].view(np.int64)), "n": pa.array(whole.counts[more])})

    return merged.select("block").mapInArrow(read, "fp long, n long")


def recurring_bits(blocks: DataFrame, bits: int) -> bytes:
    """A bitmap of the leading bits of fingerprints that the filters of all tasks count more than once."""
    slots = prefix_bitmap(repeated_fingerprints(merge_filters(blocks)), "fp", bits).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("word").to_numpy()
    return out.tobytes()


def in_bits(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which uint64 fingerprints a bitmap (as uint64 words) has."""
    at = fingerprints >> np.uint64(64 - (6 + len(bitmap).bit_length() - 1))
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def normalised(column: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(text_or_empty(column), WHITE_SPACE, "")


def _routes(fingerprints: DataFrame, shards: int | None) -> DataFrame:
    merged = merge_filters(partition_filters(fingerprints, "fp", shards))
    return stage(prefix_bitmap(repeated_fingerprints(merged), "fp", ROUTE_BITS), "repeated")


def duplicate_rows(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of (doc_id, text).

    Texts are equal when their bytes are, after white space is deleted.  The row with
    the most code points in its own text stays, then the smallest doc_id.
    """
    rows = docs.select("doc_id", "text")
    light = stage(
        rows.select("doc_id", F.char_length(text_or_empty()).alias("n"), normalised().alias("norm"))
        .select("doc_id", "n", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    repeated = _routes(light.select("fp"), shards)
    # the bytes decide: one row a text, folded in each task before any text moves
    texts = rows.select(normalised().alias("norm")).select(F.xxhash64("norm").alias("fp"), "norm")
    classes = (
        routed(texts, "fp", repeated, ROUTE_BITS)
        .groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("fp", F.sha2("norm", 256).alias("sha"), "size")
    )
    best = (
        routed(light, "fp", repeated, ROUTE_BITS)
        .groupBy("fp", "sha")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("best"))
    )
    groups = stage(
        classes.join(best, ["fp", "sha"])
        .select(F.col("fp").alias("g_fp"), F.col("sha").alias("g_sha"), "size", F.col("best.doc_id").alias("g_id"), F.col("best.row").alias("g_row")),
        "groups",
    )
    single = F.col("g_row").isNull()
    return light.join(groups, (F.col("fp") == F.col("g_fp")) & (F.col("sha") == F.col("g_sha")), "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("g_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("g_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows whose fingerprint the filters count once pass without a shuffle; only the
    others are grouped by the bytes of their texts, folded in each task first.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("all"), F.col("doc_id").alias("id"), F.col("text").alias("txt"))
    whole = whole.withColumn("norm", normalised("txt")).withColumn("fp", F.xxhash64("norm"))
    repeated = _routes(whole.select("fp"), shards)
    once = routed(whole.select("all", "fp"), "fp", repeated, ROUTE_BITS, keep=False).select("all.*")
    order = F.struct((-F.char_length(F.coalesce("txt", F.lit("")))).alias("n"), F.col("id").isNull().alias("no"), F.col("id"))
    best = (
        routed(whole, "fp", repeated, ROUTE_BITS)
        .groupBy("fp", "norm").agg(F.min_by("all", order).alias("all"))
        .select("all.*")
    )
    return once.unionByName(best)
