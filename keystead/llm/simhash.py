"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is set when it is set in over half of the hashes of a text's word
shingles.  Tables of structured masks find the pairs within the radius: bit i gets a
vector m(i) of three bits, and the table of a vector v keeps the bits with
<m(i), v> = 1.  Two positions span at most two dimensions of three, so some v is
orthogonal to both: every pair that differs in two bits or fewer agrees under one of
the seven masks.  Masks keep four bits in seven, so buckets stay small.

Inside a bucket no pairs are listed.  Two members share their only difference when
the bucket has two; larger buckets are linked through common neighbours: members at
distance two or less have a fingerprint within one bit of both, and members that
share one are at distance two or less.  A neighbour has 64 members around it at most.

Nulls: a null or blank text has fingerprint zero.  Null doc_ids are ignored by the
minimum; a component of nulls only has a null component_id.  Repeated rows come back
as often as they came.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import pieces, text_or_empty
from keystead.llm.graph import components
from keystead.session import stage

RADIUS = 2
SHINGLE = 3
SEED = 42
COUNTED = 1 << 15  # shingles whose bits are counted at once


def _set_bits(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; long texts are taken in pieces."""
    counts, n, carry, digest = np.zeros(64, dtype=np.int64), 0, [], xxhash.xxh64_intdigest
    for piece in pieces(text.encode("utf-8", "replace").lower()):
        words = carry + piece.split()
        carry = words[-(shingle - 1):] if shingle > 1 else []
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        for at in range(0, len(words) - shingle + 1, COUNTED):
            stop = min(at + COUNTED, len(words) - shingle + 1)
            hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts[at:stop], ends[at + shingle - 1 : stop + shingle - 1])]
            counts += _set_bits(hashes)
            n += len(hashes)
    if not n and carry:
        counts, n = _set_bits([digest(b" ".join(carry), seed)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, key (hash of the text), fp (the fingerprint as a signed long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(work, "doc_id long, key long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks, as signed longs, one of which misses any `radius` bits."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if (((i % vectors) + 1) & v).bit_count() & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def near_links(prints: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all within two bits.

    The table they are read from is added to ``held``, for the caller to release.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(covering_masks())])
    keyed = prints.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    buckets = stage(
        keyed.groupBy("t", "k")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("varying"))
        .where("n > 1"),
        "buckets",
    )
    if held is not None:
        held.append(buckets)
    twos = buckets.where((F.col("n") == 2) & (F.bit_count("varying") <= RADIUS)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = buckets.where("n > 2").select(F.col("t").alias("bt"), F.col("k").alias("bk"), "varying")
    members = keyed.join(large, (F.col("t") == F.col("bt")) & (F.col("k") == F.col("bk"))).groupBy("fp").agg(F.expr("bit_or(varying)").alias("varying"))
    flips = F.expr("concat(array(fp), transform(filter(sequence(0, 63), i -> getbit(varying, i) = 1), i -> fp ^ shiftleft(1L, i)))")
    around = (
        members.select("fp", F.explode(flips).alias("x"))
        .groupBy("x").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # 65 members at most
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where("a <> b")
    )
    return twos.union(around).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, component_id for every row of (doc_id, text)."""
    rows = stage(fingerprints(docs), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    stars = stage(components(near_links(prints.select("fp"))), "stars")
    roots = prints.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stage(roots, "roots")
    least = roots.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    labels = roots.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("p"), "component_id")
    return rows.join(labels, F.col("fp") == F.col("p")).select("doc_id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return linked(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id.

    A component of null doc_ids keeps the text with the smallest hash.  Rows that
    repeat doc_id and text share their fate.
    """
    rows = linked(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    # a component without ids is known by its fingerprint
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    best = rows.groupBy("component_id", group.alias("g")).agg(F.min(order).alias("best"))
    best = stage(best.select(F.col("best.doc_id").alias("_id"), F.col("best.key").alias("_key")), "representatives")
    own = docs["doc_id"].cast("long").eqNullSafe(best["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == best["_key"])
    return docs.join(best, own, "left_semi")
