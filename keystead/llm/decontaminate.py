"""Benchmark decontamination with DataFrame functions only.

The word windows of the benchmark are the set; every window of every document is
looked up in it.  A bounded bitmap of window hashes (fixed size, a constant of the
plan) lets almost only true hits leave the row; what leaves is joined by its words
with the set, which verifies it.  The set is broadcast below a stated number of rows
and shuffled like any other table beyond it.

Nulls: a null text has no words, in documents and items.  An item of fewer words than
a window is one window of that length.  Items that repeat an item_id count once; null
item_ids count as one item named ''.  Rows that repeat a doc_id are judged one by one.
Other columns are ignored by `contamination` and carried along by `decontaminated`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import LOWER, UPPER, text_or_empty
from keystead.session import stage

# Fixed value: what separates nothing else than words.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
WINDOW = 13
SHARE = 20  # a document is contaminated when SHARE * n_hit >= n_words
BITMAP_BITS = 20  # the bitmap holds 2 ** BITMAP_BITS bits, whatever the benchmark's size
BROADCAST_WINDOWS = 500_000  # windows of some hundred bytes each that may be broadcast


def words(column: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(column), UPPER, LOWER), F.lit(WORD), F.lit(1))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, gram, items): distinct windows of (item_id, text) and the items that have them."""
    tokens = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words().alias("w")).where("size(w) > 0")
    grams = tokens.select(
        "item",
        F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {window} + 1, 1)), i -> slice(w, i, {window}))")).alias("g"),
    )
    return grams.groupBy(F.size("g").alias("len"), F.array_join("g", " ").alias("gram")).agg(F.collect_set("item").alias("items"))


def _bitmap(grams: DataFrame, bits: int) -> tuple[Column, list[int]]:
    """An array constant of 2 ** (bits - 6) longs with a bit for each window, and the window lengths."""
    hashed = grams.select("len", F.xxhash64(F.split("gram", " ")).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    slots = hashed.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word"))
    filled = np.zeros(1 << (bits - 6), dtype=np.int64)
    for row in slots.collect():  # one row for each 64 bits of the bitmap at most
        filled[row["slot"]] = row["word"]
    lengths = sorted(r["len"] for r in hashed.select("len").distinct().collect())  # window lengths, 1 to the window
    return F.lit(filled), lengths


def candidates(bitmap: Column, lengths: list[int], bits: int) -> Column:
    """array<struct<pos, len, gram>>: windows of the words column `w` whose hash is in the bitmap."""
    def of(length: int) -> Column:
        found = F.filter(
            F.when(F.size("w") >= length, F.sequence(F.lit(1), F.size("w") - (length - 1))).otherwise(F.array().cast("array<int>")),
            lambda i: F.getbit(
                F.element_at(bitmap, (F.shiftright(_hash_at(i, length, bits), 6) + 1).cast("int")),
                _hash_at(i, length, bits).bitwiseAND(F.lit(63)).cast("int"),
            ) == 1,
        )
        return F.transform(found, lambda i: F.struct(
            i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(F.col("w"), i, F.lit(length)), " ").alias("gram")))

    if not lengths:
        return F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    return F.concat(*[of(n) for n in lengths])


def _hash_at(i: Column, length: int, bits: int) -> Column:
    return F.xxhash64(F.slice(F.col("w"), i, F.lit(length))).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, key (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, spans for every row.

    spans has the hit stretches of words as (first word from 1, number of words).
    """
    grams = stage(windows(items, window), "windows")
    bitmap, lengths = _bitmap(grams, BITMAP_BITS)
    known = grams.select(F.col("gram").alias("known"), "items")
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)  # the number of rows has just been checked
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("key"), words().alias("w"),
    )
    # the words are made once, before the windows are looked up
    rows = rows.select("row", "doc_id", "key", F.size("w").alias("n_words"), F.explode_outer(candidates(bitmap, lengths, BITMAP_BITS)).alias("c"))
    found = rows.select("row", "doc_id", "key", "n_words", "c.pos", "c.len", "c.gram").join(known, F.col("gram") == F.col("known"), "left")
    hit = F.col("known").isNotNull()
    per_row = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("pos", "len"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(hit, F.col("items")))))).alias("ids"),
    )
    # stretches in order of their first word, those that touch put together
    spans = F.expr("""
        aggregate(array_sort(hits), array(), (acc, h) ->
            if(size(acc) > 0 and h.pos <= element_at(acc, -1).pos + element_at(acc, -1).len,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('pos', element_at(acc, -1).pos,
                   'len', greatest(element_at(acc, -1).pos + element_at(acc, -1).len, h.pos + h.len) - element_at(acc, -1).pos))),
               concat(acc, array(h))))
    """.replace("array(),", "cast(array() as array<struct<pos:int,len:int>>),"))
    return (
        per_row.withColumn("spans", spans)
        .withColumn("n_hit", F.expr("aggregate(spans, 0, (n, s) -> n + s.len)").cast("long"))
        .select(
            "doc_id", "key", F.col("n_words").cast("long").alias("n_words"), "n_hit",
            F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "spans",
        )
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = contamination(docs, items, window, share).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    bad = stage(bad, "contaminated")
    own = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_key"])
    return docs.join(bad, own, "left_anti")
