"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.llm import bpe, codes, decontaminate, exact_dedup, licenses, phrases, pii, reshard, simhash, toxicity, url_filter, whitening, wrappers
from keystead.llm.common import table
from keystead.llm.sql import SQL

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), path)


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a minute that its id sets, against a list kept by the events.

    An event dates an entry for the page that has its user's number: errors block, signups
    allow, other events take the rule off; the event's number chooses the kind of rule.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    host, segment = url_filter.host_of(F.col("url")), url_filter.segment_of(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, url_filter.KINDS)), (F.col("event_id") % 3 + 1).cast("int"))
    entries = events.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id").select(
        F.col("event_id").alias("entry_id"), kind.alias("kind"),
        F.when(kind == "path", F.concat(host, F.lit("/"), segment)).when(kind == "host", host).otherwise(F.regexp_replace(host, r"^[^.]*\.", "")).alias("rule"),
        F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "signup", "allow").otherwise("remove").alias("action"),
        F.col("ts").cast("timestamp_ntz").alias("dated"),
    )
    captures = pages.withColumn("fetched_at", F.expr("timestampadd(MINUTE, cast(page_id * 7919 % 43200 as int), timestamp_ntz'2024-01-01 00:00:00')"))
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    found = url_filter.evaluate(captures, entries)
    return found.withColumns({"fetched_at": F.date_format("fetched_at", form), "since": F.date_format("since", form)})


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.assign(table(spark, sf_dir, "documents"), reshard.by_source())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("key", "spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("neighbours")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_rows(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_wrappers": op2_wrappers,
    "op3_bpe": op3_bpe,
    "op4_phrases": op4_phrases,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_reshard": op7_reshard,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_licenses": op12_licenses,
    "op13_codes": op13_codes,
}

__all__ = ["QUERIES", "SQL"]
