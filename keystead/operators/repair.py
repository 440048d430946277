"""Repair jobs over stored rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from keystead import vocab
from keystead.functions.measure import ratio_pct
from keystead.functions.text import strip
from keystead.functions.traffic import routes


def needs_ratio_repair() -> Column:
    """A ratio text without its number, for either ratio."""
    gap = lambda n: F.col(n).isNull() & F.coalesce(F.col(f"{n}_text") != "", F.lit(False))
    return gap("kenpei") | gap("youseki")


def repair_ratios(df: DataFrame) -> DataFrame:
    """Split a combined ``60%／200%`` text and parse both ratios again.

    Only rows that need it change; ``repaired`` says which.
    """
    need = needs_ratio_repair()
    sep = "[／/]"
    combined = F.when(F.col("kenpei_text").rlike(sep), F.col("kenpei_text")).when(
        F.col("youseki_text").rlike(sep), F.col("youseki_text")
    )
    parts = F.split(combined, sep)
    new_kenpei = F.coalesce(strip(F.get(parts, F.lit(0))), F.col("kenpei_text"))
    new_youseki = F.coalesce(strip(F.get(parts, F.lit(1))), F.col("youseki_text"))
    pick = lambda new, old: F.when(F.col("repaired"), new).otherwise(F.col(old))
    out = df.withColumn("repaired", need).withColumns({
        "kenpei_text": pick(new_kenpei, "kenpei_text"),
        "youseki_text": pick(new_youseki, "youseki_text"),
    })
    return out.withColumns({
        n: F.when(
            F.col("repaired") & F.coalesce(F.col(f"{n}_text") != "", F.lit(False)), ratio_pct(f"{n}_text")
        ).otherwise(F.col(n))
        for n in ("kenpei", "youseki")
    })


def repair_routes(df: DataFrame) -> DataFrame:
    """Parse the access text again where the first railway is missing."""
    need = F.col("railway1").isNull() & F.coalesce(F.col("traffic") != "", F.lit(False))
    first = F.get(F.col("_routes"), F.lit(0))
    fix = lambda part, old: F.when(F.col("repaired"), first[part]).otherwise(F.col(old))
    return (
        df.withColumn("repaired", need)
        .withColumn("_routes", F.when(F.col("repaired"), routes("traffic")))
        .withColumns({
            "railway1": fix("railway", "railway1"),
            "station1": fix("station", "station1"),
            "walk_min1": fix("walk_min", "walk_min1"),
        })
        .drop("_routes")
    )


def sample_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.

    The rank filter is applied per task before the shuffle (Spark pushes the
    limit below the exchange), so a hot group costs ``n`` rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def missing_value_sample(df: DataFrame, field: str, by: list[str], key: str, n: int = 5) -> DataFrame:
    """Up to five rows per table whose field is NULL."""
    return sample_per_group(df.filter(F.col(field).isNull()), by, [F.col(key)], n)


def random_sample(df: DataFrame, by: list[str], key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Up to ten rows per group in a repeatable random order."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return sample_per_group(df, by, [mixed, F.col(key)], n)


def recover_source(df: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Take company and type apart where the type carries a known company prefix."""
    codes = codes or vocab.COMPANY_CODES
    pattern = "^(" + "|".join(re.escape(c) for c in codes) + ")(.+)$"
    lowered = F.lower("property_type")
    unknown = (F.col("company") == "unknown") & lowered.rlike(pattern)
    return df.withColumns({
        "company": F.when(unknown, F.regexp_extract(lowered, pattern, 1)).otherwise(F.col("company")),
        "property_type": F.when(unknown, F.regexp_extract(lowered, pattern, 2)).otherwise(F.col("property_type")),
        "recovered": unknown,
    })


def detect_type(df: DataFrame, declared: str = "property_type") -> Column:
    """mansion, kodate, apartment or tochi by the declared name, else by the fields present."""
    name = F.coalesce(F.lower(F.col(declared)), F.lit("")) if declared in df.columns else F.lit("")
    there = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    out = F.lit(None).cast("string")
    for kind in reversed(["mansion", "kodate", "apartment", "tochi"]):
        out = F.when(name.contains(kind), F.lit(kind)).otherwise(out)
    return F.coalesce(
        out,
        F.when(there("senyu_menseki"), "mansion")
        .when(there("tatemono_menseki") & there("gross_yield"), "apartment")
        .when(there("tatemono_menseki"), "kodate")
        .when(there("tochi_menseki") | there("maguchi"), "tochi")
        .otherwise("mansion"),
    )


def scoring_type(c: Column) -> Column:
    """The model family a type code is priced with; mansion when unknown."""
    kind = F.lower(c)
    return (
        F.when(kind.contains("kodate"), "kodate")
        .when(kind.contains("apartment"), "apartment")
        .when(kind.isin("mansion", "tochi"), kind)
        .otherwise("mansion")
    )


def report_type(c: Column) -> Column:
    """Type code of the job report: investment kinds in one spelling."""
    kind = F.lower(F.replace(c, F.lit("_"), F.lit("")))
    return (
        F.when(kind.isin("investmentkodate", "investkodate"), "invest_kodate")
        .when(kind.isin("investmentapartment", "investapartment"), "invest_apartment")
        .otherwise(kind)
    )
