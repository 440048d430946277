"""Quality rules.

A rule is a reason code and a condition that is true when the row breaks it.
Every job keeps all reasons of a row, in rule order, so the first one is the one
a stop-at-first check would have given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystead import schemas, vocab
from keystead.functions.text import ascii_digits, contains_any, strip
from keystead.operators.normalize import string_columns

Rule = tuple[str, Column]


def _true(c: Column) -> Column:
    """A condition that is unknown does not hold."""
    return F.coalesce(c, F.lit(False))


def _blank(name: str) -> Column:
    return F.coalesce(strip(name) == "", F.lit(True))


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    """The column, or a NULL of its type where a source does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def reasons(rules: list[Rule]) -> Column:
    """Array of the codes of all broken rules."""
    codes = F.array(*[F.when(_true(broken), F.lit(code)) for code, broken in rules])
    return F.filter(codes, lambda r: r.isNotNull())


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``reasons`` and ``is_valid``."""
    return df.withColumn("reasons", reasons(rules)).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of a checked table."""
    return (
        checked.filter("is_valid").drop("reasons", "is_valid"),
        checked.filter("NOT is_valid").drop("is_valid"),
    )


def required_rules() -> list[Rule]:
    """Name, price and address must be there; a price text makes up for a price of 0."""
    return [
        ("property_name", _blank("property_name")),
        ("price", F.coalesce(F.col("price_yen"), F.lit(0)).eqNullSafe(0) & _blank("price_text")),
        ("address", _blank("address") | (F.col("address") == "-")),
    ]


def strict_rules(df: DataFrame) -> list[Rule]:
    """The full check of a parsed row before it is stored."""
    kind = F.lower("property_type")
    is_tochi = kind.contains("tochi")
    is_mansion = kind.contains("mansion")
    is_house = kind.rlike("kodate|invest|apartment")
    name, price = F.col("property_name"), F.col("price_yen")
    railway, station = F.col("railway1"), F.col("station1")
    senyu, tochi = _optional(df, "senyu_menseki", "double"), _optional(df, "tochi_menseki", "double")
    built = _optional(df, "built_text", "string")
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    return [
        ("name_empty", empty(name)),
        ("name_seo", contains_any(name, vocab.SEO_PHRASES)),
        ("name_short", F.char_length(name).between(1, 1)),
        ("price_missing", F.coalesce(price <= 0, F.lit(True))),
        ("price_scale", (price > 0) & (price < 1000000)),
        ("address_empty", empty(F.col("address"))),
        ("address_parts", empty(F.col("address1")) | empty(F.col("address2"))),
        ("route_missing", empty(railway) | empty(station)),
        ("railway_dirty", railway.rlike("徒歩|停歩|駅") | ascii_digits(railway).rlike("[0-9]+分")),
        ("station_dirty", station.rlike("[」』）「『]")),
        ("walk_without_route", (empty(railway) | empty(station)) & F.col("walk_min1").isNotNull()),
        (
            "area_missing",
            F.when(is_mansion, F.coalesce(senyu <= 0, F.lit(True))).when(
                is_tochi | is_house, F.coalesce(tochi <= 0, F.lit(True))
            ),
        ),
        ("built_missing", ~is_tochi & empty(built)),
        ("built_incomplete", ~is_tochi & built.rlike("昭和年|平成年|令和年")),
    ]


def schema_rules(df: DataFrame) -> list[Rule]:
    """Value ranges per type."""
    kind = F.col("property_type")
    price = F.col("price_yen")
    senyu = _optional(df, "senyu_menseki", "double")
    rules = [
        ("property_name_length", F.coalesce(F.char_length("property_name") < 1, F.lit(True))),
        ("url_length", F.coalesce(F.char_length("url") < 1, F.lit(True))),
        ("price_text_missing", F.col("price_text").isNull()),
        ("price_range", F.coalesce((price < 0) | (price > 100000000000), F.lit(True))),
        ("address_missing", F.col("address").isNull()),
        ("senyu_range", (kind == "mansion") & ((senyu <= 0) | (senyu > 10000))),
    ]
    for name, types in (
        ("kanrihi", ["mansion"]), ("syuzen", ["mansion"]),
        ("tochi_menseki", ["kodate", "tochi"]), ("tatemono_menseki", ["kodate"]),
    ):
        rules.append((f"{name}_negative", kind.isin(types) & (_optional(df, name, "double") < 0)))
    return rules


def missing_fields(df: DataFrame) -> Column:
    """Map field -> value of the fields a row needs, by its type, and does not have."""
    kind = F.lower("property_type")
    entries = []
    for group, names in schemas.REQUIRED.items():
        applies = {
            "all": F.lit(True),
            "mansion": kind.contains("mansion"),
            "kodate": kind == "kodate",
            "tochi": kind.contains("tochi"),
            "investment": kind.rlike("invest|apartment"),
        }[group]
        for name in names:
            value = _optional(df, name, "string").cast("string")
            entries.append(
                F.when(
                    _true(applies) & F.coalesce(value == "", F.lit(True)),
                    F.struct(F.lit(name).alias("key"), F.coalesce(value, F.lit("NULL")).alias("value")),
                )
            )
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def reject_incomplete(df: DataFrame) -> DataFrame:
    """Whole-row rejection: adds ``missing`` (field -> value) and ``is_valid``."""
    return df.withColumn("missing", missing_fields(df)).withColumn("is_valid", F.size("missing") == 0)


def main_area(df: DataFrame, default: float | None = 0.0) -> Column:
    """First area that is there: private, then building, then land."""
    return F.coalesce(
        *[_optional(df, c, "double").cast("double") for c in ("senyu_menseki", "tatemono_menseki", "tochi_menseki")],
        F.lit(default).cast("double"),
    )


FRONTAGE_TYPES = ["tochi", "kodate", "invest_kodate"]


def anomaly_scan(df: DataFrame) -> DataFrame:
    """Rows with a suspect price, area or frontage.

    Frontage alone is a warning; the other reasons are critical.
    """
    price_man = F.coalesce(F.col("price_yen"), F.lit(0)) / 10000.0
    area = main_area(df)
    kind = F.col("property_type")
    frontage = F.coalesce(_optional(df, "maguchi", "double").cast("double"), F.lit(0.0))
    critical = [
        ("price", price_man < 100.0),
        ("area", area <= 5.0),
        ("apartment_area", (kind == "apartment") & (area < 15.0)),
    ]
    warning = [("frontage_zero", kind.isin(FRONTAGE_TYPES) & (frontage <= 0.0))]
    return (
        df.filter(F.coalesce(F.col("url") != "", F.lit(False)))
        .withColumns({
            "price_man": price_man,
            "area_used": area,
            "reasons": reasons(critical + warning),
            "is_critical": F.size(reasons(critical)) > 0,
        })
        .filter(F.size("reasons") > 0)
    )


def invalidate_predictions(evaluations: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Zero both predictions of critical rows and keep them out of alerts."""
    hit = anomalies.filter("is_critical").select(F.col("url").alias("property_url")).distinct()
    marked = evaluations.join(hit.withColumn("_hit", F.lit(True)), "property_url", "left")
    gone = F.coalesce(F.col("_hit"), F.lit(False))
    return marked.withColumns({
        "pred1": F.when(gone, F.lit(0)).otherwise(F.col("pred1")),
        "pred2": F.when(gone, F.lit(0)).otherwise(F.col("pred2")),
        "is_notified": gone | F.col("is_notified"),
    }).drop("_hit")


def heal_targets(evaluations: DataFrame, listings: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Recently analysed rows whose values point at a parser fault, first reason wins.

    Zero and NULL values do not count as small.
    """
    recent = evaluations.filter(F.col("analyzed_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).select(
        "company", "property_type", "property_id", "analyzed_at"
    )
    joined = recent.join(listings, ["company", "property_type", "property_id"], "inner")
    small = lambda c, limit: (F.col(c) != 0) & (F.col(c) < limit)
    reason = (
        F.when(small("price_yen", 1000000), "price_small")
        .when(small("tatemono_menseki", 5.0), "building_small")
        .when(small("tochi_menseki", 5.0), "land_small")
        .when((F.col("maguchi") == 0) & (F.col("setsudou") != ""), "frontage_unparsed")
    )
    return (
        joined.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("url", "company", "property_type", "property_name", "price_yen", "reason", "analyzed_at")
        .distinct()
    )


def prediction_errors(predictions: DataFrame, limit: float = 0.3) -> DataFrame:
    """Predictions off by 30% or more of a known actual price."""
    ratio = F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual"))
    return (
        predictions.filter(F.col("actual") > 0)
        .withColumn("_ratio", ratio)
        .filter(F.abs("_ratio") >= limit)
        .withColumn("error_ratio", F.format_string("%.4f", F.col("_ratio").cast("double")))
        .drop("_ratio")
    )


def text_audit(df: DataFrame, key: str, table: str, limit: int | None = 50) -> DataFrame:
    """Text values with a literal none or a double space, first 50 by key and field."""
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in string_columns(df) if c != key
    ])
    bad = F.filter(fields, lambda f: f["value"].rlike("None|none|  "))
    hits = df.select(F.lit(table).alias("table_name"), F.col(key).alias("row_key"), F.explode(bad).alias("f")).select(
        "table_name", "row_key", "f.field", "f.value"
    )
    return hits.orderBy("row_key", "field").limit(limit) if limit else hits


def null_profile(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Rows per table and how many are NULL or 0 per field; -1 for an absent field."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for name in fields:
        if name in df.columns:
            aggs.append(F.count_if(F.col(name).isNull() | (F.col(name) == 0)).alias(f"null_{name}"))
        else:
            aggs.append(F.first(F.lit(-1)).cast("bigint").alias(f"null_{name}"))
    return df.groupBy(*by).agg(*aggs)
