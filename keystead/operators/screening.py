"""Screening, routing and budget rules over evaluated listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keystead import vocab
from keystead.functions.text import contains_any, display_value
from keystead.operators.aggregates import score_statistics
from keystead.operators.repair import sample_per_group


def with_t_score(evaluations: DataFrame, stats: DataFrame | None = None, alert_at: float = vocab.T_SCORE_ALERT) -> DataFrame:
    """Standard score of each row in its own population, and the top-1% flag.

    A missing or zero score gives 0.  The statistics are at most two rows.
    """
    stats = score_statistics(evaluations) if stats is None else stats
    invest = F.contains(F.lower("property_type"), F.lit("invest"))
    score = F.when(F.col("is_investment"), F.col("total_investment_score")).otherwise(F.col("investment_score"))
    mean = F.coalesce("mean", F.lit(vocab.SCORE_MEAN_DEFAULT))
    sd = F.coalesce(F.when(F.col("sd") > 0, F.col("sd")), F.lit(vocab.SCORE_SD_DEFAULT))
    joined = (
        evaluations.withColumn("is_investment", invest)
        .join(F.broadcast(stats), "is_investment", "left")
        .withColumn("_score", score)
    )
    t = F.when(F.coalesce(F.col("_score") != 0, F.lit(False)), 50.0 + 10.0 * (F.col("_score") - mean) / sd).otherwise(0.0)
    return joined.withColumn("t_score", t).withColumn(
        "is_top", (F.col("t_score") >= alert_at) & ~F.coalesce("is_notified", F.lit(False))
    ).drop("_score", "mean", "sd", "n")


def needs_evaluation(listings: DataFrame, evaluations: DataFrame, rule: str = "predicted") -> DataFrame:
    """Listings still to be priced.

    ``predicted``: no first prediction yet.  ``staged``: first stage open, or
    passed with the second stage open.
    """
    if rule == "predicted":
        done = F.col("pred1").isNotNull()
    else:
        done = F.col("pred1").isNotNull() & (
            F.col("pred2").isNotNull() | ~F.coalesce("is_first_stage_passed", F.lit(False))
        )
    finished = evaluations.filter(done).select(F.col("property_url").alias("url"))
    return listings.join(finished, "url", "left_anti")


def eligible(listings: DataFrame) -> DataFrame:
    """Rows that can be trained on or priced: a price and a URL."""
    return listings.filter((F.col("price_yen") > 0) & (F.coalesce("url", F.lit("")) != ""))


def first_stage_passed(predicted: Column, asking: Column) -> Column:
    return F.coalesce((predicted > 0) & (asking > 0) & (predicted >= asking), F.lit(False))


def type_code(c: Column | str) -> Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit(""))


def best_prediction() -> Column:
    """Second-stage price if there is one, else the first, else 0."""
    return F.coalesce(
        F.nullif(F.col("pred2").cast("double"), F.lit(0.0)), F.nullif(F.col("pred1").cast("double"), F.lit(0.0)), F.lit(0.0)
    )


def recommend(df: DataFrame) -> DataFrame:
    """Rows worth announcing, with the reason and the numbers behind it.

    Income property by score (60 or more); homes by discount (15% to under 40%).
    A gap of 40% either way is taken for a pricing error.
    """
    asking = F.floor(F.col("price_yen") / 10000)
    apartment = type_code("property_type").isin(vocab.APARTMENT_CODES)
    zero_null = lambda c: F.nullif(F.col(c), F.lit(0.0))
    score = F.coalesce(zero_null("investment_score"), zero_null("total_investment_score"), F.lit(0.0))
    scored = df.filter(~F.coalesce("is_notified", F.lit(False)) & (F.col("price_yen") > 0)).withColumns({
        "asking_man": asking, "best_pred": best_prediction(), "score": score,
    })
    discount = F.when(
        F.col("best_pred") > 0, (F.col("best_pred") - F.col("asking_man")) / F.nullif(F.col("best_pred"), F.lit(0.0)) * 100.0
    )
    gap = F.col("discount_pct")
    reason = F.when(
        apartment, F.when(F.col("score") >= vocab.RECOMMEND_SCORE, "score")
    ).otherwise(F.when((gap >= vocab.DISCOUNT_MIN) & (gap < vocab.DISCOUNT_MAX), "discount"))
    return (
        scored.withColumn("discount_pct", discount)
        .withColumn("recommend_reason", reason)
        .withColumn(
            "suspect_error",
            F.coalesce(~apartment & ((gap >= vocab.DISCOUNT_MAX) | (gap <= -vocab.DISCOUNT_MAX)), F.lit(False)),
        )
    )


def alert_route(kind: Column | str) -> Column:
    """Alert channel of an anomaly by its type."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind.isin("invest_apartment", "apartment"), "apartment")
        .when(kind.isin("invest_kodate", "mansion", "kodate", "tochi"), kind)
        .otherwise("general")
    )


def error_route(source: Column | str) -> Column:
    """Alert channel of an error page by its source folder."""
    source = F.col(source) if isinstance(source, str) else source
    return (
        F.when(source.contains("mansion"), "mansion")
        .when(source.contains("kodate") & source.contains("invest"), "invest_kodate")
        .when(source.contains("kodate"), "kodate")
        .when(source.contains("tochi"), "tochi")
        .when(source.contains("apartment"), "apartment")
        .otherwise("general")
    )


def recommend_route(kind: Column | str, name: Column | str) -> Column:
    """Recommendation channel; a generic investment is split by words in its name."""
    code = type_code(kind)
    named_apartment = contains_any(F.lower(name), ["アパート", "マンション", "一棟"])
    return (
        F.when(code.isin("mansion", "kodate", "tochi"), code)
        .when(code.isin("investapartment", "investmentapartment", "apartment"), "invest_apartment")
        .when(code.isin("investkodate", "investmentkodate"), "invest_kodate")
        .when((code == "investment") & named_apartment, "invest_apartment")
        .when(code == "investment", "invest_kodate")
        .otherwise("default")
    )


def display_card(df: DataFrame) -> DataFrame:
    """Text blocks of one announcement per row."""
    def shown(name: str) -> Column:
        return display_value(name) if name in df.columns else F.lit("-")

    def known(name: str, label: str = "") -> Column:
        value = shown(name)
        return F.when(value != "-", F.concat(F.lit(label), value))

    access = F.concat_ws(" ", known("railway1"), known("station1"), known("walk_min1_str"))
    areas = F.concat_ws(
        " / ", known("senyu_menseki_text", "専有面積: "), known("tochi_menseki_text", "土地面積: "),
        known("tatemono_menseki_text", "建物面積: "),
    )
    label = F.col("property_type")
    for code, text in vocab.TYPE_LABELS.items():
        label = F.when(F.col("property_type") == code, F.lit(text)).otherwise(label)
    stamp = "yyyy-MM-dd HH:mm:ss"
    published = [F.date_format(c, stamp) for c in ("updated_ts", "published_ts", "input_ts") if c in df.columns]
    return df.withColumns({
        "card_title": F.concat(shown("property_name"), F.lit(" ("), label, F.lit(")")),
        "card_access": F.when(access != "", access).otherwise(shown("traffic")),
        "card_area": F.when(areas != "", areas).otherwise("-"),
        "card_address": shown("address"),
        "card_layout": shown("madori"),
        "card_built": shown("built_text"),
        "card_ratios": F.concat(shown("kenpei_text"), F.lit(" / "), shown("youseki_text")),
        "card_published": F.coalesce(*published, F.lit("-")),
    })


def daily_budget(
    df: DataFrame, ts: str, key: str, budget: int = vocab.DAILY_IMAGE_BUDGET, used: DataFrame | None = None
) -> DataFrame:
    """The first 200 rows of a day are processed, the rest is skipped by budget.

    A day may hold any number of rows: only its first 200 are ranked (Spark cuts
    each task to 200 rows per day before the shuffle), and the last of them is the
    line every row is compared with.  ``used`` (day, used) counts what earlier
    runs spent.
    """
    day = F.to_date(ts)
    w = Window.partitionBy("_day").orderBy(ts, key)
    ranked = (
        df.select(day.alias("_day"), ts, key)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= budget)
    )
    if used is not None:
        spent = used.select(F.col("day").alias("_day"), F.col("used").alias("_used"))
        ranked = ranked.join(spent, "_day", "left").filter(F.col("_rn") <= budget - F.coalesce("_used", F.lit(0)))
    line = ranked.groupBy("_day").agg(
        F.max(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))).alias("_line")
    )
    within = F.struct(F.col(ts).alias("t"), F.col(key).alias("k")) <= F.col("_line")
    return (
        df.withColumn("_day", day)
        .join(F.broadcast(line), "_day", "left")  # one row per calendar day
        .withColumn("budget_status", F.when(within, "processing").otherwise("skipped_by_budget"))
        .drop("_day", "_line")
    )


def images_for_analysis(images: Column | str, per_category: int = vocab.IMAGES_PER_CATEGORY) -> Column:
    """At most two images per category, in page order, categories in analysis order."""
    arr = F.col(images) if isinstance(images, str) else images

    def of(category: str) -> Column:
        return F.slice(F.filter(arr, lambda x: x["category"] == category), 1, per_category)

    return F.concat(of("layout"), of("exterior"), of("interior"))


def route_digest(items: DataFrame, route: str, order: list[Column], n: int = 10) -> DataFrame:
    """First ten items per route with the number of the rest."""
    totals = items.groupBy(route).agg(F.count(F.lit(1)).alias("total"))
    head = sample_per_group(items, [route], order, n)
    return head.join(totals, route).withColumn("others", F.greatest(F.lit(0), F.col("total") - n))


def bargains(df: DataFrame, n: int = 20, key: str = "listing_id") -> DataFrame:
    """The n listings furthest below their market value.

    Needs price_man, valued_area and market_unit.
    """
    return (
        df.withColumn("market_value", F.col("market_unit") * F.col("valued_area"))
        .withColumn("discount_pct", (F.col("market_value") - F.col("price_man")) / F.col("market_value") * 100.0)
        .orderBy(F.col("discount_pct").desc(), F.col(key))
        .limit(n)
    )
