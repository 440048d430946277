"""Aggregations: master tables, score statistics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keystead import vocab
from keystead.functions.measure import number_or
from keystead.functions.text import contains_any, strip
from keystead.session import stage


def unit_area() -> Column:
    """Area the unit price is taken on: land for tochi, private for mansion, else building."""
    return (
        F.when(F.col("property_type") == "tochi", F.col("tochi_menseki"))
        .when(F.col("property_type") == "mansion", F.col("senyu_menseki"))
        .otherwise(F.col("tatemono_menseki"))
        .cast("double")
    )


def age_band(age: Column) -> Column:
    return F.floor(age / 10).cast("int")


def market_master(df: DataFrame) -> DataFrame:
    """Mean unit price (10,000 yen per square metre) by place, type and age band.

    Needs address1, address2, property_type, price_man, age_years and the areas.
    """
    rows = df.withColumn("_area", unit_area()).filter((F.col("_area") > 0) & (F.col("price_man") > 0))
    return rows.groupBy(
        F.coalesce("address1", F.lit("")).alias("prefecture"), F.coalesce("address2", F.lit("")).alias("city"),
        "property_type", age_band(F.col("age_years")).alias("age_band"),
    ).agg(F.avg(F.col("price_man") / F.col("_area")).alias("unit_price"), F.count(F.lit(1)).alias("n"))


def land_use_class(c: Column | str) -> Column:
    """residential, commercial, or NULL for any other use."""
    return F.when(contains_any(c, vocab.RESIDENTIAL_WORDS), "residential").when(
        contains_any(c, vocab.COMMERCIAL_WORDS), "commercial"
    )


def public_prices(df: DataFrame) -> DataFrame:
    """Inheritance-tax and fixed-asset prices derived from the average land price."""
    return df.withColumns({
        "rosenka": F.floor(F.col("average") * vocab.ROSENKA_RATIO).cast("bigint"),
        "fixed_asset": F.floor(F.col("average") * vocab.FIXED_ASSET_RATIO).cast("bigint"),
    })


def trades_to_land_prices(trades: DataFrame, prefecture: Column) -> DataFrame:
    """Average land price per city and use from trade records.

    Trades without a city, of another use, without an area or with a unit price
    outside 10,000 to 10,000,000 yen are left out.
    """
    price = F.expr("try_cast(TradePrice AS DOUBLE)")
    area = number_or(F.col("Area").cast("string"), None)
    unit = F.try_divide(price, F.when(area > 0, area))
    rows = trades.select(
        prefecture.alias("prefecture"), strip("City").alias("city"), land_use_class("Use").alias("land_use"),
        unit.alias("unit"),
    ).filter(
        (F.col("city") != "") & F.col("land_use").isNotNull()
        & F.col("unit").between(vocab.UNIT_PRICE_MIN, vocab.UNIT_PRICE_MAX)
    )
    mean = rows.groupBy("prefecture", "city", "land_use").agg(
        F.floor(F.avg("unit")).cast("bigint").alias("average"), F.count(F.lit(1)).alias("n")
    )
    return public_prices(mean)


def score_statistics(evaluations: DataFrame, min_rows: int = 0) -> DataFrame:
    """Mean, population deviation and count of the scores, income property and homes apart.

    Completed, non-duplicate rows only; fewer than ``min_rows`` rows, or no spread, give the defaults.
    Two rows at most, so the result may be broadcast.
    """
    total, simple = F.col("total_investment_score"), F.col("investment_score")
    sides = F.filter(
        F.array(
            F.struct(F.lit(True).alias("is_investment"), total.alias("score")),
            F.struct(F.lit(False).alias("is_investment"), simple.alias("score")),
        ),
        lambda s: s["score"].isNotNull(),
    )
    known = (
        evaluations.filter((F.col("analysis_status") == "completed") & F.col("duplicate_of").isNull())
        .select(F.explode(sides).alias("s"))
        .groupBy("s.is_investment")
        .agg(F.avg("s.score").alias("m"), F.stddev_pop("s.score").alias("sd"), F.count(F.lit(1)).alias("n"))
    )
    enough = F.col("n") >= min_rows
    return known.select(
        "is_investment",
        F.when(enough, F.col("m")).otherwise(vocab.SCORE_MEAN_DEFAULT).alias("mean"),
        F.when(enough & (F.col("sd") > 0), F.col("sd")).otherwise(vocab.SCORE_SD_DEFAULT).alias("sd"),
        "n",
    )


def validity_report(df: DataFrame) -> DataFrame:
    """Shape of the prediction errors; one row.

    Needs asking_man, predicted_man and area (NULL where no area exists).
    """
    rows = df.filter(
        (F.col("asking_man") >= 100.0) & (F.col("asking_man") < 30000.0) & (F.col("predicted_man") > 0)
        & (F.coalesce("area", F.lit(10.0)) >= 10.0)
    ).select(((F.col("asking_man") - F.col("predicted_man")) / F.col("predicted_man")).alias("e"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("sd_error"),
        F.skewness("e").alias("sk"), F.kurtosis("e").alias("ku"),
    )
    shaped = (F.col("n") >= 3) & (F.col("sd_error") > 0)
    out = stats.select(
        "n", "mean_error", "sd_error",
        F.when(shaped, F.col("sk")).otherwise(0.0).alias("skewness"),
        F.when(shaped, F.col("ku")).otherwise(0.0).alias("kurtosis"),
    )
    return out.withColumn(
        "is_normal",
        F.coalesce(
            (F.abs("mean_error") <= 0.05) & (F.abs("skewness") <= 1.0) & (F.abs("kurtosis") <= 2.0), F.lit(False)
        ),
    )


def recent_counts(df: DataFrame, ts: str, as_of: Column, by: list[str], hours: int = 24) -> DataFrame:
    """Rows per key in the trailing hours, sorted; keys without rows do not appear."""
    return (
        df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
        .groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by)
    )


def counts_since_start(listings: DataFrame, jobs: DataFrame, ts: str = "input_ts") -> DataFrame:
    """Rows each job stored since it started; jobs without rows give 0.

    A job is (company, property_type, started_at), one per kind.
    """
    keys = ["company", "property_type"]
    found = listings.select(*keys, ts).join(jobs.select(*keys, "started_at"), keys).filter(
        F.col(ts) >= F.col("started_at")
    ).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return jobs.join(found, keys, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def job_summary(jobs: DataFrame) -> DataFrame:
    """Totals by outcome."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "success").alias("success_jobs"),
        F.count_if(F.col("status").isin("failed", "timeout", "error")).alias("failed_jobs"),
    )


def error_report(errors: DataFrame, as_of: Column, threshold: int = vocab.ERROR_ALERT_THRESHOLD) -> DataFrame:
    """Error pages per source with the last 24 hours, and a grand total row.

    The total row has NULL as its source; ``alert`` marks the total when the last
    day reached the threshold.
    """
    recent = F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")
    report = errors.rollup("company_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("recent_24h"), F.grouping("company_type").alias("_g")
    )
    return report.withColumn("is_total", F.col("_g") == 1).withColumn(
        "alert", F.col("is_total") & (F.col("recent_24h") >= threshold)
    ).drop("_g")


def success_rate(results: DataFrame, by: list[str]) -> DataFrame:
    """Rows parsed and rows that passed, per parser."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("passed"),
    ).withColumn("rate", F.col("passed") / F.col("total"))


def regression_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAPE (a target of 0 counts as 1), MAE and R2 per fold, averaged over the folds.

    Needs fold, actual and predicted on the price scale.
    """
    by = by or []
    y, p = F.col("actual"), F.col("predicted")
    base = F.when(y == 0, F.lit(1.0)).otherwise(y)
    folds = predictions.groupBy(*by, "fold").agg(
        (F.avg(F.abs((base - p) / base)) * 100).alias("mape"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )
    aggs = [F.avg(c).alias(c) for c in ("mape", "mae", "r2")] + [F.sum("n").alias("n"), F.count(F.lit(1)).alias("folds")]
    return folds.groupBy(*by).agg(*aggs) if by else folds.agg(*aggs)


def errors_by_period(predictions: DataFrame, ts: str, period: str = "month", by: list[str] | None = None) -> DataFrame:
    """Error metrics per type, area and week or month."""
    by = by or ["property_type", "city"]
    y, p = F.col("actual"), F.col("predicted")
    return predictions.filter(y > 0).groupBy(*by, F.date_trunc(period, ts).alias("period")).agg(
        (F.avg(F.abs((y - p) / y)) * 100).alias("mape"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


RANGES = 256  # of the lines around a rank


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], accuracy: int = 10000) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, columns q0, q1, ...

    No task holds a whole group.  Pass one takes approximate quantiles, whose
    rank error is bounded, as a bracket around each wanted rank.  Pass two
    collapses the rows below and above each bracket to one line each (their count
    and the value next to the bracket) and the rows inside to one line per value:
    about 4 rows in ``accuracy`` per quantile.  Pass three sums these lines by ranges
    of values and orders only the ranges that hold the rank.  ``by`` must be a short
    key such as the listing type: the bracket table is broadcast.
    """
    if not by:
        one = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, accuracy)
        return one.drop("_all")
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 2.0 / accuracy
    brackets = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(0.0, p - slack) for p in probs], F.lit(accuracy)).alias("_lo"),
        F.percentile_approx("_v", [min(1.0, p + slack) for p in probs], F.lit(accuracy)).alias("_hi"),
    )
    asked = brackets.select(
        *by, "_n", F.posexplode(F.arrays_zip("_lo", "_hi")).alias("_q", "_b")
    ).select(
        *by, "_q", F.col("_b._lo").alias("_lo"), F.col("_b._hi").alias("_hi"),
        (F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_q") + 1) * (F.col("_n") - 1)).alias("_rank"),
    )
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    group = [*by, "_q"]
    lines = (
        data.join(F.broadcast(asked), by)
        .withColumn("_side", side)
        .groupBy(*group, "_rank", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .withColumn("_v", F.when(F.col("_side") == 1, F.col("_min")).otherwise(F.col("_max")))
    )
    lines = stage(lines.select(*group, "_rank", "_v", "_c"), "lines")  # read three times below
    # the lines of a group in ranges: only sums of ranges, and the ranges that hold the rank, meet in a task
    ends = lines.groupBy(*group).agg(
        F.percentile_approx("_v", [(i + 1) / RANGES for i in range(RANGES)], F.lit(accuracy)).alias("_ends")
    )
    ranged = lines.join(F.broadcast(ends), group).withColumn("_range", F.size(F.filter("_ends", lambda e: e < F.col("_v")))).drop("_ends")
    sums = ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_range")
    starts = sums.select(*group, "_range", "_held", (F.sum("_held").over(before) - F.col("_held")).alias("_start"))
    held = (
        ranged.join(F.broadcast(starts), [*group, "_range"])  # RANGES + 1 rows per group and quantile
        .filter((F.col("_start") <= F.ceil("_rank")) & (F.floor("_rank") < F.col("_start") + F.col("_held")))
    )
    inside = Window.partitionBy(*group, "_range").orderBy("_v")
    upto = held.withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    picked = upto.groupBy(*group, "_rank").agg(
        at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b")
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_q") == i, value_at)).alias(f"q{i}") for i in range(len(probs))]
    )


def outlier_bounds(df: DataFrame, by: list[str], value: str, factor: float = vocab.IQR_FACTOR) -> DataFrame:
    """Lower and upper bound: the quartiles widened by 2.5 times their distance."""
    q = exact_quantiles(df, by, value, [0.25, 0.75])
    spread = (F.col("q1") - F.col("q0")) * factor
    return q.select(*by, (F.col("q0") - spread).alias("lower"), (F.col("q1") + spread).alias("upper"))
