"""Joins with public statistics.

No join here is hinted: a dimension is a stored table or a small aggregate of
one, so Catalyst knows its size and broadcasts it while it stays under
``spark.sql.autoBroadcastJoinThreshold``; beyond that the join is a shuffle join
that AQE splits at hot keys.  Explicit hints appear only where the number of
rows is bounded by a fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystead import vocab
from keystead.functions.text import first_word
from keystead.session import stage

MUNI_FIELDS = ["pop_growth", "income", "total_population", "income_growth", "density"]


def _mean(c: Column | str, compat: bool) -> Column:
    """Mean; ``compat`` divides by all rows, NULL ones included."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.sum(c) / F.count(F.lit(1)) if compat else F.avg(c)


def _whole(c: Column) -> Column:
    """Cut a number to its whole part."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint")


def municipality_averages(dim: DataFrame, compat: bool = False) -> DataFrame:
    """Prefecture averages for the fallback."""
    return dim.groupBy("prefecture").agg(
        _mean("pop_growth", compat).alias("pop_growth"),
        _whole(_mean("income", compat)).alias("income"),
        _whole(_mean("total_population", compat)).alias("total_population"),
        _mean("income_growth", compat).alias("income_growth"),
        _mean("density", compat).alias("density"),
    )


KEYS = {"prefecture": "address1", "city": "address2"}


def _municipality_by_city(dim: DataFrame) -> DataFrame:
    return dim.select("prefecture", "city", F.lit(True).alias("_city"), *[F.col(c).alias(f"_c_{c}") for c in MUNI_FIELDS])


def _municipality_by_prefecture(dim: DataFrame, compat: bool) -> DataFrame:
    return municipality_averages(dim, compat).select("prefecture", *[F.col(c).alias(f"_p_{c}") for c in MUNI_FIELDS])


def _municipality_columns() -> dict[str, Column]:
    out = {}
    for name in MUNI_FIELDS:
        default = F.lit(vocab.MUNI_DEFAULTS[name])
        kind = "bigint" if name in ("income", "total_population") else "double"
        city, back = F.col(f"_c_{name}").cast(kind), F.col(f"_p_{name}").cast(kind)
        if name == "density":
            value = F.coalesce(city, back, default)
        else:
            value = F.when(F.col("_city"), F.coalesce(city, default)).otherwise(F.coalesce(back, default))
        out[name] = value.cast(kind)
    return out


def _join_places(df: DataFrame, by_city: DataFrame, by_prefecture: DataFrame | None = None) -> DataFrame:
    joined = df.join(by_city.withColumnsRenamed(KEYS), ["address1", "address2"], "left")
    if by_prefecture is None:
        return joined
    return joined.join(by_prefecture.withColumnsRenamed(KEYS), "address1", "left")


def _without_helpers(df: DataFrame, before: DataFrame) -> DataFrame:
    """Drop the underscored columns a lookup brought along."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in before.columns])


def with_municipality(df: DataFrame, dim: DataFrame, compat: bool = False) -> DataFrame:
    """Population, income and density of the city, else of the prefecture, else defaults.

    Where the city is known its gaps take the defaults, not the prefecture
    average; density alone falls back in both cases.
    """
    joined = _join_places(df, _municipality_by_city(dim), _municipality_by_prefecture(dim, compat))
    return _without_helpers(joined.withColumns(_municipality_columns()), df)


def station_volumes(dim: DataFrame, seq: str = "station_id") -> DataFrame:
    """One volume per station name: the row read last wins."""
    return dim.groupBy(F.replace("station_name", F.lit("駅"), F.lit("")).alias("_station")).agg(
        F.max_by("passenger_volume", seq).alias("passenger_volume")
    )


def with_station(df: DataFrame, dim: DataFrame, seq: str = "station_id") -> DataFrame:
    """Passengers a day at the first station; 10,000 when unknown."""
    return (
        df.withColumn("_station", F.replace("station1", F.lit("駅"), F.lit("")))
        .join(station_volumes(dim, seq), "_station", "left")
        .withColumn("passenger_volume", F.coalesce("passenger_volume", F.lit(vocab.PASSENGER_DEFAULT)).cast("bigint"))
        .drop("_station")
    )


def zone_keywords(zones: DataFrame) -> DataFrame:
    """For each zone keyword the first zone whose name contains it (at most 13 rows)."""
    words = F.explode(F.array(*[F.lit(w) for w in vocab.ZONE_KEYWORDS])).alias("_zone_word")
    return (
        zones.select("*", words)
        .filter(F.contains(F.col("zone_name"), F.col("_zone_word")))
        .groupBy("_zone_word")
        .agg(
            F.min_by("max_youseki", "zone_id").alias("_zone_youseki"),
            F.min_by("max_kenpei", "zone_id").alias("_zone_kenpei"),
        )
    )


def with_limits(df: DataFrame, zones: DataFrame, youseki_limit: Column, kenpei_limit: Column) -> DataFrame:
    """Floor-area and coverage limits: stated, else by zone keyword, else 200 and 60."""
    stated = df.withColumns({
        "max_youseki": youseki_limit.cast("double"),
        "max_kenpei": kenpei_limit.cast("double"),
    })
    word = F.when(
        F.col("max_youseki").isNull() | F.col("max_kenpei").isNull(),
        first_word("youseki_text", vocab.ZONE_KEYWORDS),
    )
    return (
        stated.withColumn("_zone_word", word)
        .join(F.broadcast(zone_keywords(zones)), "_zone_word", "left")
        .withColumns({
            "max_youseki": F.coalesce("max_youseki", F.col("_zone_youseki").cast("double"), F.lit(vocab.YOUSEKI_DEFAULT)),
            "max_kenpei": F.coalesce("max_kenpei", F.col("_zone_kenpei").cast("double"), F.lit(vocab.KENPEI_DEFAULT)),
        })
        .drop("_zone_word", "_zone_youseki", "_zone_kenpei")
    )


PRICE_FIELDS = ["average", "rosenka", "fixed_asset", "growth"]


def land_price_wide(dim: DataFrame) -> DataFrame:
    """One row per city, the two land uses side by side."""
    aggs = []
    for use, tag in (("residential", "res"), ("commercial", "com")):
        of_use = F.col("land_use") == use
        aggs.append(F.max(F.when(of_use, F.lit(True))).alias(f"_{tag}"))
        aggs += [F.max(F.when(of_use, F.col(c))).cast("double").alias(f"_{tag}_{c}") for c in PRICE_FIELDS]
    return dim.groupBy("prefecture", "city").agg(*aggs)


def land_price_averages(dim: DataFrame, compat: bool = False) -> DataFrame:
    """Prefecture averages per land use, side by side."""
    aggs = []
    for use, tag in (("residential", "res"), ("commercial", "com")):
        of_use = F.col("land_use") == use
        rows = F.count(F.when(of_use, 1))
        for c in PRICE_FIELDS:
            value = F.when(of_use, F.col(c).cast("double"))
            mean = F.try_divide(F.sum(value), rows) if compat else F.avg(value)
            if c == "growth":
                # a prefecture with rows but no known growth counts as no growth
                mean = F.when(rows > 0, F.coalesce(mean, F.lit(0.0)))
            elif compat:
                mean = F.when(rows > 0, F.coalesce(mean, F.lit(0.0)))
            aggs.append(mean.alias(f"_p_{tag}_{c}"))
    return dim.groupBy("prefecture").agg(*aggs)


def commercial_weight(youseki: Column) -> Column:
    """0 up to 150%, 1 from 450%, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (youseki - 150.0) / 300.0))


def _land_price_columns() -> dict[str, Column]:
    w_com = commercial_weight(F.col("max_youseki"))

    def source(tag: str, c: str) -> Column:
        city, back = F.col(f"_{tag}_{c}"), F.col(f"_p_{tag}_{c}")
        return F.coalesce(city, back) if c == "growth" else F.when(F.col(f"_{tag}"), city).otherwise(back)

    def blend(c: str) -> Column:
        res, com = source("res", c), source("com", c)
        return F.coalesce(res * (1.0 - w_com) + com * w_com, res, com)

    return {
        "average_land_price": F.coalesce(_whole(blend("average")), F.lit(vocab.LAND_PRICE_DEFAULT).cast("bigint")),
        "_rosenka": _whole(blend("rosenka")),
        "_fixed": _whole(blend("fixed_asset")),
        "land_price_growth": F.coalesce(blend("growth"), F.lit(0.0)),
    }


def _public_price_columns() -> dict[str, Column]:
    average = F.col("average_land_price")
    return {
        "rosenka_price": F.coalesce("_rosenka", _whole(average * vocab.ROSENKA_RATIO)),
        "fixed_asset_price": F.coalesce("_fixed", _whole(average * vocab.FIXED_ASSET_RATIO)),
    }


def with_land_price(df: DataFrame, dim: DataFrame, compat: bool = False) -> DataFrame:
    """Land prices per square metre, residential and commercial blended by the floor-area limit.

    Prices fall back to the prefecture only when the city has no row; growth also
    when the city's value is missing.
    """
    joined = _join_places(df, land_price_wide(dim), land_price_averages(dim, compat))
    priced = joined.withColumns(_land_price_columns()).withColumns(_public_price_columns())
    return _without_helpers(priced, df)


def _hazard_by_city(dim: DataFrame) -> DataFrame:
    return dim.select("prefecture", "city", F.col("flood").alias("_flood"), F.col("landslide").alias("_slide"))


def _hazard_columns() -> dict[str, Column]:
    return {
        "flood_risk": F.coalesce("_flood", F.lit(0)).cast("int"),
        "landslide_risk": F.coalesce("_slide", F.lit(0)).cast("int"),
    }


def with_hazard(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Flood and landslide levels of the city, 0 when unknown."""
    joined = _join_places(df, _hazard_by_city(dim))
    return _without_helpers(joined.withColumns(_hazard_columns()), df)


def with_places(
    df: DataFrame, municipality: DataFrame, land_price: DataFrame, hazard: DataFrame, compat: bool = False
) -> DataFrame:
    """The three place lookups in one: two joins per listing instead of five.

    The dimensions are joined with each other first, which costs nothing at their
    size.
    """
    place = ["prefecture", "city"]
    by_city = (
        _municipality_by_city(municipality)
        .join(land_price_wide(land_price), place, "full_outer")
        .join(_hazard_by_city(hazard), place, "full_outer")
    )
    by_prefecture = _municipality_by_prefecture(municipality, compat).join(
        land_price_averages(land_price, compat), "prefecture", "full_outer"
    )
    joined = _join_places(df, by_city, by_prefecture)
    valued = joined.withColumns({**_municipality_columns(), **_land_price_columns(), **_hazard_columns()})
    return _without_helpers(valued.withColumns(_public_price_columns()), df)


def _grams(c: Column, n: int) -> Column:
    """Distinct runs of n signs of a name."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: i + n - 1 <= F.char_length(c))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, n)))


def containment_pairs(asked: DataFrame, stored: DataFrame, part: str, name: str) -> DataFrame:
    """Pairs (part, name) of distinct asked parts and stored names where the name holds the part.

    An inverted index: a stored name is listed under its signs and its pairs of signs, so
    twice its length, and an asked part meets the list of its rarest pair (of its sign, if
    it has one only) and is verified there.  Empty and NULL names pair with nothing.
    """
    parts = asked.select(F.col(part).alias("_part")).filter(F.col("_part") != "").distinct()
    names = stored.select(F.col(name).alias("_name")).filter(F.col("_name") != "").distinct()
    listed = names.select("_name", F.explode(F.concat(_grams(F.col("_name"), 1), _grams(F.col("_name"), 2))).alias("_gram"))
    sizes = listed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = F.when(F.char_length("_part") == 1, _grams(F.col("_part"), 1)).otherwise(_grams(F.col("_part"), 2))
    rarest = (
        parts.select("_part", F.explode(keys).alias("_gram")).join(sizes, "_gram")
        .groupBy("_part").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    )
    met = rarest.join(listed, "_gram").filter(F.contains("_name", F.col("_part")))
    return met.select(F.col("_part").alias(part), F.col("_name").alias(name))


def land_price_by_part(dim: DataFrame, places: DataFrame, pref: str, city: str, seq: str = "land_id") -> tuple[DataFrame, DataFrame]:
    """Land prices of the asked (distinct) places, found by parts of the stored names.

    Per place the winner of all rows whose names contain it: residential rows first, then
    the earliest.  Returns the city level (pref, city, _city_price) and the prefecture level
    (pref, _pref_price), the mean over all rows that contain the prefecture.
    """
    order = F.struct(F.col("land_use") != "residential", F.col(seq))
    best = (
        dim.filter((F.col("prefecture") != "") & (F.col("city") != "")).groupBy("prefecture", "city")
        .agg(F.min_by("average", order).alias("average"), F.min(order).alias("_order"))
    )
    sums = dim.filter(F.col("prefecture") != "").groupBy("prefecture").agg(
        F.sum(F.col("average").cast("double")).alias("_sum"), F.count("average").alias("_n")
    )
    by_pref = containment_pairs(places, sums, pref, "prefecture")
    by_city = (
        places.select(pref, city).join(containment_pairs(places, best, city, "city"), city)
        .join(best, "city").join(by_pref, [pref, "prefecture"])
        .groupBy(pref, city).agg(F.min_by("average", "_order").cast("bigint").alias("_city_price"))
    )
    mean = F.try_divide(F.sum("_sum"), F.sum("_n"))
    prefs = by_pref.join(sums, "prefecture").groupBy(pref).agg(_whole(F.nullif(mean, F.lit(0.0))).alias("_pref_price"))
    return by_city, prefs


def with_land_price_contains(
    df: DataFrame, dim: DataFrame, pref: str = "address1", city: str = "address2", seq: str = "land_id",
    out: str = "asset_land_price",
) -> DataFrame:
    """Land price by containment: city level, else prefecture mean, else 100,000.

    Only the distinct places of the listings meet the keyed dimension.  The priced
    places are written once, so that the join back knows how few they are and
    leaves the listings unshuffled.
    """
    places = stage(df.select(pref, city).distinct(), "asked")
    by_city, by_pref = land_price_by_part(dim, places, pref, city, seq)
    asked = F.coalesce((F.col(pref) != "") & (F.col(city) != ""), F.lit(False))
    priced = places.join(by_city, [pref, city], "left").join(by_pref, pref, "left").select(
        pref, city, F.when(asked, F.coalesce("_city_price", "_pref_price")).alias(out)
    )
    return df.join(stage(priced, "places"), [pref, city], "left").withColumn(
        out, F.coalesce(out, F.lit(vocab.DEFAULT_LAND_PRICE).cast("bigint"))
    )


def market_fallback(master: DataFrame) -> DataFrame:
    """Unweighted prefecture mean of the city means, per type and age band."""
    return master.groupBy("prefecture", "property_type", "age_band").agg(F.avg("unit_price").alias("pref_unit"))


def with_market(df: DataFrame, master: DataFrame) -> DataFrame:
    """Market unit price: city, else prefecture, else 30.0 (10,000 yen per square metre).

    ``master`` should be a stored table (see ``session.stage``), so that its size
    is known when the join is planned.
    """
    city = master.select(
        F.col("prefecture").alias("address1"), F.col("city").alias("address2"), "property_type", "age_band",
        F.col("unit_price").alias("_city_unit"),
    )
    pref = market_fallback(master).withColumnsRenamed({"prefecture": "address1", "pref_unit": "_pref_unit"})
    return (
        df.join(city, ["address1", "address2", "property_type", "age_band"], "left")
        .join(pref, ["address1", "property_type", "age_band"], "left")
        .withColumn("market_unit", F.coalesce("_city_unit", "_pref_unit", F.lit(vocab.MARKET_UNIT_DEFAULT)))
        .drop("_city_unit", "_pref_unit")
    )


def with_listing(evaluations: DataFrame, listings: DataFrame, by: str = "property_id") -> DataFrame:
    """Evaluation rows with their listing, by (company, type, id) or (company, type, url).

    Type codes are compared in one spelling: no underscore, ``investment`` for
    ``invest``.
    """
    def code(c: str) -> Column:
        plain = F.replace(F.lower(c), F.lit("_"), F.lit(""))
        return F.regexp_replace(plain, "^invest(?!ment)", "investment")

    key = "property_url" if by == "url" else by
    left = evaluations.withColumns({"_company": F.lower("company"), "_type": code("property_type")}).withColumn(
        "_key", F.col(key)
    )
    right = listings.withColumns({"_company": F.lower("company"), "_type": code("property_type")}).withColumn(
        "_key", F.col(by)
    ).drop("company", "property_type", *[c for c in listings.columns if c in evaluations.columns and c not in ("company", "property_type")])
    return left.join(right, ["_company", "_type", "_key"], "inner").drop("_company", "_type", "_key")


def with_image_scores(df: DataFrame, evaluations: DataFrame, default: float = 3.0) -> DataFrame:
    """Interior and layout scores by URL, 3.0 each when there is none."""
    scores = evaluations.select(F.col("property_url").alias("url"), "interior_score", "layout_score")
    return df.drop("interior_score", "layout_score").join(scores, "url", "left").withColumns({
        c: F.coalesce(c, F.lit(default)) for c in ("interior_score", "layout_score")
    })


def without_duplicates(df: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Listings whose URL is not marked as a duplicate."""
    marked = evaluations.filter(F.col("duplicate_of").isNotNull()).select(F.col("property_url").alias("url"))
    return df.join(marked, "url", "left_anti")
