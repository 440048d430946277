"""Areas, ratios, floors, limits and other numbers from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keystead.functions.text import (
    ascii_digits, col, extract, no_value, strip, to_long,
)

AREA_TYPE = "decimal(10,3)"


def area_m2(c: Column | str) -> Column:
    """Area in square metres: the first number before the unit sign."""
    head = F.split_part(F.replace(col(c), F.lit(","), F.lit("")), F.lit("㎡"), F.lit(1))
    return F.when(~no_value(c), extract(head, r"([0-9.]+)").try_cast(AREA_TYPE))


def first_int(c: Column | str) -> Column:
    """First whole number; 0 when there is none, NULL for empty text."""
    number = extract(ascii_digits(c), "([0-9]+)")
    return F.when(
        F.coalesce(col(c) != "", F.lit(False)),
        F.when(number.isNull(), F.lit(0).cast("bigint")).otherwise(to_long(number)),
    )


def ratio_pct(c: Column | str) -> Column:
    """Percentage: the first number, percent signs ignored."""
    return F.when(
        ~no_value(c), extract(F.translate(col(c), "％%", ""), r"([0-9.]+)").try_cast("decimal(10,2)")
    )


def number_or(c: Column | str, default: float | None) -> Column:
    """First number in a text, or the default."""
    return F.coalesce(extract(c, r"([0-9.]+)").try_cast("double"), F.lit(default).cast("double"))


def ratio_limit(c: Column | str) -> Column:
    """Legal limit: a number before a percent sign, else a number from 10 to 1000."""
    text = ascii_digits(c)
    percent = extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*%").try_cast("double")
    bare = extract(text, r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")
    return F.coalesce(percent, F.when(bare.between(10.0, 1000.0), bare))


def coverage_and_far(c: Column | str) -> Column:
    """Both limits from one text, as struct(kenpei, youseki).

    Either labelled (建ぺい率60%容積率200%) or split at ・ or / with a percent sign
    in each part.
    """
    text = col(c)
    number = lambda x: ascii_digits(x)
    labelled = text.rlike("建ぺい率|容積率")
    parts = F.split(text, "[・/]")

    def part(i: int) -> Column:
        p = strip(F.get(parts, F.lit(i)))
        return F.when((F.size(parts) >= 2) & F.contains(p, F.lit("%")), extract(number(p), "([0-9]+)"))

    kenpei = F.when(labelled, extract(number(text), "建ぺい率([0-9]+)%")).otherwise(part(0))
    youseki = F.when(labelled, extract(number(text), "容積率([0-9]+)%")).otherwise(part(1))
    return F.struct(
        kenpei.try_cast("int").alias("kenpei"), youseki.try_cast("int").alias("youseki")
    )


def floors(c: Column | str) -> Column:
    """struct(floor, above, below) from text such as 3階 / 地上10階 地下1階."""
    text = ascii_digits(c)
    return F.struct(
        extract(text, "([0-9]+)階").try_cast("int").alias("floor"),
        extract(text, "地上([0-9]+)階").try_cast("int").alias("above"),
        extract(text, "地下([0-9]+)階").try_cast("int").alias("below"),
    )


def depth_m(area: Column | str, frontage: Column | str) -> Column:
    """Lot depth: area over frontage, two decimals half even."""
    quotient = F.try_divide(col(area).cast("decimal(18,3)"), col(frontage).cast("decimal(18,3)"))
    return F.when(col(frontage) > 0, F.bround(quotient, 2).cast("decimal(10,2)"))
