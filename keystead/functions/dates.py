"""Build dates and ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keystead import vocab
from keystead.functions.text import ascii_digits, col, extract

# --- fixed values: date patterns and the age of an unknown building ---
ERAS = "(" + "|".join(vocab.ERA_BASE) + ")"
YEAR_MONTH = "([0-9]+)年([0-9]+)月"
ERA_YEAR_MONTH = ERAS + "([0-9]{1,2})年(?:([0-9]{1,2})月)?"
WESTERN_MONTH = r"([0-9]{4})[年/.\-]([0-9]{1,2})"
STATED_AGE = "築([0-9]+)年"
UNKNOWN_AGE = 20


def _first_of_month(year: Column, month: Column) -> Column:
    """Date from numbers; an impossible month is NULL."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return F.when(year.isNotNull() & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _era_base(era: Column) -> Column:
    base = F.lit(None).cast("int")
    for name, year in vocab.ERA_BASE.items():
        base = F.when(era == name, F.lit(year)).otherwise(base)
    return base


def built_month(c: Column | str, compat: bool = False) -> Column:
    """First of the build month from ``1998年3月``.

    Era years (平成10年3月) are converted; ``compat=True`` keeps them as the bare
    year number.
    """
    text = ascii_digits(c)
    year = extract(text, YEAR_MONTH, 1).try_cast("int")
    month = extract(text, YEAR_MONTH, 2).try_cast("int")
    if not compat:
        era = extract(text, ERAS + "[0-9]+年[0-9]+月", 1)
        year = F.when(era.isNotNull(), _era_base(era) + year).otherwise(year)
    return F.when(year.between(1, 9999), _first_of_month(year, month))


def age_years(text: Column | str, as_of: Column, built: Column | None = None) -> Column:
    """Age in years as a fraction; 20.0 when the build date is unknown.

    A typed date wins over the text.  The text may be an era date, a western
    year and month, or neither.
    """
    t = ascii_digits(text)
    era_year = extract(t, ERA_YEAR_MONTH, 2).try_cast("int")
    era_month = F.coalesce(extract(t, ERA_YEAR_MONTH, 3).try_cast("int"), F.lit(1))
    era = extract(t, ERA_YEAR_MONTH, 1)
    year = extract(t, WESTERN_MONTH, 1).try_cast("int")
    month = extract(t, WESTERN_MONTH, 2).try_cast("int")
    day = F.when(era.isNotNull(), _first_of_month(_era_base(era) + era_year, era_month)).otherwise(
        _first_of_month(year, month)
    )
    if built is not None:
        day = F.coalesce(built, day)
    return F.coalesce(F.datediff(as_of, day) / F.lit(365.25), F.lit(float(UNKNOWN_AGE)))


def age_whole_years(text: Column | str, as_of: Column, built: Column | None = None) -> Column:
    """Age in whole years by calendar year, never negative; 20 when unknown."""
    t = ascii_digits(text)
    this_year = F.year(as_of)
    era_year = F.lit(None).cast("int")
    for name in ("令和", "昭和", "平成"):
        base = vocab.ERA_BASE[name]
        # the first year of an era may be written 元, but not for the oldest era
        first = "" if name == "昭和" else "|元"
        found = extract(t, f"{name}([0-9]+{first})年", 1)
        number = F.when(found == "元", F.lit(1)).otherwise(found.try_cast("int"))
        era_year = F.when(F.contains(t, F.lit(name)), F.lit(base) + number).otherwise(era_year)
    year = F.coalesce(extract(t, "([0-9]{4})", 1).try_cast("int"), era_year)
    stated = extract(t, STATED_AGE, 1).try_cast("int")
    if built is not None:
        year = F.coalesce(F.year(built), year)
    known = F.when(year.isNotNull(), F.greatest(F.lit(0), this_year - year))  # greatest skips NULL
    return F.coalesce(known, stated, F.lit(UNKNOWN_AGE))


def is_old_quake_code(built: Column | str) -> Column:
    """1 when built before 1982-01-01, else 0."""
    return F.when(col(built) < F.to_date(F.lit("1982-01-01")), 1).otherwise(0)


def is_new_quake_code(built: Column | str, age: Column) -> Column:
    """1 when built on or after 1981-06-01; without a date, when at most 45 years old."""
    built = col(built)
    return F.when(built.isNotNull(), F.when(built < F.to_date(F.lit("1981-06-01")), 0).otherwise(1)).otherwise(
        F.when(age > 45.0, 0).otherwise(1)
    )
