"""Text helpers: all JVM expressions, no Python per row."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from keystead import vocab


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_digits(c: Column | str) -> Column:
    """Full-width digits to ASCII digits."""
    return F.translate(col(c), vocab.FULLWIDTH_DIGITS, vocab.ASCII_DIGITS)


def ascii_alnum(c: Column | str) -> Column:
    """Full-width letters and digits to ASCII."""
    return F.translate(col(c), vocab.FULLWIDTH_ALNUM, vocab.ASCII_ALNUM)


# every character Unicode calls white space
SPACES = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())


def strip(c: Column | str) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def plain_spaces(c: Column | str) -> Column:
    """Every kind of white space as a plain space."""
    return F.translate(col(c), SPACES, " " * len(SPACES))


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times, also inside a lambda.

    A lambda body is evaluated per element and without common-subexpression
    elimination; the one-element array makes the value a variable.
    """
    return F.transform(F.array(value), body)[0]


def explode_kept(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per array element, rows without elements left out.

    A plain explode makes Catalyst filter on the array first, which works an
    expensive array out twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def blank_to_null(c: Column | str) -> Column:
    """Empty text to NULL."""
    return F.nullif(col(c), F.lit(""))


def no_value(c: Column | str) -> Column:
    """True for the three ways a source says "nothing": NULL, empty, a dash."""
    return F.coalesce(col(c).isin("", "-"), F.lit(True))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of the group, NULL when there is none (or it is empty)."""
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def contains_any(c: Column | str, words: list[str]) -> Column:
    """True when the text holds one of the words; NULL text counts as no.

    Plain substring tests: some ten times faster than one pattern of alternatives.
    """
    text = col(c)
    return F.coalesce(reduce(or_, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def first_word(c: Column | str, words: list[str]) -> Column:
    """The first word of the list (in list order) the text contains."""
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(F.contains(col(c), F.lit(word)), F.lit(word)).otherwise(found)
    return found


def or_default(c: Column | str, default) -> Column:
    return F.coalesce(col(c), F.lit(default))


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    """Double from plain decimal text; anything else is NULL."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), c.try_cast("double"))


def clean_text(c: Column | str, nullable: bool = True) -> Column:
    """Strip, collapse white space, and drop a literal none or an empty text."""
    stripped = F.btrim(plain_spaces(c))
    empty = F.lit(None).cast("string") if nullable else F.lit("")
    single = F.when(F.contains(stripped, F.lit("  ")), F.regexp_replace(stripped, " {2,}", " ")).otherwise(stripped)
    return F.when(col(c).isNull(), F.lit(None).cast("string")).when(
        F.lower(stripped).isin("none", ""), empty
    ).otherwise(single)


@lru_cache(maxsize=1)
def wide_class() -> str:
    """Regex class of the characters that take two columns.

    Built from the Unicode East Asian Width property (F, W and A) as ranges, so
    that the same class works in Java and in RE2.
    """
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or unicodedata.east_asian_width(chr(code)) not in "FWA":
            continue
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def display_width(c: Column | str) -> Column:
    """Width on a character grid, wide characters counting two."""
    text = col(c)
    return F.char_length(text) * 2 - F.char_length(F.regexp_replace(text, wide_class(), ""))


def truncate_display(c: Column | str, width: int) -> Column:
    """Longest head of the text that fits the width; NULL gives empty text.

    A character is at least one wide, so only the first ``width`` characters can
    be part of the answer and the fold below runs over those.
    """
    chars = F.split(F.substring(col(c), 1, width), "")
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"))

    def step(acc: Column, ch: Column) -> Column:
        used = acc["used"] + F.when(ch.rlike(wide_class()), 2).otherwise(1)
        out = F.when(used > width, acc["out"]).otherwise(F.concat(acc["out"], ch))
        return F.struct(used.alias("used"), out.alias("out"))

    return F.coalesce(F.aggregate(chars, start, step, lambda acc: acc["out"]), F.lit(""))


def display_value(c: Column | str) -> Column:
    """Text for people: a dash where there is nothing to show."""
    text = strip(col(c).cast("string"))
    return F.when(text.isNull() | F.lower(text).isin("none", ""), F.lit("-")).otherwise(text)


HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&yen;", "¥"), ("&copy;", "©"), ("&middot;", "·"), ("&times;", "×"),
    ("&sup2;", "²"), ("&hellip;", "…"), ("&amp;", "&"),
]


def unescape_html(c: Column | str) -> Column:
    """Decode the entities listing pages use in attributes, cells and headings."""
    def decode(v: Column) -> Column:
        out = v
        for entity, char in HTML_ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(v, F.lit("&")), out).otherwise(v)

    return let(col(c), decode)
