"""URL forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keystead.functions.text import blank_to_null, col, extract

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(c: Column | str, group: int) -> Column:
    """Scheme 1, host 2, path 3, query 4, fragment 5; empty when absent."""
    return F.regexp_extract(col(c), _PARTS, group)


def canonical_url(c: Column | str) -> Column:
    """scheme://host/path: query and fragment dropped."""
    return F.concat(url_part(c, 1), F.lit("://"), url_part(c, 2), url_part(c, 3))


def base_parts(base: Column | str) -> Column:
    """What a link is resolved against, taken apart once per page."""
    path = url_part(base, 3)
    return F.struct(
        url_part(base, 1).alias("scheme"),
        F.concat(url_part(base, 1), F.lit("://"), url_part(base, 2)).alias("root"),
        path.alias("path"),
        F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "").alias("folder"),
        F.regexp_replace(col(base), "#.*$", "").alias("page"),
    )


def resolve(href: Column, base: Column) -> Column:
    """A link made absolute against the parts of its page."""
    h = href
    joined = F.when(h.startswith("/"), h).otherwise(F.concat(base["folder"], h))
    dotted = joined
    for _ in range(3):  # dot segments; three levels up is as far as real pages go
        dotted = F.regexp_replace(dotted, r"/\./", "/")
        dotted = F.regexp_replace(dotted, r"/(?!\.\./)[^/?#]+/\.\./", "/")
    return (
        F.when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
        .when(h.startswith("?"), F.concat(base["root"], base["path"], h))
        .when(h.startswith("#"), F.concat(base["page"], h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(~F.contains(h, F.lit("./")), F.concat(base["root"], joined))
        .otherwise(F.concat(base["root"], dotted))
    )


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """A link made absolute against the page it stands on."""
    return resolve(col(href), base_parts(base))


def next_page_url(c: Column | str) -> Column:
    """The same list one page on: ``page`` raised by one, or set to 2.

    Parameters without a value are dropped and a parameter keeps the place of
    its first occurrence, as a parsed and rebuilt query string would.
    """
    query = url_part(c, 4)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+"))
    first = F.get(F.filter(pairs, lambda p: p.startswith("page=")), F.lit(0))
    place = F.array_position(pairs, first)
    pairs = F.filter(pairs, lambda p, i: ~p.startswith("page=") | (i + 1 == place))
    page = F.coalesce(extract(query, "(?:^|&)page=([0-9]+)(?:&|$)").try_cast("bigint"), F.lit(1))
    new = F.concat(F.lit("page="), (page + 1).cast("string"))
    has_page = F.exists(pairs, lambda p: p.startswith("page="))
    rebuilt = F.when(
        has_page, F.transform(pairs, lambda p: F.when(p.startswith("page="), new).otherwise(p))
    ).otherwise(F.array_append(pairs, new))
    fragment = url_part(c, 5)
    return F.when(
        blank_to_null(col(c)).isNotNull(),
        F.concat(
            canonical_url(c), F.lit("?"), F.array_join(rebuilt, "&"),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
        ),
    )
