"""Registered queries: a Spark job each, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def doubles(sql: str) -> str:
    """Number literals with a point as doubles, outside of quoted text.

    The jobs compute in doubles; DuckDB would take such literals for decimals.
    """
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts[::2]]
    return "'".join(parts)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests and row count only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = doubles(sql)
        return fn

    return add


# --- pieces of SQL the checks share -------------------------------------------

FULL = "'０１２３４５６７８９'"
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def asc(x: str) -> str:
    """Digits in ASCII."""
    return f"translate({x}, {FULL}, '0123456789')"


def rex(x: str, pattern: str, group: int = 1) -> str:
    """First match of a group or NULL."""
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def num(x: str, pattern: str, group: int = 1) -> str:
    return f"try_cast({rex(x, pattern, group)} as double)"


def whole(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def has(x: str, words: list[str]) -> str:
    """True when the text holds one of the words."""
    tests = " or ".join(f"contains({x}, '{w}')" for w in words)
    return f"coalesce({tests}, false)"


def first_of(x: str, words: list[str]) -> str:
    return "(case " + " ".join(f"when contains({x}, '{w}') then '{w}'" for w in words) + " end)"


def values(x: str, table: dict) -> str:
    return "(case " + " ".join(f"when {x} = '{k}' then cast({v} as double)" for k, v in table.items()) + " end)"
