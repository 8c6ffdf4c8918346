"""Name to (Spark query, SQL text) registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# Sums of floats differ in their last bits with the order of rows. A shift far below the
# rounding step, the same on both sides, keeps exact halves from falling either way.
SHIFT = 1.37


def steady_round(c: Column, digits: int = 6) -> Column:
    """Rounded, free of negative zero, and the same whatever the order of summation."""
    return F.round(c + F.lit(float(f"{SHIFT}e-{digits + 3}")), digits) + F.lit(0.0)


def steady_sql(sql: str) -> str:
    """The shift of ``steady_round`` put into every ``round(expression, digits)`` of a text."""
    found = re.search(r"\bround\(", sql)
    if not found:
        return sql
    depth, comma, at = 1, None, found.end()
    while depth:
        if sql[at] in "([":
            depth += 1
        elif sql[at] in ")]":
            depth -= 1
        elif sql[at] == "," and depth == 1:
            comma = at
        at += 1
    inner, digits = steady_sql(sql[found.end() : comma]), int(sql[comma + 1 : at - 1])
    return f"{sql[: found.end()]}({inner}) + {SHIFT}e-{digits + 3}, {digits}){steady_sql(sql[at:])}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = steady_sql(sql)
        return fn

    return add
