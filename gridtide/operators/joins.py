"""Date joins and column reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridtide.functions.timeparts import truncate

JOIN_KINDS = ("outer", "inner", "left", "right")
DUPLICATE_RULES = ("suffix", "prefix", "overwrite")


def shared_columns(tables: dict[str, DataFrame], skip=()) -> set[str]:
    """Column names present in more than one table."""
    seen: dict[str, int] = {}
    for df in tables.values():
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
    return {c for c, n in seen.items() if n > 1} - set(skip)


def resolve_duplicates(tables: dict[str, DataFrame], key: str, rule: str = "suffix") -> dict[str, DataFrame]:
    """Make non-key column names unique across tables.

    ``suffix`` and ``prefix`` add the table name; with ``overwrite`` the last table
    that has a column keeps it.
    """
    if rule not in DUPLICATE_RULES:
        raise ValueError(f"unknown duplicate rule {rule!r}")
    shared = shared_columns(tables, skip=(key,))
    if rule == "overwrite":
        owner = {c: name for name, df in tables.items() for c in df.columns}
        return {
            name: df.drop(*[c for c in df.columns if c in shared and owner[c] != name])
            for name, df in tables.items()
        }
    pattern = "{c}_{n}" if rule == "suffix" else "{n}_{c}"
    return {
        name: df.withColumnsRenamed({c: pattern.format(c=c, n=name) for c in df.columns if c in shared})
        for name, df in tables.items()
    }


def join_by_time(
    tables: dict[str, DataFrame], key: str, how: str = "outer", resolution: str = "exact",
    rule: str = "suffix", match_nulls: bool = False,
) -> DataFrame:
    """Left fold of joins on a truncated time column.

    Rows that collapse onto one truncated time pair up with each other, so roll
    fine tables up first. With ``match_nulls`` a missing time equals a missing time.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}")
    if not tables:
        raise ValueError("no tables to join")
    ready = [
        df.withColumn(key, truncate(F.col(key).cast("timestamp_ntz"), resolution))
        for df in resolve_duplicates(tables, key, rule).values()
    ]

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        if not match_nulls:
            return a.join(b, key, how)
        b = b.withColumnRenamed(key, "_other")
        merged = a.join(b, a[key].eqNullSafe(b["_other"]), how)
        kept = {"left": F.col(key), "right": F.col("_other")}.get(how, F.coalesce(key, "_other"))
        return merged.withColumn(key, kept).drop("_other")

    return reduce(pair, ready)


def join_with_suffixes(
    left: DataFrame, right: DataFrame, on, left_suffix: str, right_suffix: str, how: str = "inner", always: bool = False,
) -> DataFrame:
    """Equi-join whose shared non-key columns get a suffix per side.

    With ``always`` every non-key column gets its suffix.
    """
    on = [on] if isinstance(on, str) else list(on)
    shared = {c for c in left.columns if c in right.columns} - set(on)

    def tag(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in on and (always or c in shared)})

    return tag(left, left_suffix).join(tag(right, right_suffix), on, how)


def align_sources(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Inner join on the columns two sources share, as ``_df1`` and ``_df2``."""
    common = [c for c in first.columns if c in second.columns]
    return join_with_suffixes(first.select(common), second.select(common), on, "_df1", "_df2")


def join_on(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join (C4, C6); measured sizes decide on broadcast or shuffle."""
    return left.join(right, on, how)


def absent_from(expected: DataFrame, actual: DataFrame, on) -> DataFrame:
    """Expected keys that do not occur."""
    on = [on] if isinstance(on, str) else list(on)
    return expected.join(actual.select(*on), on, "left_anti")


def name_by_id(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Look up names by numeric id."""
    return df.join(names, key)


def align_predictions(actual: DataFrame, predicted: DataFrame, ts: str) -> DataFrame:
    """Actual and predicted values side by side, either may be missing (C11)."""
    return actual.join(predicted, ts, "full_outer")


def union_tables(tables) -> DataFrame:
    """Row union with columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def drop_empty_rows(df: DataFrame, columns=None, how: str = "all") -> DataFrame:
    """Drop rows whose columns are all (or any) null."""
    return df.na.drop(how=how, subset=list(columns) if columns else None)
