"""URL verdicts from host and path rules: a range join swept in the order of reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtide.llm.tables import stored

PER_BUCKET = 100_000  # urls that one task sweeps


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the top level down, each followed by a dot: a domain and all below it share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacks(rules: DataFrame) -> DataFrame:
    """For every ruled host its key range [``low``, ``high``) and ``stack``: its rules and those of the domains above it.

    The stack lists the longest host first, then the longest path; equal rules with different verdicts block.
    A rule whose host is empty holds for every url.
    """
    one = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = one.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = one.select("host").distinct().select("host", F.explode(F.array_union(above, F.array(F.lit("")))).alias("domain"))
    item = F.struct((-F.length("domain")).alias("h"), (-F.length("path")).alias("p"), F.col("domain").alias("host"), "path", "verdict")
    found = hosts.join(one.withColumnRenamed("host", "domain"), "domain").groupBy("host").agg(F.sort_array(F.collect_list(item)).alias("stack"))
    low = F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host")))
    # '/' is the character after '.', so the range ends behind the last key that starts with the host's key
    high = F.when(F.col("host") == "", F.lit("\U0010ffff")).otherwise(F.concat(F.expr("left({0}, length({0}) - 1)".format("k")), F.lit("/")))
    return found.withColumn("low", low).withColumn("k", F.col("low")).withColumn("high", high).select("low", "high", "stack")


def _met(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """``intervals`` with the first and last range, ``from`` and ``to``, that may hold keys from ``low`` to ``high``; others go.

    Both tables are small beside the rows: one row a ruled host, and one a range. They are sorted together once for each end.
    """

    def sweep(ends: DataFrame, end: str, keys: str, before: int) -> DataFrame:
        marks = ranges.select(F.col(keys).alias("at"), F.lit(1 - before).alias("kind"), F.col("part").alias("range"))
        both = ends.withColumn("at", F.col(end)).withColumn("kind", F.lit(before)).unionByName(marks, allowMissingColumns=True)
        line = Window.orderBy("at", "kind", F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("seen", F.max("range").over(line)).where(F.col("kind") == before).drop("at", "kind", "range")

    begun = sweep(intervals, "low", "last", 0).withColumn("from", F.coalesce(F.col("seen") + 1, F.lit(0))).drop("seen")  # behind the last range that ends before
    ended = sweep(begun, "high", "first", 1).withColumn("to", F.col("seen")).drop("seen")  # the last range that begins at it or before
    return ended.where("from <= to")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``pages``.

    A rule (``host``, ``path``, ``verdict`` allow or block) fits its host and all subdomains if the url's path
    starts with the rule's; of several the longest host wins, then the longest path. ``rule`` is null and the
    verdict ``default`` where none fits. Null urls and urls without ``://`` have empty host and path.

    Rows are dealt by range of (key, tie), where the tie hashes the row: a host or url that holds any share of the rows is
    spread over as many ranges as it fills. The ranges are written once; each ruled host joins those that its interval
    meets, which a sweep over the ranges' first and last keys tells. Within a range rows and intervals are
    swept in key order, the last interval begun carrying the stack of those that enclose it: intervals of
    domains nest, so what is active at a row is that stack less the intervals that ended before the row.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    parts = max(1, -(-pages.count() // PER_BUCKET))
    dealt = stored(rows.repartitionByRange(parts, "key", "tie").withColumn("part", F.spark_partition_id()), "url-ranges")
    ranges = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ruled = stored(_met(stacks(rules), ranges), "url-rules")
    begun = ruled.withColumn("part", F.explode(F.sequence("from", "to")))
    swept = dealt.drop("tie").withColumn("begins", F.lit(1))
    begun = begun.select("part", F.col("low").alias("key"), F.lit(0).alias("begins"), F.struct("high", "stack").alias("open"))
    in_order = Window.partitionBy("part").orderBy("key", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = swept.unionByName(begun, allowMissingColumns=True).withColumn("open", F.last("open", ignorenulls=True).over(in_order))
    # of the enclosing rules those still open at the key whose path fits; the first is the longest
    fits = F.filter(
        "open.stack",
        lambda r: F.col("path").startswith(r["path"])
        & ((r["host"] == "") | (F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))),
    )
    won = F.get(fits, F.lit(0))
    return (
        both.where("begins = 1")
        .withColumn("won", won)
        .select("page_id", "host", "path", F.concat("won.host", "won.path").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
    )


def rule_table(spark, lines: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path) tuples."""
    return spark.createDataFrame([(h, p, v) for v, h, p in lines], "host string, path string, verdict string")
