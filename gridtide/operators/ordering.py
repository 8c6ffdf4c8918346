"""Ordered computations that never gather a large series in one task.

A measured row count decides: keys whose rows fit one task use a plain window. Larger
ones are cut into order-preserving slices at quantiles of the ordering column; the
window runs inside each (keys, slice) and a small table with one row per slice carries
totals from slice to slice. A single time stamp that holds very many rows becomes a
slice of its own and is cut again along the next ordering column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from gridtide.functions.timeparts import epoch_us
from gridtide.session import cut_lineage

SLICE_ROWS = 4_000_000
MOST_SLICES = 4096
MOST_CUTS = 4_000_000  # numbers that are broadcast at most
FANOUT = 64


def largest_group(df: DataFrame, keys) -> int:
    """Row count of the biggest key; reads the key columns only."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    return counts.agg(F.max("_c")).first()[0] or 0


def add_slices(
    df: DataFrame, keys, value: Column, out: str, largest: int, sizing: DataFrame | None = None,
    slice_rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Adds an order-preserving slice number of a numeric value within the keys.

    Cut points are quantiles of ``sizing`` (by default the table itself), stored so that
    every later use sees the same ones. Values equal to a cut point get a slice of their
    own (odd numbers). Keys below the slice size stay whole. The flag tells whether some
    single value fills more than a slice: only then does it occur among the cuts twice.
    """
    slice_rows = SLICE_ROWS if slice_rows is None else slice_rows
    wanted = max(2, min(MOST_SLICES, -(-largest // slice_rows)))
    shares = [i / wanted for i in range(1, wanted)]
    keys = list(keys)
    source = (df if sizing is None else sizing).select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    if keys:  # the sketch is only worth its cost for keys that need cutting
        large = source.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") > slice_rows).drop("_c")
        source = source.join(large, keys)
    cuts = source.groupBy(*keys).agg(F.percentile_approx("_v", shares, 4 * wanted).alias("_cuts"))
    # Every FANOUT-th cut first, then the cuts in between: two short scans instead of a long one.
    coarse = F.filter("_cuts", lambda _, i: i % FANOUT == FANOUT - 1)
    cuts = cut_lineage(cuts.withColumn("_coarse", coarse))
    tied = F.max(F.size("_cuts") > F.size(F.array_distinct("_cuts")))
    crowded, held = cuts.agg(tied, F.sum(F.size("_cuts") + F.size("_coarse"))).first()
    crowded = bool(crowded)
    # Keys that are cut have many rows each; a shuffle by key would gather them in one task.
    known = F.broadcast(cuts) if (held or 0) <= MOST_CUTS else cuts
    joined = df.withColumn("_v", value)
    joined = joined.join(known, keys, "left") if keys else joined.join(F.broadcast(cuts), how="left")
    if wanted <= FANOUT:
        place = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    else:
        block = F.size(F.filter("_coarse", lambda c: c < F.col("_v")))
        place = block * FANOUT + F.size(F.filter(F.slice("_cuts", block * FANOUT + 1, FANOUT), lambda c: c < F.col("_v")))
    alone = F.coalesce(F.get("_cuts", place) == F.col("_v"), F.lit(False)).cast("int")
    number = F.when(F.col("_cuts").isNull() | F.col("_v").isNull(), 0).otherwise(2 * place + alone)
    return joined.withColumn(out, number).drop("_v", "_cuts", "_coarse"), crowded


def time_slices(df: DataFrame, keys, ts: str, order=(), sizing: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The table with slice columns for (ts, order), or unchanged if every key fits one task."""
    if keys:  # a missing key is no group
        df = df.na.drop(subset=list(keys))
    largest = largest_group(df if sizing is None else sizing, keys)
    if largest <= SLICE_ROWS:
        return df, []
    cut, crowded = add_slices(df, keys, epoch_us(ts), "_b", largest, sizing)
    slices = ["_b"]
    if crowded and order and isinstance(df.schema[order[0]].dataType, NumericType):
        crowd = largest_group(cut, [*keys, "_b"])
        if crowd > SLICE_ROWS:
            # Only slices of one single time may be cut along the next column.
            second = F.when(F.col("_b") % 2 == 1, F.col(order[0])).otherwise(0)
            cut, _ = add_slices(cut, [*keys, "_b"], second, "_b2", crowd)
            slices.append("_b2")
    return cut, slices


def previous_in_order(df: DataFrame, keys, ts: str, out: str = "previous", slices=()) -> DataFrame:
    """Adds the preceding row's time within the keys.

    Neighbours across a slice edge come from the last time of the nearest earlier slice.
    """
    inside = W.partitionBy(*keys, *slices).orderBy(ts)
    if not slices:
        return df.withColumn(out, F.lag(ts).over(inside))
    by = [*keys, *slices]
    ends = df.groupBy(*by).agg(F.max(ts).alias("_last"))
    between = W.partitionBy(*keys).orderBy(*slices)
    ends = ends.select(*by, F.lag("_last").over(between).alias("_before"))
    return (
        df.withColumn("_inside", F.lag(ts).over(inside))
        .join(ends, by)
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_inside", "_before")
    )


def running_sum(df: DataFrame, keys, order, amounts: dict[str, Column], slices=()) -> DataFrame:
    """Adds inclusive running sums in the given order within the keys."""
    inside = W.partitionBy(*keys, *slices).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    if not slices:
        return df.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in amounts.items()})
    by = [*keys, *slices]
    cut = df.withColumns({f"_a_{n}": c for n, c in amounts.items()})
    totals = cut.groupBy(*by).agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts])
    before = W.partitionBy(*keys).orderBy(*slices).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in amounts],
    )
    running = cut.withColumns({f"_r_{n}": F.sum(f"_a_{n}").over(inside) for n in amounts}).join(offsets, by)
    return running.withColumns({n: F.coalesce(f"_r_{n}", F.lit(0)) + F.col(f"_o_{n}") for n in amounts}).drop(
        *[f"_{p}_{n}" for p in "aro" for n in amounts],
    )


def position_in_order(df: DataFrame, keys, ts: str, order=(), out: str = "pos") -> DataFrame:
    """Adds the zero-based row number in (ts, order) within the keys."""
    cut, slices = time_slices(df, keys, ts, order)
    numbered = running_sum(cut, keys, [ts, *order], {out: F.lit(1).cast("bigint")}, slices)
    return numbered.withColumn(out, F.col(out) - 1).drop(*slices)


def time_deltas(df: DataFrame, keys, ts: str) -> DataFrame:
    """Positive gaps in seconds between consecutive times.

    Repeated times give zero gaps, which do not count, so distinct times suffice.
    """
    stamped = df.select(*keys, ts).where(F.col(ts).isNotNull())
    cut, slices = time_slices(stamped.distinct(), keys, ts, sizing=stamped)
    paired = previous_in_order(cut, keys, ts, "_prev", slices)
    return paired.where(F.col("_prev").isNotNull()).select(
        *keys, ts, ((epoch_us(ts) - epoch_us("_prev")) / F.lit(1000000.0)).alias("delta_seconds"),
    )


def islands(df: DataFrame, keys, ts: str, gap_hours: int = 48) -> DataFrame:
    """Groups of times less than ``gap_hours`` apart: start, end, size."""
    cut, slices = time_slices(df.select(*keys, ts).where(F.col(ts).isNotNull()), keys, ts)
    paired = previous_in_order(cut, keys, ts, "_prev", slices)
    gap = epoch_us(ts) - epoch_us("_prev")
    opens = F.when(F.col("_prev").isNull() | (gap >= gap_hours * 3600 * 1000000), 1).otherwise(0)
    labelled = running_sum(paired, keys, [ts], {"island": opens.cast("bigint")}, slices)
    return labelled.groupBy(*keys, "island").agg(
        F.min(ts).alias("island_start"), F.max(ts).alias("island_end"), F.count("*").alias("island_size"),
    )


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per keys in the given order (U6); one aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def best_row(df: DataFrame, score: str, keys=(), largest: bool = False) -> DataFrame:
    """Row with the smallest (or largest) score, overall or per keys."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    found = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(pick(F.struct(*rest), F.col(score)).alias("_row"))
    return found.where(F.col("_row").isNotNull()).select(*keys, "_row.*")


def series_lengths(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_n"))


def with_length(df: DataFrame, keys) -> DataFrame:
    """Adds the row count of the keys as ``_n``."""
    lengths = series_lengths(df, keys)
    if keys:
        return df.join(lengths, list(keys))
    return df.join(F.broadcast(lengths))  # a keyless aggregate is one row


def chronological_split(df: DataFrame, keys, ts: str, order=(), test_size: float = 0.2) -> DataFrame:
    """Adds ``part`` = train for the first ``int(n * (1 - test_size))`` rows, else test."""
    placed = with_length(position_in_order(df, keys, ts, order), keys)
    cut = (F.col("_n") * F.lit(1 - test_size)).cast("bigint")
    return placed.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("test")).drop("_n")


def expanding_folds(df: DataFrame, keys, ts: str, k: int, order=()) -> DataFrame:
    """Copies of each row tagged with ``fold`` and ``role`` for expanding time folds.

    Test blocks have ``n // (k + 1)`` rows and close the series; everything before
    a block trains for it. Each row appears at most ``k`` times.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    placed = with_length(position_in_order(df, keys, ts, order), keys)
    size = F.floor(F.col("_n") / (k + 1))
    begin = F.col("_n") - (F.lit(k) - F.col("fold")) * size
    role = F.when(F.col("pos") < begin, "train").when(F.col("pos") < begin + size, "test")
    spread = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spread.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n")


def top_rows(df: DataFrame, order, n: int, keys=()) -> DataFrame:
    """First ``n`` rows in order, overall (S3) or per keys with ``rank``.

    The rank filter is pushed below the shuffle, so a hot key sends ``n`` rows per task.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    numbered = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col("rank") <= n)


def random_rows(df: DataFrame, n: int = 20, seed: int = 12, by=None) -> DataFrame:
    """A random sample of exactly ``n`` rows (S5), the same whatever the partitioning.

    Kept are the rows whose hash of ``seed`` and the columns ``by`` (all, if not given) is least, so each task keeps
    ``n`` at most. Rows that agree in these columns go in or out together, but for the last place.
    """
    columns = list(df.columns if by is None else by)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.orderBy(F.md5(text.cast("binary"))).limit(n)


def expanding_distinct(
    df: DataFrame, kinds: list[str], kind: str, name: str, ts: str, order: str,
) -> DataFrame:
    """Per row, how many distinct names of each kind appeared so far.

    The first row of every (kind, name) comes from one aggregate; the counts are
    running sums of those flags over slices of time.
    """
    firsts = df.groupBy(kind, name).agg(F.min(F.struct(ts, order)).alias("_f")).select(
        kind, name, F.col(f"_f.{ts}").alias(ts), F.col(f"_f.{order}").alias(order), F.lit(1).alias("_new"),
    )
    flagged = df.join(firsts, [kind, name, ts, order], "left")
    amounts = {
        f"unique_count_{k}": F.when((F.col(kind) == k) & F.col("_new").isNotNull(), 1).otherwise(0).cast("bigint")
        for k in kinds
    }
    cut, slices = time_slices(flagged, [], ts, (order,), sizing=df)
    return running_sum(cut, [], [ts, order], amounts, slices).drop("_new", *slices)
