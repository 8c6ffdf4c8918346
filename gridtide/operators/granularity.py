"""Sampling step detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gridtide.functions.columns import confidence_word, fixed_text, interval_text
from gridtide.operators.ordering import time_deltas

# Named steps and their length in seconds.
NAMED_STEPS = [
    ("Millisecond", 0.001),
    ("Second", 1),
    ("Minute", 60),
    ("5-Minute", 300),
    ("15-Minute", 900),
    ("30-Minute", 1800),
    ("Hourly", 3600),
    ("2-Hourly", 7200),
    ("4-Hourly", 14400),
    ("6-Hourly", 21600),
    ("12-Hourly", 43200),
    ("Daily", 86400),
    ("Weekly", 604800),
    ("Monthly", 2592000),
    ("Quarterly", 7776000),
    ("Yearly", 31536000),
]
TOLERANCE = 0.1


def delta_counts(df: DataFrame, keys, ts: str) -> DataFrame:
    """How often each gap between consecutive times occurs."""
    return time_deltas(df, keys, ts).groupBy(*keys, "delta_seconds").agg(F.count("*").alias("n"))


def common_deltas(df: DataFrame, keys, ts: str, top: int = 5) -> DataFrame:
    """The most frequent gaps per keys, ranked."""
    counts = delta_counts(df, keys, ts)
    order = [F.desc("n"), F.asc("delta_seconds")]
    if not keys:
        counts = counts.orderBy(*order).limit(top)
    line = W.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)


def detect_step(df: DataFrame, keys, ts: str) -> DataFrame:
    """Nearest named step, confidence and details per keys.

    The modal gap decides, the smaller one on ties. Confidence is its share, reduced
    when the gap is more than 10 % off the named step and halved when over half of
    the gaps differ from each other. Keys without a positive gap give no row.
    """
    counts = delta_counts(df, keys, ts)
    found = counts.groupBy(*keys).agg(
        F.sum("n").alias("total_intervals"),
        F.count("*").alias("unique_deltas"),
        F.min_by("delta_seconds", F.struct(-F.col("n"), F.col("delta_seconds"))).alias("modal_delta_seconds"),
        F.max("n").alias("matching_intervals"),
    ).where(F.col("total_intervals") > 0)
    modal = F.col("modal_delta_seconds")
    candidates = F.array(
        *[
            F.struct(
                F.abs(modal - F.lit(float(seconds))).alias("off"),
                F.lit(place).alias("place"),
                F.lit(name).alias("name"),
                F.lit(float(seconds)).alias("seconds"),
            )
            for place, (name, seconds) in enumerate(NAMED_STEPS)
        ],
    )
    found = found.withColumn("_near", F.array_min(candidates))
    share = F.col("matching_intervals") / F.col("total_intervals")
    relative = F.col("_near.off") / F.col("_near.seconds")
    scored = found.withColumn(
        "confidence_score",
        F.when(relative > TOLERANCE, share * F.greatest(F.lit(0.1), 1 - relative)).otherwise(share),
    )
    irregular = F.col("unique_deltas") > F.col("total_intervals") * 0.5
    name = F.col("_near.name")
    scored = scored.withColumns(
        {
            "granularity": F.when(irregular, F.concat(F.lit("Irregular ("), name, F.lit("-like)")))
            .when(F.col("confidence_score") < 0.7, F.concat(F.lit("Mixed ("), name, F.lit("-dominant)")))
            .otherwise(name),
            "confidence": F.when(irregular, F.col("confidence_score") * 0.5).otherwise(F.col("confidence_score")),
        },
    )
    return scored.select(
        *keys, "granularity", "confidence", confidence_word("confidence").alias("confidence_level"),
        "modal_delta_seconds", interval_text("modal_delta_seconds").alias("modal_delta_text"), "confidence_score",
        "total_intervals", "matching_intervals", "unique_deltas",
    )


def describe_step(steps: DataFrame) -> DataFrame:
    """Adds the display text of a detected step."""
    head = F.format_string(
        "**%s** (Confidence: %s - %s%%)",
        F.col("granularity"), F.col("confidence_level"), fixed_text(F.col("confidence") * 100, 1),
    )
    lines = [
        head,
        F.concat(F.lit("\n- Most common interval: "), F.col("modal_delta_text")),
        F.format_string("\n- %d/%d intervals match", F.col("matching_intervals"), F.col("total_intervals")),
        F.when(
            F.col("unique_deltas") > 1,
            F.format_string("\n- %d different interval types detected", F.col("unique_deltas")),
        ).otherwise(""),
    ]
    text = F.concat(*lines)
    return steps.withColumn(
        "info", F.when(F.col("confidence") == 0, F.concat(F.lit("⚠️ "), F.col("granularity"))).otherwise(text),
    )
