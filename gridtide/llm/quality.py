"""Importance resampling of documents: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.tables import free_name, stored, text_slices
from gridtide.llm.words import LOWER, mixed, span_hashes, split_words, sums_by_text

BUCKETS = 1 << 17
SLOTS = 8  # models: one for each of the most frequent languages, the last for all others
PREFIX = 5
GROUPS = ("target", "low", "toxic")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a run of texts' words and of the words' first ``PREFIX`` bytes, and where each text's begin."""
    words = split_words(data, offsets)
    stems = span_hashes(LOWER[data], words.start, np.minimum(words.start + PREFIX, words.end)) + np.uint64(7)
    both = np.stack([words.hash, stems], axis=1).ravel()
    return (mixed(both) >> np.uint64(64 - 17)).astype(np.int64), 2 * words.first


@dataclass
class Model:
    """By language slot: log ratios of each group's bucket probability to the language's, and the groups' shares of documents."""

    ratio: np.ndarray  # slots x buckets x groups, float32
    share: np.ndarray  # slots x groups
    pooled: float  # the target's share of all labelled documents

    def weights(self, data: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log importance weight log p(text, slot | target) - log p(text, slot | raw), and the target's posterior share.

        The slot's own part is its target share over that of all slots, so weights of different languages compare.
        """
        bucket, first = grams(data, offsets)
        place = np.repeat(slot, np.diff(first)) * BUCKETS + bucket
        flat = self.ratio.reshape(-1, len(GROUPS))
        fit = np.stack([sums_by_text(flat[place, k].astype(np.float64), first) for k in range(len(GROUPS))], axis=1)
        together = fit + np.log(self.share[slot])
        top = together.max(axis=1)
        raw = top + np.log(np.exp(together - top[:, None]).sum(axis=1))
        weight = fit[:, 0] - raw
        of_slot = np.log(self.share[slot, 0])
        return weight + of_slot - np.log(self.pooled), np.exp(np.minimum(0.0, weight + of_slot))


def labelled_groups(labels: DataFrame, most: int, id_col: str = "doc_id") -> pd.DataFrame:
    """``doc_id``, ``kind`` (place in GROUPS) of about ``most`` labelled documents at most, picked by a hash of the id.

    A document labelled several times counts by its worst labels; null labels say nothing against it.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    every = max(1, -(-one.count() // most))
    kind = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0)
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", kind.cast("int").alias("kind")).toArrow().to_pandas()


def languages(docs: DataFrame) -> list[str]:
    """The most frequent values of ``lang``, fewer than ``SLOTS``; none without such a column."""
    if "lang" not in docs.columns:
        return []
    counts = docs.groupBy(F.col("lang").cast("string").alias("lang")).count().where("lang is not null")
    return [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(SLOTS - 1).collect()]


def _with_slot(docs: DataFrame, known: list[str]) -> DataFrame:
    slot = F.lit(SLOTS - 1)
    for i, name in enumerate(known):
        slot = F.when(F.col("lang").cast("string") == name, i).otherwise(slot)
    return docs.select(F.col("doc_id").cast("long"), slot.cast("int").alias("slot"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, known_languages: list[str], most_labels: int = 50_000, pull: float = 2.0, doubt: float = 2.0) -> Model | None:
    """Bucket counts over all documents and over the labelled groups, by language.

    The corpus model counts every document. The groups are fitted on at most about ``most_labels`` labelled
    documents. A group's bucket is pulled towards its expected count under the corpus model by ``pull``
    pseudo-grams, and its log ratio shrunk by ``doubt`` standard errors, so that the noise of many rare buckets
    does not outweigh a few telling ones. Raw text is a mixture of the groups: one bag of grams for good, low
    and toxic text together would hide the telling grams among the common ones. Languages are apart, since a
    group's share of a language says nothing about a text. A language without target labels, and the slot that all
    rarer languages and rows without one share, take a model of all labelled documents together: its corpus model
    counts these alone, so that words no label speaks of say nothing for or against a text. Without any target
    label there is no model (None).
    """
    known = labelled_groups(labels, most_labels).sort_values("doc_id")
    ids, kinds = known["doc_id"].to_numpy(np.int64), known["kind"].to_numpy(np.int64)
    if not (kinds == 0).any():
        return None
    names = ("raw", *GROUPS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SLOTS * BUCKETS
        totals = np.zeros((4, size), np.int64)
        docs_of = np.zeros((SLOTS, 3), np.int64)
        for batch in batches:
            doc = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            slot = batch.column(1).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            kind = np.where(ids[at] == doc, kinds[at], -1)
            np.add.at(docs_of, (slot[kind >= 0], kind[kind >= 0]), 1)
            for row, data, offsets in text_slices(batch.column(2)):
                bucket, first = grams(data, offsets)
                rows = slice(row, row + len(offsets) - 1)
                bucket = np.repeat(slot[rows], np.diff(first)) * BUCKETS + bucket
                np.add.at(totals[0], bucket, 1)
                of_gram = np.repeat(kind[rows], np.diff(first))
                for k in range(3):
                    np.add.at(totals[k + 1], bucket[of_gram == k], 1)
        some = np.flatnonzero(totals[0])
        out = np.concatenate([totals[:, some], np.concatenate([np.zeros((1, SLOTS), np.int64), docs_of.T])], axis=1)
        place = np.concatenate([some, size + np.arange(SLOTS)])
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(t) for t in out)], names=["bucket", *names])

    rows = _with_slot(docs, known_languages).mapInArrow(count, "bucket long, raw long, target long, low long, toxic long")
    seen = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    totals = np.zeros((4, (SLOTS + 1) * BUCKETS))
    place = seen["bucket"].to_numpy()
    for i, c in enumerate(names):
        totals[i, place] = seen[c].to_numpy()
    del seen, place
    docs_of = totals[1:, SLOTS * BUCKETS : SLOTS * BUCKETS + SLOTS].T
    totals = totals[:, : SLOTS * BUCKETS].reshape(4, SLOTS, BUCKETS)
    ratio = np.zeros((SLOTS, BUCKETS, len(GROUPS)), np.float32)
    pooled, pooled_docs = totals[1:].sum(axis=1), docs_of.sum(axis=0)
    for slot in range(SLOTS):
        raw, groups = totals[0, slot], totals[1:, slot]
        if not docs_of[slot, 0] or (slot == SLOTS - 1 and known_languages):
            raw, groups, docs_of[slot] = pooled.sum(axis=0), pooled, pooled_docs
        base = (raw + 1) / (raw.sum() + BUCKETS)
        for k in range(len(GROUPS)):
            counted = groups[k]
            expected = counted.sum() * base + pull
            r = np.log((counted + pull) / expected)
            ratio[slot, :, k] = np.sign(r) * np.maximum(0, np.abs(r) - doubt / np.sqrt(expected))
    share = (docs_of + 1) / (docs_of.sum(axis=1, keepdims=True) + 3)
    return Model(ratio, share, (pooled_docs[0] + 1) / (pooled_docs.sum() + 3))


def importance(
    docs: DataFrame, labels: DataFrame, temperature: float = 0.1, keep: int | None = None, seed: int = 7, most_labels: int = 50_000, row_col: str | None = None
) -> DataFrame:
    """``doc_id``, ``log_weight``, ``target_share``, ``noisy_weight``, ``kept`` for every row of ``docs``.

    ``noisy_weight`` adds Gumbel noise times ``temperature``, drawn from a hash of the id, and the ``keep``
    largest are kept: a draw without replacement in proportion to weight ** (1 / temperature). By default
    as many are kept as have a target share of one half or more. All rows that tie with the last one kept
    are kept too. Null and blank texts have the weight of their language alone. Rows without id share one noise value.
    Without any target label every row is kept with log weight 0. Columns besides id, text and ``lang``
    (which may be missing or null) are ignored. With ``row_col`` rows are told by that column: ``doc_id`` of the result is its
    value, and only labels are looked up by id.
    """
    spoken = languages(docs)
    model = fit(docs, labels, spoken, most_labels)
    docs = docs if row_col is None else docs.withColumn("doc_id", F.col(row_col))
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("log_weight"), F.lit(1.0).alias("target_share"), F.lit(0.0).alias("noisy_weight"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(1).to_numpy().astype(np.int64)
            found = [shared.value.weights(data, offsets, slot[row : row + len(offsets) - 1]) for row, data, offsets in text_slices(batch.column(2))]
            weight = np.concatenate([f[0] for f in found] or [np.zeros(0)])
            share = np.concatenate([f[1] for f in found] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(share)], names=["doc_id", "log_weight", "target_share"])

    scored = _with_slot(docs, spoken).mapInArrow(score, "doc_id long, log_weight double, target_share double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    noisy = F.col("log_weight") - F.log(-F.log(uniform)) * F.lit(float(temperature))
    scored = stored(scored.withColumn("noisy_weight", noisy), "importance")
    if keep is None:
        keep = scored.where("target_share >= 0.5").count()
    return scored.withColumn("kept", F.col("noisy_weight") >= F.lit(kth_largest(scored, "noisy_weight", keep)))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value, by counting in ever finer ranges; only counts, and at the end ``few`` values, reach the driver.

    Infinite if ``k`` is 0, the least value if there are fewer than ``k``.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return low
    left = k
    while True:
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if n <= few or width <= abs(high) * 1e-15 or width == 0.0:
            values = [r[0] for r in inside.groupBy(column).count().orderBy(F.desc(column)).limit(few).select(F.array(column, F.col("count").cast("double"))).collect()]
            for value, times in values:
                left -= int(times)
                if left <= 0:
                    return value
            return values[-1][0]
        number = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        counts = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(counts, key=lambda r: -r["bin"]):
            if b["n"] >= left:
                low, high, n = b["low"], b["high"], b["n"]
                break
            left -= b["n"]


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`importance` keeps. Labels are known by id; of a repeated id every row has them.

    Judged are rows: one without id or with a repeated one by its own text.
    """
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    row = free_name(docs, "_row")
    numbered = docs.withColumn(row, F.col("doc_id").cast("long")) if n == ids == distinct else stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = importance(numbered, labels, row_col=row, **options)
    return numbered.join(judged.where("kept").select(F.col("doc_id").alias(row)).hint("merge"), row, "left_semi").select(*docs.columns)
