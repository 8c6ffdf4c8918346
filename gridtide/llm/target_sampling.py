"""Importance resampling towards a target text, over word runs dealt into CRC-32 buckets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridtide.llm.tables import stored, text_slices
from gridtide.llm.words import LOWER

REACH = 64  # distances from the end that the position table covers
PIECE = 1 << 20  # span bytes looked up at once
SEPARATOR = np.zeros(256, dtype=bool)  # on lower-cased bytes: all of ASCII but digits and small letters
SEPARATOR[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_ONES = np.uint32(0xFFFFFFFF)


@cache
def position_table() -> np.ndarray:
    """What byte b at distance d from the end adds to a CRC-32, at ``[d * 256 + b]``.

    The register is linear in the message, so a message's value is the XOR of its bytes' own values and a
    constant of its length.
    """
    last = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [last]
    for _ in range(REACH - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ last[rows[-1] & np.uint32(255)])
    return np.concatenate(rows)


@cache
def length_constants() -> np.ndarray:
    """CRC-32 of as many zero bytes as the index says."""
    return np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


@cache
def zeros_operator(power: int) -> np.ndarray:
    """4 x 256 table: the register ``byte << 8 * k`` after 2 ** ``power`` further zero bytes."""
    if power == 0:
        value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return (value >> np.uint32(8)) ^ position_table()[:256][value & np.uint32(255)]
    half = zeros_operator(power - 1)
    return moved(half, power - 1)


def moved(register: np.ndarray, power: int) -> np.ndarray:
    """Registers after 2 ** ``power`` zero bytes."""
    table, low = zeros_operator(power), np.uint32(255)
    return table[0][register & low] ^ table[1][register >> np.uint32(8) & low] ^ table[2][register >> np.uint32(16) & low] ^ table[3][register >> np.uint32(24)]


def _short(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The linear part of the CRC of spans of 1 to ``REACH`` bytes: table lookups XORed span by span."""
    out = np.empty(len(start), np.uint32)
    table, size = position_table(), end - start
    total = np.cumsum(size)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, side="right")))
        n, first = size[at:to], total[at:to] - size[at:to] - (total[at - 1] if at else 0)
        place = np.arange(int(n.sum()), dtype=np.int32)
        byte = data[place + np.repeat((start[at:to] - first).astype(np.int32), n)]
        distance = np.repeat((first + n - 1).astype(np.int32), n) - place
        out[at:to] = np.bitwise_xor.reduceat(table[distance << 8 | byte], first)
        at = to
    return out


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 (as :func:`zlib.crc32`) of the byte spans ``data[start:end]``, which may overlap and be empty.

    Spans of up to ``REACH`` bytes take one lookup a byte. Longer ones are cut into blocks of ``REACH`` bytes from
    their end; each block's value is moved by the bytes behind it, doubling the width of a block per round, so the
    rounds grow with the logarithm of the longest span.
    """
    size = end - start
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= REACH))
    out[size <= REACH] = length_constants()[size[size <= REACH]]
    if len(short):
        out[short] ^= _short(data, start[short], end[short])
    long = np.flatnonzero(size > REACH)
    if len(long):
        blocks = -(-size[long] // REACH)
        span = np.repeat(np.arange(len(long)), blocks)
        number = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # 0 is the last block of a span
        right = end[long][span] - number * REACH
        value = _short(data, np.maximum(start[long][span], right - REACH), right)
        power = REACH.bit_length() - 1
        while len(span) > len(long):
            odd = np.flatnonzero(number & 1)
            value[odd - 1] ^= moved(value[odd], power)
            keep = number & 1 == 0
            span, number, value = span[keep], number[keep] >> 1, value[keep]
            power += 1
        begin, bit = np.full(len(long), _ONES), 0
        while (size[long] >> bit).any():
            some = (size[long] >> bit & 1).astype(bool)
            begin[some] = moved(begin[some], bit)
            bit += 1
        out[long] = value ^ begin ^ _ONES
    return out


def word_runs(data: np.ndarray, offsets: np.ndarray, most: int = 3, buckets: int = 10_000) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and (text, bucket) of every run of 1 to ``most`` consecutive words, one run length at a time.

    Words are runs of digits, small letters and bytes beyond ASCII, once A-Z are lower-cased. The words of the batch
    are laid out one space apart, so a run joined by spaces is a span of that layout.
    """
    lower = LOWER[data]
    solid = ~SEPARATOR[lower]
    begins, ends = solid.copy(), solid.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    text = np.searchsorted(offsets, start, side="right") - 1
    end = np.cumsum(size + 1) - 1
    begin = end - size
    spaced = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = lower[solid]

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in range(1, most + 1):
            first = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
            yield text[first], span_crcs(spaced, begin[first], end[first + n - 1]) % np.uint32(buckets)

    return np.bincount(text, minlength=len(offsets) - 1), runs()


def bucket_counts(texts: DataFrame, most: int = 3, buckets: int = 10_000) -> np.ndarray:
    """Runs of all texts (one string column) per bucket; tasks add up their own before the shuffle, one number a bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                for _, bucket in word_runs(data, offsets, most, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"]] = found["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the logarithm of the smoothed target share over the smoothed raw share, for every bucket."""
    buckets, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    ratios = (float((t + 1) * (all_raw + buckets)) / float((s + 1) * (all_target + buckets)) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, most: int = 3) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` of ``docs`` (two columns: id and text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, found, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, data, offsets in text_slices(batch.column(1)):
                here, n = slice(row, row + len(offsets) - 1), len(offsets) - 1
                words[here], runs = word_runs(data, offsets, most, len(gain))
                for text, bucket in runs:
                    found[here] += np.bincount(text, minlength=n)
                    weight[here] += np.bincount(text, gain[bucket], n).astype(np.int64)  # whole numbers far below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, found, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, most: int = 3, buckets: int = 10_000, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs``.

    Features are the runs of 1 to ``most`` words of whole texts, dealt into ``buckets`` by CRC-32. All texts of both tables are
    counted; a bucket's gain compares its share in ``target`` with that in ``docs``; ``weight`` sums a document's gains.
    ``score`` adds Gumbel noise drawn from a hash of seed and id, so the highest scores are a draw without replacement in proportion
    to exp(weight / 1000). Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn; ``rank`` is their
    place, null for all others.

    Ranks come from one sort dealt by range: a row's place in its range, plus the sizes of the ranges before. Ties go to the smaller
    id (no id comes last, and draws its noise as empty text would), then to the smaller weight and fewer features; what is
    left are equal rows, each of which takes a rank of its own. Null and blank texts have no features and weight 0. An empty
    table gives an empty one; an empty target has no counts, so that all gains come from ``docs``. Other columns are ignored. A
    text is held whole by one task, with some dozen times its size beside it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw, aim = (bucket_counts(frame, most, buckets) for frame in (texts.select("text"), target.select(F.col(target_col).cast("string"))))
    gains = bucket_gains(raw, aim)

    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighted(texts, gains, most).withColumn("score", F.col("weight") + noise).withColumn("drawable", F.col("n_words") >= least_words)
    scored = stored(scored, "target-scores")
    drawn = percent * scored.where("drawable").count() // 100

    order = [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"]
    ordered = stored(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "target-order")
    ordered = ordered.select("*", F.shiftright("place", 33).alias("range"), F.expr("place & 8589934591").alias("within"))
    sizes = ordered.groupBy("range").agg(F.count("*").alias("n"))  # one row a sort task
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("within") + 1
    placed = ordered.join(F.broadcast(starts), "range")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
