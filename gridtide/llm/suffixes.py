"""Exact removal of repeated byte strings: maximal repeats from enhanced suffix arrays over anchored contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.tables import discard, release, stored, text_slices
from gridtide.llm.words import _BACK, _BASE, _power, mixed

LEAST = 100  # bytes of a repeat
GRAM = 32  # bytes that an anchor hashes
CHUNK = 10_000  # contexts that one suffix array covers
CROWD = 4096  # different contexts of one anchor beyond which its strings are compared by shuffled hashes


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts, place of the anchor) of each run of ``least``-byte strings with one anchor.

    A string's anchor is the leftmost of its grams with the smallest hash, so it depends on the string alone:
    equal strings have equal anchors at equal places, wherever they occur.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return np.zeros(0, np.uint64), none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * _power("down", _BACK, n + 1)[: n + 1 - gram])
    best, at, width = h, np.arange(len(h), dtype=np.int32), least - gram + 1
    size = 1
    while size < width:
        step = min(size, width - size)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        size += step
    starts = np.arange(len(at))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: len(at)] == text[least - 1 :]
    starts, at, text = starts[inside], at[inside], text[: len(inside)][inside]
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first = starts[change]
    return h[at[change]], first, np.diff(np.append(change, len(starts))), at[change] - first


def maximal_repeats(contexts: list[bytes], counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal repeats of at least ``least`` bytes among the suffixes that begin at the first ``counts[i]`` bytes of context i.

    Sorts the suffixes, takes the common prefix of each with the next, and scans these with a stack: every
    interval of suffixes that share a prefix longer than its surroundings is a node of the interval tree.
    Nodes whose occurrences are all preceded by the same byte are left out, since the repeat goes on to
    the left. Returns the common prefix, the bounds [low, high] of each node in suffix order, and that order
    as rows of (context, start), so that a group lists all its occurrences.
    """
    longest = max(map(len, contexts))
    text = np.zeros((len(contexts), longest), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text[np.arange(longest)[None] < size[:, None]] = np.frombuffer(b"".join(contexts), np.uint8)
    context = np.repeat(np.arange(len(contexts)), counts)
    start = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate([text, np.zeros((len(contexts), longest), np.uint8)], axis=1)
    views = np.lib.stride_tricks.sliding_window_view(padded, longest, axis=1)
    suffix = np.ascontiguousarray(views[context, start])
    order = np.argsort(suffix.view(f"S{longest}").ravel(), kind="stable")
    suffix, context, start = suffix[order], context[order], start[order]
    left_over = size[context] - start
    common = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(common), 65536):
        end = min(len(common), at + 65536)
        differ = suffix[at:end] != suffix[at + 1 : end + 1]
        found = np.where(differ.any(1), differ.argmax(1), longest)
        common[at:end] = np.minimum(found, np.minimum(left_over[at:end], left_over[at + 1 : end + 1]))
    prefix, low, high = _interval_tree(common, least)
    before = np.where(start > 0, padded[context, np.maximum(start - 1, 0)].astype(np.int64), -1)
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    diverse = (changes[high] > changes[low]) | (before[low] < 0)
    return prefix[diverse], low[diverse], high[diverse], np.stack([context, start], axis=1)


def _interval_tree(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, low, high) of all common-prefix intervals of at least ``least``, by a stack scan."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (prefix, low)
    places = np.flatnonzero(common >= least)
    last = -2
    for i, value in zip(places.tolist(), common[places].tolist(), strict=True):
        if i != last + 1:  # between lie shorter prefixes: everything open ends
            while stack:
                prefix, low = stack.pop()
                out.append((prefix, low, last + 1))
        low = i
        while stack and stack[-1][0] > value:
            prefix, low = stack.pop()
            out.append((prefix, low, i))
        if not stack or stack[-1][0] < value:
            stack.append((value, low))
        last = i
    while stack:
        prefix, low = stack.pop()
        out.append((prefix, low, last + 1))
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _later_spans(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of all but the first occurrence of each maximal repeat among different contexts."""
    contexts = frame["ctx"].tolist()
    prefix, low, high, place = maximal_repeats(contexts, np.fromiter(map(len, contexts), np.int64, len(contexts)) - LEAST + 1)
    rank = np.empty(len(frame), np.int64)  # contexts in the order of document and place
    rank[np.lexsort((frame["start"], frame["key"]))] = np.arange(len(frame))
    key, begin = frame["key"].to_numpy(), frame["start"].to_numpy()
    position = rank[place[:, 0]] * 256 + place[:, 1]
    spans = []
    for at in range(0, len(prefix), 20_000):
        n = high[at : at + 20_000] - low[at : at + 20_000] + 1
        node = np.repeat(np.arange(len(n)), n)
        member = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at : at + 20_000], n)
        first = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(first, node, position[member])
        later = position[member] > first[node]
        who, node = member[later], node[later]
        spans.append(np.stack([place[who, 0], place[who, 1], place[who, 1] + prefix[at : at + 20_000][node]], axis=1))
    found = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
    row, lows, highs = _merged(found)
    return pd.DataFrame({"key": key[row], "low": begin[row] + lows, "high": begin[row] + highs})


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching [low, high) spans of the same row made one."""
    if not len(spans):
        return spans[:, 0], spans[:, 1], spans[:, 2]
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    wide = int(spans[:, 2].max()) + 2
    top = np.maximum.accumulate(spans[:, 0] * wide + spans[:, 2])
    fresh = np.concatenate([[True], spans[1:, 0] * wide + spans[1:, 1] > top[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)
    return spans[fresh, 0], spans[fresh, 1], top[last] - spans[fresh, 0] * wide


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``key`` in the order of ids, the text, and all other columns in ``rest``."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*(F.col(c) for c in others)) if others else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    n, ids, distinct = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return rows.withColumn("key", F.col("doc_id")), others
    ordered = rows.orderBy("doc_id", "text").withColumn("key", F.monotonically_increasing_id())
    return stored(ordered, "numbered"), others


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept_text``, ``rest`` per document.

    Removed is every byte covered by a 100-byte string that also starts earlier: in a document with a smaller id, or
    before in the same one. Strings are judged on the input and never cross documents. ``kept_text`` drops a character
    only with all its bytes; ``rest`` holds the other columns. Null text is empty; documents without id come first;
    of rows with one id the smaller text is the earlier, equal rows in any order.

    1. Every 100-byte string has an anchor in it that depends on the string alone. Runs of strings with one anchor,
       about one in 24 bytes, are written once as (hash, document, place); those whose hash occurs once are dropped.
    2. The others' contexts (the bytes of a run's strings) are hashed beside the texts. Equal contexts, told by the
       64-bit hashes of both anchor and context, are classes: all but the first are removed whole. This takes out
       copies before anything is compared. From here on only hashes and places are shuffled.
    3. First contexts whose anchor has other contexts are cut out and dealt by anchor into chunks. In a chunk an enhanced suffix
       array gives all maximal repeats with all occurrences; every occurrence but the first is removed. An anchor with
       more than ``crowd`` different contexts would fill a task: its strings are grouped by 128-bit hashes instead,
       which combine before the shuffle.
    4. Spans meet their texts again by document, a list no longer than the text.
    """
    spark = docs.sparkSession
    rows, _ = _numbered(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                h, first, count, at = anchors(data, offsets)
                text = np.searchsorted(offsets, first, side="right") - 1
                place = (first - offsets[text]) << 14 | at << 7 | count
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[row + text]), pa.array(place)], names=["h", "key", "place"])

    every = stored(rows.select("key", "text").mapInArrow(find, "h long, key long, place long"), "anchors")
    held = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = stored(every.join(held, "h", "left_semi"), "repeated-anchors")
    discard(every)
    release(spark)

    lists = again.groupBy("key").agg(F.collect_list(F.struct("h", "place")).alias("anchors"))  # no longer than the text
    joined = rows.join(lists, "key", "left").select("key", "doc_id", "text", "rest", "anchors")
    kind = dict(joined.dtypes)
    schema = f"key long, doc_id long, text string, rest {kind['rest']}, marks array<struct<h:bigint,cid:bigint,start:int,size:int,again:boolean>>"
    texts = stored(joined.mapInArrow(_contexts, schema), "anchored-texts")
    discard(again)
    release(spark)

    contexts = texts.select("key", F.explode("marks").alias("m")).select("key", "m.*")
    least = contexts.where("not again").groupBy("h", "cid").agg(F.min("key").alias("least"))
    marked = contexts.join(least, ["h", "cid"]).withColumn("earliest", F.expr("key = least and not again"))
    marked = stored(marked.select("h", "key", "start", "size", "earliest"), "contexts")
    release(spark)
    copies = marked.where("not earliest").select("key", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high"))
    single = marked.where("earliest").select("h", "key", "start", "size")
    many = single.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    wanted = single.join(many, "h").groupBy("key").agg(F.collect_list(F.struct("h", "n", "start", "size")).alias("marks"))
    cut = texts.select("key", "text").join(wanted, "key").mapInArrow(_cut, "h long, n long, key long, start long, ctx binary")
    several = stored(cut, "first-contexts")
    release(spark)
    chunks = max(1, -(-several.count() // chunk))
    usual = several.where(F.col("n") <= crowd).withColumn("chunk", F.pmod(F.xxhash64("h"), F.lit(chunks)))
    compared = usual.select("chunk", "ctx", "key", "start").groupBy("chunk").applyInPandas(_later_spans, "key long, low long, high long")

    crowded = several.where(F.col("n") > crowd)
    strings = crowded.select("key", "start", "ctx", F.explode(F.sequence(F.lit(1), F.length("ctx") - LEAST + 1)).alias("at"))
    strings = strings.select("key", (F.col("start") + F.col("at") - 1).alias("low"), F.substring(F.sha2(F.substr("ctx", F.col("at"), F.lit(LEAST)), 256), 1, 32).alias("sid"))
    place = (F.col("key").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(18,0)") + F.col("low")).cast("decimal(38,0)")
    first = strings.groupBy("sid").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    hashed = strings.join(first, "sid").where(place != F.col("least")).select("key", "low", (F.col("low") + LEAST).alias("high"))

    compared = stored(compared.unionByName(hashed), "repeat-spans")
    discard(several)
    release(spark)
    spans = copies.unionByName(compared).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    with_spans = texts.select("key", "doc_id", "text", "rest").join(spans, "key", "left").select("doc_id", "text", "spans", "rest")
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, rest {kind['rest']}"
    return with_spans.mapInArrow(_apply, schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each text the hashes of its contexts, and which of them it has had before."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.encode() for t in part.column(2).to_pylist()]
            row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(part.column(4)).fill_null(0).to_numpy(zero_copy_only=False))
            h, place = (x.to_numpy(zero_copy_only=False) for x in part.column(4).flatten().flatten())
            order = np.lexsort((place, row))
            row, h, place = row[order], h[order], place[order]
            start, size = place >> 14, (place & 127) - 1 + LEAST
            cid = np.array([digest(texts[r][a:b]) for r, a, b in zip(row.tolist(), start.tolist(), (start + size).tolist(), strict=True)], np.uint64).view(np.int64)
            same = np.lexsort((np.arange(len(row)), cid, h, row))
            again = np.zeros(len(row), bool)
            again[same[1:]] = (row[same[1:]] == row[same[:-1]]) & (h[same[1:]] == h[same[:-1]]) & (cid[same[1:]] == cid[same[:-1]])
            marks = pa.StructArray.from_arrays(
                [pa.array(h), pa.array(cid), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)], names=["h", "cid", "start", "size", "again"]
            )
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(pa.array(offsets), marks)], names=["key", "doc_id", "text", "rest", "marks"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed contexts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [t.encode() for t in part.column(1).to_pylist()]
            row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
            h, n, start, size = part.column(2).flatten().flatten()
            ctx = [texts[r][a : a + k] for r, a, k in zip(row.tolist(), start.to_pylist(), size.to_pylist(), strict=True)]
            key = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([h, n, key, start.cast(pa.int64()), pa.array(ctx, pa.binary())], names=["h", "n", "key", "start", "ctx"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = text.encode()
                if not spans:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), text))
                    continue
                raw = np.array([(0, s["low"], s["high"]) for s in spans], np.int64)
                _, low, high = _merged(raw)
                edge = np.zeros(len(data) + 1, np.int64)
                edge[low] += 1
                edge[high] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                raw_bytes = np.frombuffer(data, np.uint8)
                head = (raw_bytes & 0xC0) != 0x80
                whole = np.logical_and.reduceat(gone, np.flatnonzero(head))[np.cumsum(head) - 1]
                out.append((len(data), int(gone.sum()), len(low), hashlib.sha256(raw_bytes[~gone].tobytes()).hexdigest(), raw_bytes[~whole].tobytes().decode()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made, part.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "rest"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, each text without its repeats. Documents of which nothing is left stay, with empty text."""
    found = without_repeats(docs, id_col, text_col)
    kinds = dict(docs.dtypes)
    taken = [F.col("doc_id").cast(kinds[id_col]).alias(id_col) if c == id_col else F.col("kept_text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns]
    return found.select(*taken)
