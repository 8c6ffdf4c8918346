"""Benchmark questions found in documents, also with other numbers, names or units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.tables import stored, text_slices
from gridtide.llm.words import LOWER, chained, mixed, span_hashes

WINDOW = 8
FILTER_BITS = 24
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months "
    "year years percent euro euros dollar dollars cents pounds metres meters kilometres kilometers miles inches feet grams kilograms litres liters degrees"
).split()
_LETTER, _DIGIT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[0x80:] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
_NUMBER, _NAME, _UNIT, _RAW = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954, 0x524157))


def _unit_hashes() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(span_hashes(text, end - [len(u) for u in UNITS], end))


_UNIT_HASHES = _unit_hashes()


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token its template hash, value hash and whether it is a slot; and where each text's tokens begin.

    Tokens are runs of letters or numbers, in lower case. Numbers, capitalised words inside a sentence (names) and unit
    words behind a number are slots: their template hash is their type's. White space and punctuation
    separate only.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    kind = _KIND[data]
    if n > 2:  # decimal points and thousands separators
        inner = ((data[1:-1] == ord(".")) | (data[1:-1] == ord(","))) & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT) & ~edge[1:-2] & ~edge[2:-1]
        kind[1:-1][inner] = _DIGIT
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    begin = np.flatnonzero(change[:-1] & (kind > 0))
    end = np.flatnonzero(change[1:] & (kind > 0)) + 1
    low = LOWER[data]
    accented = np.zeros(n, bool)  # capital letters with accents, two bytes in UTF-8
    if n > 1:
        accented[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = low.copy()
        low[1:][accented[:-1]] += 0x20
    value = span_hashes(low, begin, end)
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return value, value, np.zeros(0, bool), first
    enders = np.concatenate([[0], np.cumsum(_ENDS[data])])
    opens = np.ones(len(begin), bool)
    opens[1:] = enders[begin[1:]] > enders[end[:-1]]
    opens[first[:-1][np.diff(first) > 0]] = True
    number = kind[begin] == _DIGIT
    capital = (((data[begin] >= ord("A")) & (data[begin] <= ord("Z"))) | accented[begin]) & ~opens
    after = np.zeros(len(begin), bool)
    after[1:] = number[:-1]
    after[first[:-1][np.diff(first) > 0]] = False
    unit = after & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)] == value)
    shape = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital, _NAME, value)))
    return shape, value, number | unit | capital, first


def windows(shape: np.ndarray, slot: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` tokens within one text, at least half of them no slots, and where they begin."""
    h = chained(shape, size)
    if not len(h):
        return h, np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slots = np.concatenate([[0], np.cumsum(slot)])
    inside = (text[: len(h)] == text[size - 1 :]) & (2 * (slots[size:] - slots[:-size]) <= size)
    at = np.flatnonzero(inside)
    return mixed(h[at] + np.uint64(size)), at


_ROWS = "id long, pos int, hash long, size int, n int, raw boolean, slots array<long>"


def _window_rows(rows: DataFrame, sizes: list[int] | None, bits: np.ndarray | None, any_case: bool) -> DataFrame:
    """Windows of every text. Without ``sizes``: of WINDOW tokens, or of all tokens of a shorter text. ``bits``: only those in the filter.

    ``any_case``: besides the template's, ``raw`` windows of the tokens themselves in lower case, without slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, offsets in text_slices(batch.column(1)):
                shape, value, slot, first = template(data, offsets)
                count = np.diff(first)
                out: list[tuple] = []
                every = sizes or sorted({min(WINDOW, int(c)) for c in np.unique(count)} - {0})
                for size, raw in [(size, raw) for size in every for raw in ((False, True) if any_case else (False,))]:
                    h, at = windows(value, np.zeros_like(slot), first, size) if raw else windows(shape, slot, first, size)
                    if raw:
                        h = mixed(h + _RAW)
                    text = np.searchsorted(first, at, side="right") - 1
                    if bits is not None:
                        key = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        keep = (bits[key >> 3] >> (key & 7).astype(np.uint8)) & 1 == 1
                    else:
                        keep = np.minimum(count[text], WINDOW) == size
                    for a, t, x in zip(at[keep].tolist(), text[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                        some = [] if raw else value[a : a + size][slot[a : a + size]].view(np.int64).tolist()
                        out.append((ids[row + t], a - int(first[t]), x, size, int(count[t]), raw, some))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "pos", "hash", "size", "n", "raw", "slots"])

    return rows.mapInArrow(run, _ROWS)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", any_case: bool = False
) -> DataFrame:
    """``doc_id``, ``item_id``, ``coverage``, ``verbatim`` of every document that holds a benchmark item.

    Texts become templates: numbers, names and units are typed placeholders. Windows of eight template tokens
    (an item with fewer: all of it) are hash-joined. Matches of an item lie on diagonals (place in the
    document less place in the item); on a diagonal every slot value of the item must stand for one value in
    the document, so a question with changed numbers is caught while a sentence that only shares its frame is
    not. A token of the item is covered if a matched window on a consistent diagonal holds it. The item counts as
    found if ``least`` or more of the tokens that windows can cover are. ``verbatim`` tells that no slot differs.

    Capitals alone tell names, so a template misses a copy in other capitals, or one whose first word stands within
    a sentence. With ``any_case`` windows of the lower-case tokens themselves are joined too; they cover any token,
    slots included, on any diagonal, and the item is also found if ``least`` of all its tokens are covered.

    A filter of fixed size (2 MB) over the item windows goes to the scan of the documents, so that only windows that
    may match are shuffled; the exact join decides. Rows are counted before they are grouped, nothing is capped. Null
    and blank texts match nothing; items and documents without id are left out; rows that repeat an id count as
    one document or item. Template windows more than half of slots say too little and are skipped. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    asked = stored(_window_rows(items, None, None, any_case).distinct(), "item-windows")
    token = F.explode(F.expr("sequence(pos, pos + size - 1)")).alias("token")
    totals = asked.select("id", "n", "raw", token).groupBy("id").agg(F.count_distinct(F.expr("if(raw, null, token)")).alias("tokens"), F.max("n").alias("n"))
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # eight at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, verbatim boolean")
    key = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    filled = asked.groupBy(F.shiftright(key, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 7 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in filled:
        bits[r["byte"]] = r["bits"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    seen = _window_rows(texts, sizes, bits, any_case)
    hit = seen.alias("d").join(asked.alias("b"), F.expr("d.hash = b.hash and d.size = b.size and d.raw = b.raw and size(d.slots) = size(b.slots)"))
    hit = hit.select(
        F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), (F.col("d.pos") - F.col("b.pos")).alias("diagonal"), F.col("b.pos").alias("pos"), "b.size", "b.raw",
        F.arrays_zip(F.col("b.slots").alias("asked"), F.col("d.slots").alias("found")).alias("pairs"),
    )
    hit = stored(hit, "item-hits")
    where = ["doc_id", "item_id", "diagonal"]
    pair = hit.select(*where, F.explode("pairs").alias("p")).select(*where, "p.*").toDF(*where, "asked", "found")
    value = pair.groupBy(*where, "asked").agg(F.min("found").alias("low"), F.max("found").alias("high"))
    slots = value.groupBy(*where).agg(F.max(F.expr("low <> high")).alias("torn"), F.max(F.expr("low <> asked or high <> asked")).alias("changed"))
    place = hit.select(*where, "pos", "size", "raw").distinct().join(slots, where, "left").where("raw or torn is null or not torn")
    place = place.select("doc_id", "item_id", "changed", "raw", token)
    found = place.groupBy("doc_id", "item_id").agg(
        F.count_distinct(F.expr("if(raw, null, token)")).alias("framed"), F.count_distinct("token").alias("covered"), F.max(F.coalesce("changed", F.lit(False))).alias("changed")
    )
    found = found.join(totals, found["item_id"] == totals["id"])
    framed = F.when(F.col("tokens") > 0, F.col("framed") / F.col("tokens")).otherwise(0.0)
    found = found.withColumn("coverage", F.greatest(framed, F.col("covered") / F.col("n")) if any_case else framed)
    return found.where(F.col("coverage") >= least).select("doc_id", "item_id", "coverage", (~F.col("changed")).alias("verbatim"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, any_case: bool = False) -> DataFrame:
    """``docs`` (all columns) without the documents that hold a benchmark item; rows without id stay."""
    found = contaminated(docs, benchmark, least, any_case=any_case).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def keep_clean_rows(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """:func:`keep_clean` in any case that judges rows, not ids: rows without id or with a repeated one by their own text."""
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return keep_clean(docs, benchmark, least, any_case=True)
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = contaminated(numbered, benchmark, least, id_col="_row", any_case=True).select(F.col("doc_id").alias("_row")).distinct()
    return numbered.join(found, "_row", "left_anti").select(*docs.columns)
