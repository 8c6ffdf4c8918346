"""Which text filters remove what, in every order they could run in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.llm.tables import stored

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"


def failures(text: bytes, points: int) -> int:
    """Bits 0 to 3: under 100 words, too few distinct ones, too many capitals of ``points`` characters, a mark."""
    words = text.split()  # of bytes: at space, tab, line feed, vertical tab, form feed and carriage return
    few = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * points
    marked = len(text.translate(None, _MARKS)) < len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (four bits), ``digest`` (SHA-256 of the whole text) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(2).slice(at, 256).to_pylist():
                    raw = (text or "").encode()
                    masks.append(failures(raw, len(text or "")))
                    digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")) if part_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_cells(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (five bits), ``good``, ``toxic``, ``n``: all documents, counted by what decides their way.

    Bit 4 is set if a smaller id has the same text. So each text's smallest id is found, by a minimum that combines before
    its shuffle, and joined back by text *and* id: copies of one text have different ids, so the join has no hot key.
    """
    least = marks.groupBy("digest").agg(F.min("doc_id").alias("least"))
    first = least.select(F.col("digest").alias("d"), "least", F.lit(True).alias("first"))
    rows = marks.join(first.hint("merge"), F.expr("digest = d and doc_id <=> least"), "left").select("doc_id", "part", "mask", F.isnull("first").cast("int").alias("again"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    known = known.agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    rows = rows.join(known.hint("merge"), F.col("doc_id") == F.col("labelled"), "left")
    flag = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", F.expr("mask + 16 * again").alias("mask"), *flag).agg(F.count("*").alias("n"))


def order_array(filters: str = FILTERS) -> Column:
    """All orders of the filters, each an array of bit numbers: a constant of the plan that every task holds."""
    return F.expr(f"array({','.join(f'array{p}' for p in permutations(range(len(filters))))})")


def _outcomes(orders: Column, filters: str) -> Column:
    """One struct per order and step for a cell: the counts at that step, weighted by ``n``."""

    def bit(f: Column) -> Column:
        return F.getbit(F.col("mask").cast("long"), f).cast("long")

    def one_order(order: Column) -> Column:
        start = F.struct(F.lit(1).cast("long").alias("alive"), F.array().cast(f"array<struct<filter_order:string,step:int,letter:string,{','.join(c + ':bigint' for c in COUNTS)}>>").alias("done"))
        name = F.array_join(F.transform(order, lambda f: F.substring(F.lit(filters), f + 1, F.lit(1))), "")

        def take(state: Column, f: Column) -> Column:
            alive, fails = state["alive"], bit(f)
            gone = alive * fails
            alone = (F.col("mask") == F.call_function("shiftleft", F.lit(1), f.cast("int"))).cast("long")
            now = F.struct(
                name.alias("filter_order"), (F.size(state["done"]) + 1).alias("step"), F.substring(F.lit(filters), f + 1, F.lit(1)).alias("letter"),
                ((alive - gone) * F.col("n")).alias("kept"), (gone * F.col("n")).alias("removed"), ((1 - alive) * fails * F.col("n")).alias("redundant"), (alone * F.col("n")).alias("unique_fails"),
                (gone * F.col("good").cast("long") * F.col("n")).alias("good_lost"), (gone * F.col("toxic").cast("long") * F.col("n")).alias("toxic_lost"),
            )
            return F.struct((alive - gone).alias("alive"), F.concat(state["done"], F.array(now)).alias("done"))

        return F.aggregate(order, start, take, lambda state: state["done"])

    return F.flatten(F.transform(orders, one_order))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``filter_order``, ``step``, the :data:`COUNTS` and ``shapley`` for every part, order of the five filters and step.

    Each document is one cell of a small table: its part, which filters it fails, its labels. A cell folds over the array of all
    120 orders and gives 600 structs weighted by its size; they are added up by part, order and step. So the work beyond
    one pass over the texts depends on the number of parts alone (128 cells each at most).

    ``kept`` is what is left after the step, ``removed`` what goes at it, ``redundant`` what fails its filter but went before,
    ``unique_fails`` what fails this filter alone, ``good_lost`` and ``toxic_lost`` what goes with quality 1 or toxic 1,
    ``shapley`` the documents the step's filter removes summed over all orders.

    Null text is empty, a null or missing part the empty string. Rows that repeat an id count one by one; with one text, and no
    smaller id with it, none of them is a copy. A row without id has no label, is a copy of any equal text that has
    one, and makes no other row a copy. Of several labels of one id any 1 counts. An empty table gives an empty one. Other columns are
    ignored.
    """
    marks = stored(marked(docs, id_col, text_col, part_col), "filter-marks")
    cells = stored(mask_cells(marks, labels), "mask-cells")
    rows = cells.select("part", F.explode(_outcomes(order_array(), FILTERS)).alias("at")).select("part", "at.*")
    merged = rows.groupBy("part", "filter_order", "step", "letter").agg(*(F.sum(c).alias(c) for c in COUNTS))
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return merged.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
