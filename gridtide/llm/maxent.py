"""A hashed maximum-entropy language model with class-factored softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.llm.tables import release, stored, text_slices
from gridtide.llm.words import Words, mixed, split_words

CLASSES = 64
HEAD = 32  # the most frequent words are classes of their own, the end token among them
ROWS = 1 << 13  # hashed features of the class softmax
BLOCK_BYTES = 6 << 20  # text that is counted and scored together
PART_KEYS = 1 << 21  # about so many counted keys meet in one task
PULL = 30.0  # pseudo-tokens that draw a word's share after another word towards its share of the class
PIECE = 16  # rows of a run that are added up by pairs in one go
_END = np.uint64(0x656E64)
_NONE = np.uint64(0x6E6F6E65)


@dataclass
class Tokens:
    """Word hashes of a run of texts, each text ended by the end token, with their classes."""

    hash: np.ndarray
    kind: np.ndarray
    first: np.ndarray

    def part(self, begin: int, end: int) -> Tokens:
        """Texts ``begin`` to ``end``."""
        some = slice(self.first[begin], self.first[end])
        return Tokens(self.hash[some], self.kind[some], self.first[begin : end + 1] - self.first[begin])

    def back(self, values: np.ndarray, k: int, none) -> np.ndarray:
        """The value ``k`` tokens before, ``none`` where the text begins later."""
        out = np.full(len(values), none, values.dtype)
        out[k:] = values[:-k]
        for j in range(k):
            early = self.first[:-1] + j
            out[early[early < self.first[1:]]] = none
        return out


def word_shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """Class of each word that is none by itself: one by its shape, below ``CLASSES - HEAD``.

    The shape is the first two bytes' and the last byte's kind and which letters beyond ASCII it holds; these tell
    languages and styles apart.
    """
    if not len(words.hash):
        return np.zeros(0, np.uint8)
    wide = np.concatenate([[0], np.cumsum(np.where(data >= 0x80, data, 0).astype(np.int64))])
    accents = wide[words.end] - wide[words.start]
    lower = data | np.uint8(0x20)
    last = data[words.end - 1]
    tail = np.where((last | 0x20).astype(np.uint8) - 97 < 26, 1, last.astype(np.int64))
    second = lower[np.minimum(words.start + 1, words.end - 1)].astype(np.int64)
    shape = tail + 512 * np.minimum(accents, 1 << 20) + (1 << 40) * (lower[words.start].astype(np.int64) // 4) + (1 << 48) * (second // 8)
    return (mixed(shape.astype(np.uint64)) % np.uint64(CLASSES - HEAD)).astype(np.uint8)


def ended(h: np.ndarray, shape: np.ndarray, first: np.ndarray, head: np.ndarray) -> Tokens:
    """Words with an end token behind each text; a word's class is its place in ``head`` (sorted hashes), else by its shape."""
    texts = len(first) - 1
    spot = np.arange(len(h)) + np.repeat(np.arange(texts), np.diff(first))  # an end token behind each text before
    place = np.minimum(np.searchsorted(head, h), len(head) - 1)
    n = len(h) + texts
    every, kind = np.full(n, _END), np.full(n, int(np.searchsorted(head, _END)))
    every[spot], kind[spot] = h, np.where(head[place] == h, place, HEAD + shape.astype(np.int64))
    return Tokens(every, kind, first + np.arange(texts + 1))


def tokens(data: np.ndarray, offsets: np.ndarray, head: np.ndarray) -> Tokens:
    words = split_words(data, offsets)
    return ended(words.hash, word_shapes(data, words), words.first, head)


def features(t: Tokens) -> np.ndarray:
    """Rows of each token's features: the word before, the two before, the word before with one skipped, and the three classes before."""
    one, two = t.back(t.hash, 1, _NONE), t.back(t.hash, 2, _NONE)
    kinds = [t.back(t.kind, k, CLASSES).astype(np.uint64) for k in (1, 2, 3)]
    seen = np.zeros(len(t.hash), np.uint64)
    for i, k in enumerate(kinds):
        seen += (k + np.uint64(1)) << np.uint64(9 * i)
    found = [
        mixed(one + np.uint64(1)), mixed(one * np.uint64(3) + two * np.uint64(5) + np.uint64(2)), mixed(two + np.uint64(3)),
        mixed(seen + (np.uint64(4) << np.uint64(60))),
    ]
    return np.stack([(f >> np.uint64(64 - 13)).astype(np.int64) for f in found], axis=1)


def pair_keys(t: Tokens, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens whose class holds several words: where they are, key of (word before, word), key of (word before, class), each with ``bits`` set at most."""
    at = np.flatnonzero(t.kind >= HEAD)
    before, cut = t.back(t.hash, 1, _NONE)[at], np.uint64(64 - bits)
    pair, context = mixed(before * np.uint64(3) + mixed(t.hash[at])), mixed(mixed(before + np.uint64(5)) + t.kind[at].astype(np.uint64))
    return at, pair >> cut << cut, context >> cut << cut


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all classes, the largest zero."""
    logit = weights.take(rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        logit += weights.take(rows[:, j], axis=0)
    logit += bias
    top = logit
    while top.shape[1] > 1 and top.shape[1] % 2 == 0:  # by halves: many short rows are slow to reduce one by one
        top = np.maximum(top[:, : top.shape[1] // 2], top[:, top.shape[1] // 2 :])
    logit -= top.max(axis=1, keepdims=True)
    return logit


def class_shares(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of all classes."""
    share = np.exp(_logits(weights, bias, rows))
    share /= share.sum(axis=1, keepdims=True)
    return share


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Log probability of each token's class."""
    logit = _logits(weights, bias, rows)
    own = logit[np.arange(len(kind)), kind].astype(np.float64)
    return own - np.log(np.exp(logit, out=logit).sum(axis=1))


def run_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at ``begin``, adding up by pairs; ``values`` is overwritten.

    Runs are short as a rule, for which ``np.add.reduceat`` along the rows takes several times as long.
    """
    length = np.diff(np.append(begin, len(values)))
    place = np.arange(len(values)) - np.repeat(begin, length)
    left = np.repeat(length, length) - place
    step = 1
    at = np.flatnonzero((left > 1) & (place % 2 == 0))
    while len(at):
        values[at] += values.take(at + step, axis=0)
        step *= 2
        at = at[(place[at] % (2 * step) == 0) & (left[at] > step)]
    return values.take(begin, axis=0)


def _piece_sums(values: np.ndarray, at: np.ndarray, start: np.ndarray, reach: np.ndarray, j: int, width: int) -> np.ndarray:
    """Sums by pairs of the rows ``j`` to ``j + width`` of the pieces that have a j-th row."""
    if width == 1:
        return values.take(at[start[: reach[j]] + j], axis=0)
    half = j + width // 2
    left = _piece_sums(values, at, start, reach, j, width // 2)
    if reach[half]:
        left[: reach[half]] += _piece_sums(values, at, start, reach, half, width // 2)
    return left


def picked_sums(values: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[at]`` by runs that start at ``begin``: :func:`run_sums` of them, to the last bit, without a copy of all.

    Runs are cut into pieces of ``PIECE``, the longest first, so that the pieces with a j-th row are the first ones of all.
    """
    length = np.diff(np.append(begin, len(at)))
    pieces = -(-length // PIECE)
    lead = np.cumsum(pieces) - pieces  # a run's first piece
    number = np.arange(int(pieces.sum())) - np.repeat(lead, pieces)
    size = np.minimum(np.repeat(length, pieces) - number * PIECE, PIECE)
    order = np.argsort((PIECE - size).astype(np.uint8), kind="stable")
    start = (np.repeat(begin, pieces) + number * PIECE)[order]
    reach = np.searchsorted(-size[order], -np.arange(PIECE))  # pieces with more than j rows
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    sums = _piece_sums(values, at, start, reach, 0, PIECE)
    total = sums.take(back[lead], axis=0)
    many = np.flatnonzero(pieces > 1)
    if len(many):
        total[many] = run_sums(sums.take(back[np.repeat(pieces > 1, pieces)], axis=0), np.cumsum(pieces[many]) - pieces[many])
    return total


def held_out(docs: DataFrame) -> Column:
    """Every seventh document or so, by the check sum of its id."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 7 == 2


def gradient_step(weights: np.ndarray, energy: np.ndarray, met: np.ndarray, bias: np.ndarray, rows: np.ndarray, kind: np.ndarray, rate: float) -> None:
    """One step over a small batch, in place; a row's step size shrinks with the squared gradients it has had."""
    n, k = rows.shape
    flat = rows.T.ravel().astype(np.uint16)  # sorted by radix
    order = np.argsort(flat, kind="stable")
    in_order = flat[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    begin = np.flatnonzero(new)
    row = in_order[begin].astype(np.int64)
    local = np.empty(n * k, np.int64)
    local[order] = np.cumsum(new) - 1
    own = weights.take(row, axis=0)
    slope = class_shares(own, bias, local.reshape(k, n).T)
    slope[np.arange(n), kind] -= 1
    total = picked_sums(slope, order % n, begin)
    spent = energy[row] + np.einsum("ij,ij->i", total, total)
    energy[row] = spent
    total *= (rate / np.sqrt(spent))[:, None]
    weights[row] = np.subtract(own, total, out=own)
    met[row] += np.diff(np.append(begin, n * k))


def train(coded: DataFrame, head: np.ndarray, bias: np.ndarray, rounds: int = 2, rate: float = 1.0, batch: int = 4096) -> np.ndarray:
    """Weights (ROWS x CLASSES) from one pass over the training texts of :func:`encoded`, dealt over ``rounds`` by a hash of their place.

    In a round every task starts from the weights so far and goes through its texts in small batches, each one a
    gradient step. Spark then averages the tasks' rows, weighted by how often each task met the row. What reaches
    the driver has fixed size.
    """
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for number in range(rounds):
        some = coded.where(F.pmod(F.xxhash64("block", "place"), F.lit(rounds)) == number)
        shared = coded.sparkSession.sparkContext.broadcast(weights)  # fixed size

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()
            energy, met = np.full(ROWS, 10, np.float32), np.zeros(ROWS)
            for run in _runs(batches):
                used, lengths = _training(run), np.diff(run.first)[~run.held]
                t = ended(run.hash[used], run.shape[used], np.concatenate([[0], np.cumsum(lengths)]), head)
                for begin, end in _cuts(t.first, 1 << 16):
                    part = t.part(begin, end)
                    rows = features(part)
                    for at in range(0, len(rows), batch):
                        gradient_step(own, energy, met, bias, rows[at : at + batch], part.kind[at : at + batch], rate)
            seen = np.flatnonzero(met)
            for at in range(0, len(seen), 512):
                r = seen[at : at + 512]
                flat = pa.array((own[r] * met[r, None].astype(np.float32)).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r), pa.array(met[r]), pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * CLASSES), flat)], names=["row", "met", "own"]
                )

        moved = some.select(*RUN).mapInArrow(step, "row long, met double, own array<float>").withColumn("own", array_to_vector("own"))
        mean = moved.groupBy("row").agg(Summarizer.sum(F.col("own")).alias("own"), F.sum("met").alias("met")).select("row", "met", vector_to_array("own").alias("own"))
        found = mean.toArrow().combine_chunks()
        if found.num_rows:
            own = found["own"].combine_chunks().flatten().to_numpy().reshape(-1, CLASSES)
            weights[found["row"].to_numpy()] = own / found["met"].to_numpy()[:, None]
        shared.unpersist()
    return weights


RUN = ("block", "place", "held_out", "words", "codes", "shapes", "lengths")


@dataclass
class Run:
    """Consecutive texts of one block, the first one at ``start``."""

    block: int
    start: int
    held: np.ndarray
    hash: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def packed(values: np.ndarray) -> bytes:
    """The numbers byte by byte of their width, compressed: bytes that rarely differ take next to nothing."""
    plain = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return np.int64(len(values)).tobytes() + pa.Codec("zstd", compression_level=1).compress(plain.tobytes(), asbytes=True)


def unpacked(blob: bytes, dtype: type) -> np.ndarray:
    n, size = int(np.frombuffer(blob, np.int64, 1)[0]), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    plain = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(size, n).T).view(dtype).ravel()


def _keys(blob: bytes) -> np.ndarray:
    """Sorted keys, which are packed by their differences."""
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def _packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order; ``np.unique`` would hash them first, which takes many times as long for keys that rarely repeat."""
    found = np.sort(keys)
    return found[np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]]


def _all(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


def _words_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their shapes and where each text's words begin, of rows of :func:`encoded`."""
    h, shape, length = [], [], []
    for own, codes, shapes, lengths in zip(*(rows[c].to_pylist() for c in ("words", "codes", "shapes", "lengths")), strict=True):
        code = unpacked(codes, np.uint32)
        h.append(_keys(own)[code])
        shape.append(unpacked(shapes, np.uint8)[code])
        length.append(unpacked(lengths, np.uint32))
    return _all(h, np.uint64), _all(shape, np.uint8), np.concatenate([[0], np.cumsum(_all(length, np.int64))])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks().flatten()


def _run_of(batches: list[pa.RecordBatch]) -> Run:
    rows = pa.Table.from_batches(batches)
    words, shapes, first = _words_of(rows)
    return Run(rows["block"][0].as_py(), rows["place"][0].as_py(), _flat(rows["held_out"]).to_numpy(zero_copy_only=False), words, shapes, first)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Texts in the order read, cut where the block changes."""
    kept, last = [], None
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin == end:
                continue
            if kept and block[begin] != last:
                yield _run_of(kept)
                kept = []
            kept.append(batch.slice(begin, end - begin))
            last = block[begin]
    if kept:
        yield _run_of(kept)


def _cuts(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` tokens; only a single longer text makes one larger."""
    begin = 0
    while begin < len(first) - 1:
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def encoded(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of texts as rows, stored: ``block``, ``place`` of the first text in it, ``doc_id`` and ``held_out`` of all its texts, and their words.

    ``words`` holds the run's distinct 64-bit hashes, ``shapes`` their shapes, ``codes`` each word's place among them,
    ``lengths`` the words per text. A run takes about a quarter of a megabyte of text; only a longer text makes it larger. A
    block is a run of consecutive documents of one task of at least ``block_bytes`` where there are as many, so no
    id, null or repeated, makes a block crowded. Each text is split into words once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", held_out(rows).alias("held_out"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, filled = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(2), min(1 << 18, block_bytes)):
                if filled >= block_bytes:
                    block, place, filled = block + 1, 0, 0
                words = split_words(data, offsets)
                own, at, codes = np.unique(words.hash, return_index=True, return_inverse=True)
                n, held = len(offsets) - 1, batch.column(1).slice(row, len(offsets) - 1)
                lengths, whole = np.diff(words.first), pa.array([0, len(offsets) - 1], pa.int32())
                columns = {
                    "block": [block], "place": [place], "doc_id": pa.ListArray.from_arrays(whole, batch.column(0).slice(row, n)), "held_out": pa.ListArray.from_arrays(whole, held),
                    "words": [_packed_keys(own)], "codes": [packed(codes.astype(np.uint32))], "shapes": [packed(word_shapes(data, words)[at])],
                    "lengths": [packed(lengths.astype(np.uint32))], "n_words": [len(words.hash)], "n_training": [n - held.true_count],
                }
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
                place, filled = place + n, filled + len(data)

    schema = "block long, place long, doc_id array<long>, held_out array<boolean>, words binary, codes binary, shapes binary, lengths binary, n_words long, n_training long"
    return stored(rows.mapInArrow(encode, schema), "coded-texts")


def _training(run: Run) -> np.ndarray:
    """Marks the words of texts that are not held out."""
    return np.repeat(~run.held, np.diff(run.first))


def _word_keys(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return run.hash, _training(run), run.shape


def key_bits(tokens: int) -> int:
    """Bits of a pair's hash: 20 more than the count of tokens has, so that a key meets another's by a chance of one in a million at any size."""
    return min(64, 20 + int(tokens).bit_length())


def _pair_keys_by(head: np.ndarray, bits: int) -> Callable[[Run], tuple[np.ndarray, np.ndarray, None]]:
    def keys(run: Run) -> tuple[np.ndarray, np.ndarray, None]:
        t = ended(run.hash, run.shape, run.first, head)
        at, pair, context = pair_keys(t, bits)
        used = np.repeat(~run.held, np.diff(t.first))[at]
        return np.concatenate([pair, context]), np.concatenate([used, used]), None

    return keys


def key_totals(coded: DataFrame, keys_of: Callable[[Run], tuple[np.ndarray, np.ndarray, np.ndarray | None]], parts: int) -> DataFrame:
    """Counts of all keys over the training texts of the whole table, handed back to the runs of texts that hold them.

    Every run lists its distinct keys in order with their counts; the range of hashes is cut into ``parts``, and one
    task adds up a part. It gives each run the ``totals`` of the run's own keys, in their order (``block``, ``start``,
    ``part``), so no task holds all keys. Rows without block sum the part up: words and tokens by shape (``shape``,
    ``v``, ``n``), and its most frequent keys (``h``, ``shape``, ``n``).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            keys, used, shape = keys_of(run)
            if not len(keys):
                continue
            own, at = np.unique(keys, return_index=True) if shape is not None else (distinct(keys), None)
            n = np.zeros(len(own), np.uint32)
            trained, times = np.unique(keys[used], return_counts=True)
            n[np.searchsorted(own, trained)] = times
            part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            kind = shape[at] if shape is not None else np.zeros(len(own), np.uint8)
            pieces = [slice(i, j) for i, j in zip(begin, [*begin[1:], len(own)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[begin].astype(np.int64)), pa.array(np.full(len(begin), run.block)), pa.array(np.full(len(begin), run.start)),
                    pa.array([_packed_keys(own[p]) for p in pieces], pa.binary()), pa.array([packed(n[p]) for p in pieces], pa.binary()), pa.array([packed(kind[p]) for p in pieces], pa.binary()),
                ],
                names=["part", "block", "start", "keys", "n", "shapes"],
            )

    def total(group: pa.Table) -> pa.Table:
        lists = [_keys(k) for k in group["keys"].to_pylist()]
        cuts = np.cumsum([len(k) for k in lists])[:-1]
        keys = _all(lists, np.uint64)
        n = _all([unpacked(x, np.uint32) for x in group["n"].to_pylist()], np.uint32)
        shapes = _all([unpacked(x, np.uint8) for x in group["shapes"].to_pylist()], np.uint8)
        own, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(inverse, weights=n, minlength=len(own)).astype(np.int64)
        kind = shapes[at].astype(np.int64)
        back = pa.table({"block": group["block"], "start": group["start"], "part": group["part"], "totals": pa.array([packed(x) for x in np.split(sums[inverse], cuts)], pa.binary())})
        v, of = np.bincount(kind[sums > 0], minlength=CLASSES - HEAD), np.bincount(kind, weights=sums, minlength=CLASSES - HEAD).astype(np.int64)
        top = np.argsort(-sums, kind="stable")[: HEAD - 1]
        top = top[sums[top] > 0]
        by_shape = pa.table({"shape": pa.array(np.arange(CLASSES - HEAD)), "v": pa.array(v.astype(np.int64)), "n": pa.array(of)})
        frequent = pa.table({"shape": pa.array(kind[top]), "n": pa.array(sums[top]), "h": pa.array(own[top].view(np.int64))})
        full = pa.concat_tables([back, by_shape, frequent], promote_options="default")
        return full.select(["block", "start", "part", "totals", "shape", "v", "n", "h"])

    spreaded = coded.select(*RUN).mapInArrow(spread, "part long, block long, start long, keys binary, n binary, shapes binary")
    return spreaded.groupBy("part").applyInArrow(total, "block long, start long, part long, totals binary, shape long, v long, n long, h long")


def _per_key(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The total of each entry of ``keys``, from the totals of the distinct ones in order."""
    own, inverse = np.unique(keys, return_inverse=True)
    if len(own) != len(totals):
        raise ValueError("totals of another run of texts")
    return totals[inverse] if len(keys) else np.zeros(0, np.int64)


def scored(docs: DataFrame, rounds: int = 2, block_bytes: int = BLOCK_BYTES, pull: float = PULL, part_keys: int = PART_KEYS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every document.

    Tokens are lower-cased words and one end per text, told by 64-bit hashes. The model learns from documents that
    are not held out. The probability of a token is that of its class times that of the word in the class, both
    softmaxes over features of the tokens before. The class softmax has hashed n-gram and skip features, trained by
    gradient steps. Within a class a word starts from its share q = (count + 1) / (class tokens + class words + 1),
    where the added one is for unknown words, and has one feature per word before it, with weight
    log(1 + pairs / (``pull`` q)). These weights sum to the normaliser 1 + (word before, class) / ``pull``, so they
    need no further pass: the table of pairs grows with the corpus and is counted whole. ``score`` sums the log10;
    ``base_score`` is a smoothed unigram model's. Counts are exact and cover all training documents.

    Null texts are empty and score their end token. Rows without id count as id ''. An empty table gives an
    empty one. Without training documents every count is 0 and both models are uniform. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    coded = encoded(docs, block_bytes)
    size, ends = coded.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_training"), F.lit(0))).first()
    parts, bits = max(1, -(-size // part_keys)), key_bits(size)
    words = stored(key_totals(coded, _word_keys, parts), "word-totals")
    release(spark)
    by_shape = words.where("block is null and v is not null").groupBy("shape").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # one row a shape
    top = words.where("block is null and h is not null").orderBy(F.desc("n"), "h").limit(HEAD - 1).collect()
    v, n = sum(r["v"] for r in by_shape) + (ends > 0), sum(r["n"] for r in by_shape) + ends
    head = np.sort(np.append(np.array([r["h"] for r in top], np.int64).view(np.uint64), _END))
    head = np.concatenate([head, np.full(HEAD - len(head), np.iinfo(np.uint64).max)])
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_shape:
        class_n[HEAD + r["shape"]], class_v[HEAD + r["shape"]] = r["n"], r["v"]
    for r in top:
        own = int(np.searchsorted(head, np.int64(r["h"]).view(np.uint64)))
        class_n[own], class_v[own] = r["n"], 1
        class_n[HEAD + r["shape"]] -= r["n"]
        class_v[HEAD + r["shape"]] -= 1
    end_kind = int(np.searchsorted(head, _END))
    class_n[end_kind] += ends
    class_v[end_kind] += ends > 0
    bias = np.log((class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)).astype(np.float32)
    pairs = stored(key_totals(coded, _pair_keys_by(head, bits), parts).where("block is not null").select("block", "start", "part", "totals"), "pair-totals")
    release(spark)
    shared = spark.sparkContext.broadcast(train(coded, head, bias, rounds))  # fixed size
    release(spark)

    def score(docs_of: pa.Table, totals_of: pa.Table) -> pa.Table:
        docs_of = docs_of.sort_by("place")
        counted = totals_of.sort_by([("family", "ascending"), ("start", "ascending"), ("part", "ascending")])
        t = ended(*_words_of(docs_of), head)
        ids, held = _flat(docs_of["doc_id"]), _flat(docs_of["held_out"])
        family, start, totals_by_row = counted["family"].to_numpy(), counted["start"].to_numpy(), counted["totals"].to_pylist()
        count = np.full(len(t.hash), ends, np.int64)  # of end tokens, for a start
        after, context = np.zeros(len(t.hash), np.int64), np.zeros(len(t.hash), np.int64)
        word = np.ones(len(t.hash), bool)
        word[t.first[1:] - 1] = False
        for kind in (0, 1):
            mine = np.flatnonzero(family == kind)
            if not len(mine):
                continue
            begins = mine[np.flatnonzero(np.concatenate([[True], start[mine][1:] != start[mine][:-1]]))]
            rows = start[begins]  # places in a block count its texts from 0
            for i, (row, at) in enumerate(zip(rows, begins, strict=True)):  # the runs of texts that were counted together
                last = rows[i + 1] if i + 1 < len(rows) else len(ids)
                stop = begins[i + 1] if i + 1 < len(begins) else mine[-1] + 1
                totals = _all([unpacked(x, np.int64) for x in totals_by_row[at:stop]], np.int64)
                low = t.first[row]
                some = t.part(row, last)
                if kind == 0:
                    inside = low + np.flatnonzero(word[low : low + len(some.hash)])
                    count[inside] = _per_key(t.hash[inside], totals)
                else:
                    where, pair, ahead = pair_keys(some, bits)
                    found = _per_key(np.concatenate([pair, ahead]), totals)
                    after[low + where], context[low + where] = found[: len(where)], found[len(where) :]
        known = np.where(word, count > 0, ends > 0)
        base = np.log10((count + 1) / (n + v + 1))
        share = (count + 1) / (class_n[t.kind] + class_v[t.kind] + 1)
        model = np.log10((after + pull * share) / (context + pull))
        weights = shared.value
        for begin, end in _cuts(t.first, 1 << 16):
            some = t.part(begin, end)
            feature = features(some)
            for at in range(0, len(feature), 8192):  # in cache
                found = class_scores(weights, bias, feature[at : at + 8192], some.kind[at : at + 8192])
                model[t.first[begin] + at : t.first[begin] + at + len(found)] += found / np.log(10)
        some = t.first[:-1]
        return pa.table(
            {
                "doc_id": ids, "held_out": held, "n_tokens": np.diff(t.first), "n_known": np.add.reduceat(known, some, dtype=np.int64),
                "train_tokens": np.full(len(some), n, np.int64), "base_score": np.add.reduceat(base, some), "score": np.add.reduceat(model, some),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    totals = words.where("block is not null").select("block", "start", "part", "totals", F.lit(0).alias("family")).union(pairs.withColumn("family", F.lit(1)))
    texts = coded.drop("n_words", "n_training")
    return texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema)


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    return split_words(data, np.array([0, len(data)])).hash
