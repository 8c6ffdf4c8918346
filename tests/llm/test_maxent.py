import gc
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import maxent


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain(rows):
    out = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not out[i]:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (i or -1, out[i], len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6))
        for i, t in rows
    )


def got(frame, **options):
    return sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in maxent.scored(frame, **options).collect())


def test_counts_and_held_out_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = maxent.scored(docs, block_bytes=1 << 18).cache()
    found = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows.collect())
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5] for f in found], [w[5] for w in want], atol=1e-6)
    held = rows.where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert held["s"] / held["n"] > held["b"] / held["n"] + 0.2  # log10 a token, on text it has not seen


def plain_scores(rows, pull):
    """Scores of untrained class weights: class by its frequency, word in the class by the word before."""
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts, pairs, contexts = Counter(), Counter(), Counter()
    for i, t in rows:
        if not out[i]:
            counts.update(words(t))
    ends = sum(not out[i] for i, _ in rows)
    key = {w: int(maxent._hashes([w.encode()])[0]) for i, t in rows for w in words(t)}
    head = sorted(counts, key=lambda w: (-counts[w], np.uint64(key[w]).astype(np.int64)))[: maxent.HEAD - 1]

    def kind(w):
        if w is None or w in head:
            return w
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(maxent.word_shapes(raw, maxent.split_words(raw, np.array([0, len(raw)])))[0])

    for i, t in rows:
        if not out[i]:
            for u, w in zip([None, *words(t)], words(t), strict=False):
                pairs[u, w] += 1
                contexts[u, kind(w)] += 1
    counts[None] = ends
    class_n, class_v = Counter(), Counter()
    for w, c in counts.items():
        class_n[kind(w)] += c
        class_v[kind(w)] += c > 0
    total = sum(class_n.values()) + 0.5 * maxent.CLASSES
    got = []
    for i, t in rows:
        score = 0.0
        for u, w in zip([None, *words(t)], [*words(t), None], strict=True):
            k = kind(w)
            q = (counts[w] + 1) / (class_n[k] + class_v[k] + 1)
            inside = (pairs[u, w] + pull * q) / (contexts[u, k] + pull) if isinstance(k, int) else q
            score += math.log10((class_n[k] + 0.5) / total * inside)
        got.append((i, score))
    return sorted(got)


@pytest.mark.parametrize("block_bytes", [1, 400, 1 << 20])
def test_scores_equal_plain_ones_whatever_the_blocks(spark, documents, block_bytes):
    rng = np.random.default_rng(5)
    vocabulary = [f"{chr(97 + k % 26)}{chr(97 + k // 9)}{'é' * (k % 3)}{k}" for k in range(90)]
    rows = [(i, " ".join(vocabulary[min(89, int(k))] for k in rng.exponential(25, rng.integers(0, 40)))) for i in range(120)]
    rows += [(7, "twice the same"), (7, "twice the same"), (500, "x y " * 400)]
    found = maxent.scored(documents(rows, 5), rounds=0, block_bytes=block_bytes, pull=3.0, part_keys=70).collect()
    got, want = sorted((r["doc_id"], r["score"]) for r in found), plain_scores(rows, 3.0)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_a_block_may_be_read_in_several_runs(spark, documents):
    """A stored file that Spark cuts within a block gives totals of each run apart."""
    rows = [(i, f"a b{i % 7} c{i % 5} d e{i}") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        coded = maxent.encoded(documents(rows, 2), 1 << 20).repartition(6)
        runs = maxent.key_totals(coded, maxent._word_keys, 3).where("block is not null").select("block", "start").distinct().count()
        sums = maxent.key_totals(coded, maxent._word_keys, 3).where("v is not null").selectExpr("sum(n) as n", "sum(v) as v").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows)[0][4]
    assert runs > 2 and sums["n"] == want - sum(not r[1] for r in plain(rows))


def test_edge_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "a b A"), (4, "a b"), (4, "a b"), (None, "c"), (5, "wörd " * 30_000), (14, "new word")]
    assert got(documents(rows)) == plain(rows)
    assert got(documents([])) == []
    only_held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert got(documents(only_held)) == plain(only_held)
    clash = documents(rows).selectExpr("doc_id", "text", "1 as block", "2 as word", "3 as c", "4 as held_out")
    assert maxent.scored(clash).count() == len(rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32), rng.normal(size=maxent.CLASSES).astype(np.float32)
    rows, kind = rng.integers(0, maxent.ROWS, (50, 4)), rng.integers(0, maxent.CLASSES, 50)
    share = maxent.class_shares(weights, bias, rows)
    assert np.allclose(share.sum(1), 1, atol=1e-5)
    assert np.allclose(maxent.class_scores(weights, bias, rows, kind), np.log(share[np.arange(50), kind]), atol=1e-4)


def test_gradient_step_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    bias = rng.normal(size=maxent.CLASSES).astype(np.float32)
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows, kind = rng.integers(0, 40, (30, 4)), rng.integers(0, maxent.CLASSES, 30)
    slope = maxent.class_shares(weights, bias, rows)
    slope[np.arange(30), kind] -= 1
    want, energy, met = weights.copy(), np.full(maxent.ROWS, 10, np.float32), np.zeros(maxent.ROWS)
    for r in set(rows.ravel().tolist()):
        total = sum(slope[i] * (rows[i] == r).sum() for i in range(30))
        want[r] -= 0.5 * total / np.sqrt(10 + (total**2).sum())
    maxent.gradient_step(weights, energy, met, bias, rows, kind, 0.5)
    assert np.allclose(weights, want, atol=1e-4) and met.sum() == rows.size


@pytest.mark.parametrize("text", ["", "a", "a b c d e f", "é ñandú straße x*** y!!"])
def test_features_look_back_within_the_text(text):
    head = np.sort(np.append(maxent._hashes([b"a", b"b"]), maxent._END))
    alone = text.encode()
    both = b"other words before" + alone
    one = maxent.tokens(np.frombuffer(alone, np.uint8), np.array([0, len(alone)]), head)
    two = maxent.tokens(np.frombuffer(both, np.uint8), np.array([0, len(both) - len(alone), len(both)]), head)
    assert two.first.tolist() == [0, 4, 4 + len(one.hash)]
    assert (maxent.features(two)[4:] == maxent.features(one)).all() and (two.kind[4:] == one.kind).all()


def test_run_sums_match_plain_sums():
    rng = np.random.default_rng(3)
    for lengths in ([1], [1, 1, 5, 2, 1, 64, 3], rng.integers(1, 40, 50)):
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        values = rng.normal(size=(int(np.sum(lengths)), 7))
        assert np.allclose(maxent.run_sums(values.copy(), begin), [values[b : b + n].sum(0) for b, n in zip(begin, lengths, strict=True)])


@pytest.mark.parametrize("lengths", [[1], [16], [17, 1], [1, 1, 5, 2, 1, 64, 3, 33], [700, 2, 255]])
def test_picked_sums_equal_run_sums_to_the_last_bit(lengths):
    rng = np.random.default_rng(4)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    values, at = rng.normal(size=(50, 7)).astype(np.float32), rng.integers(0, 50, int(np.sum(lengths)))
    assert (maxent.picked_sums(values, at, begin) == maxent.run_sums(values[at], begin)).all()


def test_a_gradient_step_leaves_nothing_behind():
    """Arrays held by a reference cycle would pile up until Python looks for cycles."""
    weights, bias = np.zeros((maxent.ROWS, maxent.CLASSES), np.float32), np.zeros(maxent.CLASSES, np.float32)
    rows = np.random.default_rng(6).integers(0, 40, (300, 4))
    gc.collect()
    gc.disable()
    try:
        maxent.gradient_step(weights, np.full(maxent.ROWS, 10, np.float32), np.zeros(maxent.ROWS), bias, rows, rows[:, 0], 1.0)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_distinct_keys_cost_about_a_sort():
    for some in ([], [5], [7, 7, 7], [2**64 - 1, 0, 3, 0]):
        keys = np.array(some, np.uint64)
        assert maxent.distinct(keys).tolist() == sorted(set(some))
    keys = maxent.mixed(np.arange(1_000_000, dtype=np.uint64) % np.uint64(900_000))

    def seconds(work):
        spent = []
        for _ in range(3):
            begin = time.process_time()
            work()
            spent.append(time.process_time() - begin)
        return min(spent)

    assert len(maxent.distinct(keys)) == 900_000
    assert seconds(lambda: maxent.distinct(keys)) < 5 * seconds(lambda: np.sort(keys))


def test_tokens_before_stay_within_the_text():
    t = maxent.Tokens(np.arange(10, 17, dtype=np.uint64), np.arange(7), np.array([0, 1, 1, 3, 7]))
    assert [t.back(t.kind, k, -1).tolist() for k in (1, 2, 3)] == [[-1, -1, 1, -1, 3, 4, 5], [-1, -1, -1, -1, -1, 3, 4], [-1, -1, -1, -1, -1, -1, 3]]
    none = maxent.Tokens(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array([0]))
    assert none.back(none.kind, 2, -1).tolist() == []
