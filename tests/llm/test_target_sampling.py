import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import target_sampling as ts


def plain(docs, target, buckets=10_000, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by plain loops and zlib."""
    upper = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        f = found(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = Counter()
    out = [(*r[:4], None) for r in rows if r[4] < least]
    drawn = percent * len(order) // 100
    for place, r in enumerate(order, 1):
        rank[r[0]] += 1
        out.append((*r[:4], place if place <= drawn else None))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_span_crcs_equal_zlib():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    raw = data.tobytes()
    sizes = [0, 1, 2, 3, 4, 63, 64, 65, 127, 128, 129, 192, 193, 1000, 4096, 65_537, 250_000, *rng.integers(0, 400, 500).tolist()]
    start = np.array([int(rng.integers(0, 300_000 - n + 1)) for n in sizes])
    end = start + np.array(sizes)
    assert ts.span_crcs(data, start, end).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
    assert len(ts.span_crcs(data, start[:0], end[:0])) == 0
    zeros = np.zeros(5000, np.uint8)
    assert ts.span_crcs(zeros, np.array([0, 7]), np.array([5000, 4000])).tolist() == [zlib.crc32(bytes(5000)), zlib.crc32(bytes(3993))]


def test_documents_equal_brute_force(spark, sf_dir):
    from gridtide.llm.queries import op13_target_resampling

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    result = op13_target_resampling(spark, sf_dir)
    assert dict(result.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert got(result) == plain(docs, target)


@pytest.mark.parametrize("percent, least", [(5, 20), (50, 1), (100, 0)])
def test_edge_rows(spark, documents, percent, least):
    rng = random.Random(4)
    vocabulary = ["Straße", "ÉTÉ", "42nd", "a", "_x_", "naïve", "don't", "日本語", "UPPER", "z" * 70, "é" * 100]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (900, None), (901, ""), (902, " \n\x00 .,;"), (903, "x" * 300_000), (904, "ab " * 40_000)]
    target = ["a Straße 42nd don't", "", None, "naïve " * 30]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    result = ts.resampled(documents(rows, 4), bench, percent=percent, least_words=least)
    assert got(result) == plain(rows, target, percent=percent, least=least)


def test_empty_tables_and_clashing_columns(spark, documents):
    bench = spark.createDataFrame([("some words",)], "text string")
    assert ts.resampled(documents([]), bench).collect() == []
    rows = [(1, "some words and others " * 9), (2, "nothing here " * 12)]
    assert got(ts.resampled(documents(rows), bench.limit(0), percent=50)) == plain(rows, [], percent=50)
    clash = documents(rows).selectExpr("doc_id", "text", "1 as weight", "2 as score", "3 as rank", "4 as place", "5 as bucket", "6 as n", "7 as range")
    assert got(ts.resampled(clash, bench, percent=50)) == plain(rows, ["some words"], percent=50)
