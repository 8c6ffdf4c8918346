import random

import numpy as np
import pytest
import xxhash

from gridtide.llm import simhash
from gridtide.llm.components import components


def plain_mark(text, words=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(marks, distance=3):
    label = {}
    order = sorted(marks)
    for i in order:
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            x = todo.pop()
            for j in order:
                if j not in label and (marks[x] ^ marks[j]).bit_count() <= distance:
                    label[j] = i
                    todo.append(j)
    return label


def test_documents_equal_brute_force(spark, sf_dir):
    from gridtide.llm.queries import op2_simhash_near_duplicates

    rows = op2_simhash_near_duplicates(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {i: plain_mark(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(marks)


@pytest.mark.parametrize("small, block", [(32, 1024), (0, 16), (2, 5)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    marks = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 2**63, 1 << 32, 0xFFFFFFFF}
    for m in list(marks)[:20]:
        for _ in range(12):
            x = m
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            marks.add(x)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    for a, b in edges.collect():
        assert a in signed and b in signed
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    want = plain_components({s: s & (2**64 - 1) for s in signed})
    assert {s: got.get(s, s) for s in signed} == want


def test_edge_rows(spark, documents):
    long = "many words here " * 20_000
    docs = documents([(5, None), (4, ""), (9, " \n"), (3, "A b"), (8, "a  B"), (7, long), (2, long), (None, long), (2, long)])
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    zero, ab, x = "0" * 16, f"{plain_mark('a b'):016x}", f"{plain_mark(long):016x}"
    assert got == sorted([(5, zero, 4), (4, zero, 4), (9, zero, 4), (3, ab, 3), (8, ab, 3), (7, x, 2), (2, x, 2), (-1, x, 2), (2, x, 2)])
    assert simhash.near_duplicates(documents([])).collect() == []
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [2, 3, 4]
    assert kept.columns == docs.columns
    named = documents([(1, "some words of one text"), (2, "some words of one text"), (3, "other")]).selectExpr("*", "7 as _row", "8 as r", "9 as own")
    assert sorted(r["doc_id"] for r in simhash.keep_one(named).collect()) == [1, 3]
    nameless = named.union(named.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "_row", "r", "own")).union(named.selectExpr("3L", "'a third text'", "lang", "source", "n_chars", "_row", "r", "own"))
    left = simhash.keep_one(nameless)
    assert left.columns == named.columns and {r["_row"] for r in left.collect()} == {7}
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, "some words of one text"), (3, "a third text"), (3, "other")]
    lost = documents([(None, "only without id"), (None, "only without id"), (None, "another one here")])
    assert sorted(r["text"] for r in simhash.keep_one(lost).collect()) == ["another one here", "only without id"]
    clash = docs.selectExpr("doc_id", "text", "1 as fp", "2 as label", "3 as node", "4 as component_id")
    assert simhash.near_duplicates(clash).count() == 9


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
