import hashlib
import random

import numpy as np
import pytest

from gridtide.llm import suffixes


def plain(rows, least=100):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - least + 1):
            if data[s : s + least] in seen:
                gone[s : s + least] = b"\1" * least
            else:
                seen[data[s : s + least]] = 1
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame, **options):
    rows = suffixes.without_repeats(frame, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(10, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(0, 25)) for _ in range(rng.randrange(0, 8))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500 + i, rows[i][1][: rng.randrange(1, 400)] + text(3) + rows[i][1][rng.randrange(1, 400) :]) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"crowd": 0}), (3, {"crowd": 3, "chunk": 5})])
def test_passages_equal_brute_force(spark, documents, seed, options):
    rows = passages(seed)
    assert got(documents(rows), **options) == plain(rows)


def test_edge_rows(spark, documents):
    rows = [
        (1, None), (2, ""), (3, "a" * 1000), (4, "ab" * 300), (5, "x" * 99), (6, "x" * 100), (7, "x" * 101), (8, "\x00" * 250), (9, "é" * 200), (10, "a" + "é" * 120),
        (11, "long words " * 20_000), (12, "é" * 60 + "\x00" * 130),
    ]
    assert got(documents(rows)) == plain(rows)
    assert got(documents([])) == []
    rows = [(None, "n" * 150), (1, "n" * 150), (2, "abc" * 50), (2, "abc" * 60), (2, "abc" * 60)]
    assert got(documents(rows)) == plain(rows)
    clash = documents([(1, "t" * 300)]).selectExpr("doc_id", "text", "1 as key", "2 as h", "3 as rest", "'k' as kept_text")
    kept = suffixes.keep_first(clash)
    assert kept.columns == clash.columns and [tuple(r) for r in kept.collect()] == [(1, "t", 1, 2, 3, "k")]
    # a character goes only with all its bytes: 'é' is half covered here
    two = suffixes.keep_first(documents([(1, "z" * 10 + "é" * 60), (2, "q" + "é" * 60)]))
    assert {r["doc_id"]: r["text"] for r in two.collect()}[2] == "q"


def test_repeats_list_all_occurrences():
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcd") for _ in range(130))
    contexts = [b"1" + base + b"2", b"3" + base + b"4", b"1" + base[:110] + b"5", base[:105]]
    counts = np.array([len(c) - 99 for c in contexts])
    prefix, low, high, place = suffixes.maximal_repeats(contexts, counts)
    found = {}
    for p, i, j in zip(prefix, low, high, strict=True):
        c, s = place[i]
        found[contexts[c][s : s + p]] = {tuple(x) for x in place[i : j + 1].tolist()}
    assert found[base] == {(0, 1), (1, 1)}
    assert found[b"1" + base[:110]] == {(0, 0), (2, 0)}
    assert found[base[:110]] == {(0, 1), (1, 1), (2, 1)}
    assert found[base[:105]] == {(0, 1), (1, 1), (2, 1), (3, 0)}
    assert base[1:] not in found  # always preceded by the same byte


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(6)
    piece = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [bytes(rng.choice(b"xyz") for _ in range(n)) + piece for n in (0, 37, 211)]
    marks = []
    for t in texts:
        h, first, count, at = suffixes.anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        by_start = {int(s) + k - (len(t) - 300): (int(x), int(s) + int(a) - (len(t) - 300)) for x, s, n, a in zip(h, first, count, at, strict=True) for k in range(n)}
        assert len(by_start) == len(t) - 99
        marks.append([by_start[s] for s in range(201)])
    assert marks[0] == marks[1] == marks[2]
