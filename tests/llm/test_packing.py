import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtide.llm import packing
from gridtide.llm.tables import stored
from gridtide.llm.tokens import encoder


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", " ", "one two", "a  b", " lead and trail ", "line\nnext \n x", "it's we'll 12,5 Ünïcödé ñ\tx", "<|endoftext|> a <|endoftext|>", "a\u00a0b \u2003c d\u3000", "x" * 5000, "\x1c a \x1f b"],
)
def test_ids_equal_the_whole_text_tokenizer(plain, text):
    assert np.frombuffer(encoder().ids([text])[0], "<u4").tolist() == plain(text)


def test_ids_of_documents(spark, sf_dir, plain):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder().ids(texts)] == [plain(t) for t in texts]


def whole(rows, plain, texts, length=1024):
    ids = {d: [*plain(t or ""), 2] for d, t in texts.items()}
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= length
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    for d, parts in by_doc.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert [s for _, s, _ in parts] == list(np.cumsum([0] + [n for _, _, n in parts])[:-1])
        assert sum(n for _, _, n in parts) == len(ids[d])
        assert len(parts) == 1 or all(n == length for _, _, n in parts[1:])
    assert set(by_doc) == set(ids)
    return len(places), packing.least_bins(np.bincount([r["length"] for r in rows], minlength=length + 1))


def test_packs_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made, least = whole(packing.packed_documents(docs).collect(), plain, texts)
    assert made <= least + 1
    made, least = whole(packing.packed_documents(docs, group=64).collect(), plain, texts)
    assert made <= 1.05 * least


def test_edge_rows(spark, documents, plain):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "word", 5: "word"}
    rows = packing.packed_documents(documents(texts.items())).collect()
    whole(rows, plain, texts)
    assert packing.packed_documents(documents([])).collect() == []
    clash = documents([(1, "a")]).selectExpr("doc_id", "text", "1 as piece", "2 as part", "3 as length", "4 as sequence_id")
    assert len(packing.packed_documents(clash).collect()) == 1
    twice = packing.packed_documents(documents([(None, "a b"), (7, "x"), (7, "x")])).collect()
    assert sorted((r["doc_id"] or -1) for r in twice) == [-1, 7, 7]


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 700, 4000)
    rows = [(i, 0, 0, int(s), i) for i, s in enumerate(sizes)]
    cut = stored(spark.createDataFrame(rows, packing.PIECES), "test-pieces")
    bins = packing.pack(cut, 1024, 100).select("sequence_id").distinct().count()
    alone = packing.pack(cut, 1024, 100, rounds=0).select("sequence_id").distinct().count()
    bound = packing.least_bins(np.bincount(sizes, minlength=1025))
    assert bound <= bins < alone


@pytest.mark.parametrize("seed", range(6))
def test_bound_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 11, 9)
    bins = packing.best_fit(sizes, 10)
    assert np.bincount(bins, weights=sizes).max() <= 10

    def exact(left, rooms):
        if not left:
            return len(rooms)
        best = 99
        for i, room in enumerate(rooms):
            if room >= left[0] and room not in rooms[:i]:
                best = min(best, exact(left[1:], [*rooms[:i], room - left[0], *rooms[i + 1 :]]))
        return min(best, exact(left[1:], [*rooms, 10 - left[0]])) if len(rooms) < 9 else best

    optimum = exact(sorted(sizes.tolist(), reverse=True), [])
    assert packing.least_bins(np.bincount(sizes, minlength=11)) <= optimum <= bins.max() + 1


def test_bound_sees_large_items():
    assert packing.least_bins(np.bincount([600] * 10, minlength=1025)) == 10
    assert packing.least_bins(np.bincount([400] * 10, minlength=1025)) == 5
