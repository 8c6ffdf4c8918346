"""Each stage of the pipeline against a plain version of it, on the smallest tables."""

import importlib.util
import os

import pytest
from test_simhash import plain_components, plain_mark

from gridtide.llm import packing, quality
from gridtide.llm.tables import stored, table

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{TOP}/corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def plain_passages(rows, least=100):
    """Texts without the characters that lie whole in a repeat."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - least + 1):
            if data[s : s + least] in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(data[s : s + least])
        kept, at = [], 0
        for c in text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_every_stage(spark, sf_dir, pipeline):
    docs = table(spark, sf_dir, "documents")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf_dir), name.replace(" ", "-")))
    for frame in kept[1:-1]:
        assert frame.dtypes == docs.dtypes
    texts = [{r["doc_id"]: r["text"] for r in frame.collect()} for frame in kept[:-1]]
    judged = quality.importance(docs, table(spark, sf_dir, "labels"))
    assert set(texts[1]) == {r["doc_id"] for r in judged.where("kept").collect()}
    label = plain_components({i: plain_mark(t) for i, t in texts[1].items()})
    assert texts[2] == {i: texts[1][i] for i in set(label.values())}
    assert texts[3] == plain_passages(texts[2])
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    holders = {i for i, t in texts[3].items() if any(q in t for q in items)}
    assert holders.isdisjoint(texts[4]) and len(texts[3]) - len(texts[4]) <= len(holders) + 3
    assert all(texts[4][i] == texts[3][i] for i in texts[4])
    assert {r["n_chars"] == len(r["text"]) for r in kept[3].collect()} == {True}
    last = kept[-1].collect()
    assert {r["doc_id"] for r in last} == set(texts[4])
    assert sum(r["length"] for r in last) == sum(r["length"] for r in packing.pieces(kept[4]).collect())


def test_empty_tables(spark, sf_dir, pipeline):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0
