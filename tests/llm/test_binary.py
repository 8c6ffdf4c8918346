import os
import zlib

import numpy as np
import pytest

from gridtide.llm import binary
from gridtide.llm.tables import shared_folder
from gridtide.llm.tokens import encoder


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 256, 1000, 70_000])
def test_feistel_is_a_permutation(n):
    got = binary.feistel(np.arange(n), n, 12345)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != binary.feistel(np.arange(n), n, 12346)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.2


def local(folder):
    return folder.removeprefix("file://").removeprefix("file:")


def read_back(folder, rows, length, per_shard):
    sizes = {}
    for r in rows:
        path = f"{local(folder)}/shard-{r['shard']:08d}.bin"
        with open(path, "rb") as f:
            f.seek(r["byte_offset"])
            ids = f.read(2 * length)
        assert len(ids) == 2 * length and zlib.crc32(ids[: 2 * r["n_tokens"]]) == r["ids_crc32"]
        assert set(np.frombuffer(ids[2 * r["n_tokens"] :], "<u2")) <= {50256}
        assert r["slot"] == r["shard"] * per_shard + r["byte_offset"] // (2 * length)
        sizes[path] = os.path.getsize(path)
        yield r, np.frombuffer(ids[: 2 * r["n_tokens"]], "<u2").tolist()
    assert sum(sizes.values()) == len(rows) * 2 * length


def test_shards_hold_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    folder = shared_folder(spark, "test-shards")
    rows = binary.training_shards(docs, folder, length=64, per_shard=100, waves=3).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    parts = {}
    for r, ids in read_back(folder, rows, 64, 100):
        parts.setdefault(r["doc_id"], {})[r["piece"]] = ids
    for doc in docs.collect():
        want = [*np.frombuffer(encoder().ids([doc["text"]])[0], "<u4").tolist(), 50256]
        assert sum((parts[doc["doc_id"]][i] for i in range(len(parts[doc["doc_id"]]))), []) == want


def test_goes_on_where_it_stopped(spark, documents):
    docs = documents([(i, "some words " * (i % 7)) for i in range(50)]).cache()
    folder = shared_folder(spark, "test-shards")
    rows = binary.training_shards(docs, folder, length=8, per_shard=16).collect()
    files = sorted(os.listdir(local(folder)))
    first, second = (f"{local(folder)}/{f}" for f in [f for f in files if f.endswith(".bin")][:2])
    with open(first, "rb") as f:
        whole = f.read()
    with open(first, "wb") as f:
        f.write(whole[:10])
    stamp = os.stat(second).st_mtime_ns
    assert sorted(binary.training_shards(docs, folder, length=8, per_shard=16).collect()) == sorted(rows)
    with open(first, "rb") as f:
        assert f.read() == whole
    assert os.stat(second).st_mtime_ns == stamp


def test_edge_rows(spark, documents):
    folder = shared_folder(spark, "test-shards")
    docs = documents([(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b"), (4, "long " * 10_000)])
    rows = binary.training_shards(docs, folder, length=16, per_shard=64).collect()
    assert len(list(read_back(folder, rows, 16, 64))) == len(rows)
    assert sorted((r["doc_id"] or -1) for r in rows if r["piece"] == 0) == [-1, 1, 2, 3, 3, 4]
    assert binary.training_shards(documents([]), shared_folder(spark, "test-shards")).collect() == []
    clash = documents([(1, "a")]).selectExpr("doc_id", "text", "1 as slot", "2 as shard", "3 as split", "4 as ids")
    assert binary.training_shards(clash, shared_folder(spark, "test-shards")).count() == 1
