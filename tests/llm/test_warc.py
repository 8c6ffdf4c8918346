import gzip
import hashlib
import random
from base64 import b32encode

import pytest

from gridtide.llm import warc

PAGES = "page_id long, url string, html string"
TRICKY = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n0\r\n\r\nabc\r\n\r\n" * 40


def sha1(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(pages, least=0):
    out = []
    for i, _, html in pages:
        size = len((html or "").encode())
        last = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        revisit = size >= least and i != last
        out.append((i, size, sha1(html), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def read_back(spark, folder):
    found = warc.resolved(warc.read_archives(spark, folder, payloads=False))
    assert found.where("problem is not null").count() == 0
    return sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").collect()), key=repr)


def test_pages_equal_brute_force(spark, sf_dir):
    from gridtide.llm.queries import op12_archived_pages

    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    result = op12_archived_pages(spark, sf_dir)
    assert result.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert sorted((tuple(r) for r in result.collect()), key=repr) == plain(pages)


@pytest.mark.parametrize("least, segment, chunk, archive", [(0, 1 << 16, 1 << 14, 1 << 25), (10, 700, 64, 5000), (1, 97, 1, 1), (10**9, 1000, 999, 10**5)])
def test_round_trip(spark, tmp_path, least, segment, chunk, archive):
    rng = random.Random(8)
    texts = ["", None, "same", "é" * 501, "日本" * 333 + "\r\n", TRICKY, "x" * (1 if chunk == 1 else 300_000), "\x00\x01\r\n"]
    pages = [(i, rng.choice(["http://a.b/c d\r\nWARC-Type: x", None, "", "https://例え.jp/"]), rng.choice(texts)) for i in rng.sample(range(1000), 40)]
    pages += [(2000 + i, None, "copied page") for i in range(30)]
    folder = str(tmp_path / "archives")
    frame = spark.createDataFrame(pages, PAGES).repartition(5)
    warc.write_archives(frame.selectExpr("*", "1 as row", "2 as archive", "3 as last", "4 as text"), folder, least, segment, chunk, archive)
    assert read_back(spark, folder) == plain(pages, least)
    found = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, folder).where("kind = 'response'").collect()}
    want = plain(pages, least)
    assert {i: bytes(p) for i, p in found.items()} == {i: (t or "").encode() for i, _, t in pages if (i in {w[0] for w in want if w[3] == "response"})}
    files = list((tmp_path / "archives").rglob("part-*.gz"))
    whole = b"".join(gzip.open(f).read() for f in files)
    assert whole.count(b"WARC-Type: warcinfo\r\n") == len(files)
    assert max(len(gzip.open(f).read()) for f in files) <= archive + segment + 1000
    assert (b"WARC-Segment-Total-Length" in whole) == (segment < 1 << 16 or "x" * 300_000 in {t for _, _, t in pages})


def test_repeated_and_missing_ids(spark, tmp_path):
    pages = [(5, None, "a"), (5, None, "a"), (None, None, "a"), (None, None, "b"), (None, None, "b"), (7, "u", "c"), (7, "v", "d")]
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(pages, PAGES), folder)
    got = read_back(spark, folder)
    assert got == sorted([(5, 1, sha1("a"), "response", None), (5, 1, sha1("a"), "revisit", 5), (None, 1, sha1("a"), "revisit", 5), (None, 1, sha1("b"), "response", None), (None, 1, sha1("b"), "revisit", None), (7, 1, sha1("c"), "response", None), (7, 1, sha1("d"), "response", None)], key=repr)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.resolved(warc.read_archives(spark, folder)).collect() == []


def segments(page_id=1, text="0123456789" * 30, name="<urn:one>"):
    return list(warc.page_records(page_id, "http://x/", text.encode(), name, None, "2024-01-01T00:00:00Z", 100, 7))


def problems(spark, folder, files):
    folder.mkdir()
    for i, content in enumerate(files):
        (folder / f"{i}.warc").write_bytes(content)
    return sorted(((r["kind"] or "", r["problem"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(spark, str(folder)).collect()), key=repr)


def test_segments_in_any_order_and_file(spark, tmp_path):
    one, end = segments(), b"\r\n\r\n"
    assert len(one) > 5
    text = b"0123456789" * 30
    shuffled = [end.join([one[3], one[0], one[5]]) + end, gzip.compress(one[1] + end) + gzip.compress(one[4] + end), *(r + end for r in [one[2], *one[6:], one[2]])]
    assert problems(spark, tmp_path / "a", shuffled) == [("response", None, text)]
    assert problems(spark, tmp_path / "b", [r + end for r in one if r is not one[2]]) == [("response", "segments missing", None)]
    assert problems(spark, tmp_path / "c", [r + end for r in one[:-1]]) == [("response", "segments missing", None)]
    assert problems(spark, tmp_path / "d", [r + end for r in one[1:]]) == [("continuation", "segments missing", None)]
    changed = one[2][:-1] + b"?"
    assert problems(spark, tmp_path / "e", [r + end for r in [*one, changed]]) == [("response", "segments differ", None)]
    assert problems(spark, tmp_path / "f", [r + end for r in [*one[:2], changed, *one[3:]]])[0][1] in ("payload digest", "chunk framing")
    total = one[-1].replace(b"Total-Length: ", b"Total-Length: 9")
    assert problems(spark, tmp_path / "g", [end.join([*one[:-1], total]) + end]) == [("response", "total length", None)]


def test_broken_archives(spark, tmp_path):
    end = b"\r\n\r\n"
    (whole,) = warc.page_records(4, None, b"fine", "<urn:w>", None, "2024-01-01T00:00:00Z")
    other = b"WARC/1.0\r\nwarc-type: RESPONSE\r\nContent-Length: 3\r\n\r\nabc"
    head = b"HTTP/1.0 200 OK\r\nContent-Length: 5\r\n\r\n"
    plain_http = b"WARC/1.0\r\nwarc-type: response\r\nwarc-target-uri: a\r\n  b\r\ncontent-length: %d\r\n\r\n%bhello" % (len(head) + 5, head)
    files = [whole + end + whole[:-2], b"no archive", b"", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", other + end + plain_http + end]
    want = [("response", None, b"fine"), ("response", "cut off", None), ("", "cut off", None), ("", "unreadable header", None), ("response", None, b"hello")]
    assert sorted(map(repr, problems(spark, tmp_path / "a", files))) == sorted(map(repr, want))
    squeezed = gzip.compress(whole + end)
    assert [(p, b) for _, p, b in problems(spark, tmp_path / "b", [squeezed[: len(squeezed) // 2]])] in ([("cut off", None)], [])


def test_chunks():
    for text in (b"", b"a", b"\r\n0\r\n\r\n", bytes(range(256)) * 9):
        for size in (1, 2, 255, 10_000):
            assert warc.unchunked(warc.chunked(text, size)) == text
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\n\r\n", b"1\r\na\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
