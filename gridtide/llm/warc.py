"""Web archives: pages written as WARC records, and records put together again from their segments."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtide.llm.tables import stored

SEGMENT = 64 << 10  # bytes of a record's block; more go on in continuation records
CHUNK = 16 << 10  # bytes of a chunk of the transfer coding
ARCHIVE = 32 << 20  # bytes of records in an archive before compression
BREAK = b"\r\n\r\n"  # after the header fields, and after each record
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_FIELDS = "record_id string, kind string, page_id long, uri string, refers_id string, payload_bytes long, payload_digest string, problem string"
_PIECES = "origin string, segment int, total long, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP/1.1 chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + BREAK


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailer fields are passed over. Broken framing is an error."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        digits = body[at:line].split(b";", 1)[0].strip() if line >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk framing")
        size, at = int(digits, 16), line + 2
        if not size:
            if body[at : at + 2] != b"\r\n" and body.find(BREAK, at) < 0:
                raise ValueError("chunk framing")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk framing")
        out.append(body[at : at + size])
        at += size + 2


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _record(fields: list[tuple[str, object]], block: bytes = b"") -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, name: str, refers: str | None, date: str, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page: a revisit if ``refers`` names a record, else a response with its continuations."""
    uri = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Page-Id", page_id), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers), ("Content-Type", "application/http;msgtype=response")]
        yield _record(kind + fields, _HTTP)
        return
    block = _HTTP + chunked(payload, chunk)
    first = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        more = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", _name(name, number)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None),
        ]
        yield _record(more, block[at : at + segment])


def write_archives(
    pages: DataFrame, folder: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, archive: int = ARCHIVE, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """Writes a record per row of ``pages`` to compressed archives below ``folder``; the payload is the text in UTF-8 (null: empty).

    Of rows with equal payloads of ``least`` bytes or more the one with the largest id is the response (without ids, or
    with a repeated one, any one row) and the others revisit it; smaller ones are all responses. Equal payloads are told by
    their SHA-256. The last row of each payload is found by a maximum that combines before its shuffle, and joined back by row, so
    copies meet in no task. A response's identifier follows from its payload: a revisit names it without a join.

    Blocks of more than ``segment`` bytes go on in continuation records. A task opens a new archive after ``archive`` bytes; Spark's
    writer puts the separator after each record and moves only the files of committed tasks to their place. An empty table
    gives an empty folder. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("text"))
    n, ids, distinct = rows.agg(F.count("*"), F.count("page_id"), F.count_distinct("page_id")).first()
    if n == ids == distinct:
        rows = rows.withColumn("row", F.col("page_id"))
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-pages")
    sized = rows.where(F.octet_length("text") >= least).groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.max(F.struct("page_id", "row")).alias("last"))
    last = sized.select(F.col("last.row").alias("last"))
    rows = rows.join(last.hint("merge"), F.col("row") == F.col("last"), "left").select("row", "page_id", "url", "text", F.isnotnull("last").alias("newest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                names, records = [], []
                for row, page_id, url, text, newest in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    payload = text.encode()
                    name = _name("row", row)
                    same = _name("payload", hashlib.sha256(payload).hexdigest())
                    shared = len(payload) >= least
                    for record in page_records(page_id, url, payload, same if shared and newest else name, same if shared and not newest else None, date, segment, chunk):
                        if size > archive:
                            number, size = number + 1, 0
                        if not size:
                            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(folder, task, number)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                            names.append(f"{task:06d}-{number:04d}")
                            records.append(_record(info, b"format: WARC File Format 1.1\r\n"))
                        size += len(record)
                        names.append(f"{task:06d}-{number:04d}")
                        records.append(record)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.binary())], names=["archive", "record"])

    records = rows.mapInArrow(run, "archive string, record binary")
    records = records.select("archive", F.col("record").cast("string"))
    records.write.partitionBy("archive").option("lineSep", BREAK.decode()).option("compression", "gzip").text(folder)


class _Bytes:
    """Takes bytes from the pieces of a file, plain or of one or more gzip members, keeping what is not yet taken."""

    def __init__(self, content: bytes) -> None:
        self.pieces = self._members(content) if content[:2] == b"\x1f\x8b" else (content[i : i + (1 << 20)] for i in range(0, len(content), 1 << 20))
        self.held, self.at = bytearray(), 0

    @staticmethod
    def _members(content: bytes) -> Iterator[bytes]:
        rest = content
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            feed = rest
            while not member.eof:
                piece = member.decompress(feed, 1 << 20)
                feed = member.unconsumed_tail
                if piece:
                    yield piece
                elif not feed and not member.eof:
                    return  # cut off
            rest = member.unused_data

    def _more(self) -> bool:
        piece = next(self.pieces, b"")
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return bool(piece)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to the mark, which is passed; None if it does not come."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[self.at : found])
        self.at = found + len(mark)
        return out


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields by lower-case name, block, problem) of each record of an archive, one in memory at a time.

    A record that is cut off, or has no readable header, has a problem and ends the archive, as nothing tells where the next begins.
    """
    source = _Bytes(content)
    while True:
        head = source.until(BREAK)
        if head is None:
            if source.held[source.at :].strip(b"\r\n"):
                yield {}, b"", "cut off"
            return
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if lines == [""]:
            continue
        fields: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in " \t" and last:  # a folded line
                fields[last] += " " + line.strip()
            else:
                last, _, value = line.partition(":")
                last = last.strip().lower()
                fields[last] = value.strip()
        size = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdecimal():
            yield fields, b"", "unreadable header"
            return
        block = source.take(int(size))
        if len(block) < int(size):
            yield fields, block, "cut off"
            return
        yield fields, block, None


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, out of its chunks if it is chunked."""
    head, found, body = block.partition(BREAK)
    if not found:
        raise ValueError("no HTTP header")
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    if fields.get(b"transfer-encoding") == b"chunked":
        return unchunked(body)
    if fields.get(b"content-length", b"").isdigit() and int(fields[b"content-length"]) != len(body):
        raise ValueError("HTTP length")
    return body


def _decoded(block: bytes, claimed: str | None, problem: str | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole block."""
    if problem is not None:
        return None, problem
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, str(e)
    if claimed is not None and claimed.removeprefix("sha1:") != digest(payload):
        return None, "payload digest"
    return payload, None


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.removeprefix("-").isdecimal() else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_OUT = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())]
)
_PAYLOAD = pa.schema([("payload", pa.binary())])
_SEGMENT = pa.schema([("claimed", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _joined(payloads: bool) -> Callable[[pa.Table], pa.Table]:
    """Puts the segments of one record together."""
    schema = pa.unify_schemas([_OUT, _PAYLOAD])

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["segment"], r["kind"], r["block"]))
        once = [r for i, r in enumerate(rows) if not i or (r["segment"], r["block"]) != (rows[i - 1]["segment"], rows[i - 1]["block"])]
        first, totals = once[0], {r["total"] for r in once if r["total"] is not None}
        block = b"".join(r["block"] for r in once)
        problem = next((r["problem"] for r in once if r["problem"]), None)
        if problem is None and [r["segment"] for r in once] != list(range(1, len(once) + 1)):
            problem = "segments missing" if len({r["segment"] for r in once}) == len(once) else "segments differ"
        elif problem is None and once[-1]["total"] is None:
            problem = "segments missing"  # the last one alone carries the total
        elif problem is None and totals != {len(block)}:
            problem = "total length"
        payload, problem = _decoded(block, first["claimed"], problem)
        row = (first["origin"], first["kind"], first["page_id"], first["uri"], None, None if payload is None else len(payload), None if payload is None else digest(payload), problem, payload if payloads else None)
        return pa.Table.from_batches([_batch([row], schema)])

    return join


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``record_id``, ``kind`` (response or revisit), ``page_id``, ``uri``, ``refers_id``, ``payload_bytes``, ``payload_digest``, ``payload``, ``problem``.

    One row per response and revisit in the archives below ``folder``, which Spark lists and reads. Archives are parsed in one pass, a
    record in memory at a time. A record without segments is decoded there. The others are written as they are; those of one
    origin identifier are grouped, put in the order of their segment numbers, which must be 1 to n, compared with the total length that
    the last one carries, and decoded: the chunks are taken out of their framing. A segment that occurs twice counts once. No group
    is larger than one record.

    ``problem`` says what is wrong with a record, which then has no payload: it is cut off, misses segments, has different ones under
    one number, another length than its total, broken chunks, or another digest than it claims. A continuation without its
    first record is a row of kind ``continuation``. With ``payloads`` false the column is null, so that only digests are carried on. Revisits have no payload of their own;
    see :func:`resolved`. Other kinds of record are passed over. A folder without archives gives an empty table.
    """
    schema = pa.unify_schemas([_OUT, _PAYLOAD, _SEGMENT])
    kinds = _FIELDS + ", payload binary, claimed string, " + _PIECES

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for fields, block, problem in records(batch.column(0)[i].as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit", "continuation") and problem is None:
                        continue
                    segment, total = _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length"))
                    name, claimed = fields.get("warc-record-id"), fields.get("warc-payload-digest")
                    head = (name, kind, _number(fields.get("page-id")), fields.get("warc-target-uri"), fields.get("warc-refers-to"))
                    if kind == "revisit" or segment is None:
                        payload, problem = (None, problem) if kind == "revisit" else _decoded(block, claimed, problem)
                        known = (None, None) if payload is None else (len(payload), digest(payload))
                        rows.append((*head, *known, problem, payload if payloads else None, None, None, None, None, None))
                    else:
                        rows.append((*head, None, None, problem, None, claimed, fields.get("warc-segment-origin-id", name), segment, total, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    parsed = stored(files.mapInArrow(parse, kinds), "warc-records")
    columns = [f.split()[0] for f in _FIELDS.split(", ")]
    whole = parsed.where("origin is null").select(*columns, "payload")
    pieces = parsed.where("origin is not null").drop("payload", "payload_bytes", "payload_digest", "refers_id")
    again = pieces.groupBy("origin").applyInArrow(_joined(payloads), _FIELDS + ", payload binary")
    return whole.unionByName(again)


def resolved(found: DataFrame) -> DataFrame:
    """:func:`read_archives` with each revisit's ``payload_bytes`` and ``payload_digest`` those of the response it names, and ``refers_to``, that one's page.

    A revisit whose response is not there has the problem ``response missing``. Responses are one row a name, so a name that many
    revisits share is an ordinary skewed join, which adaptive execution splits.
    """
    first = found.where("kind = 'response'").groupBy(F.col("record_id").alias("named"))
    first = stored(first.agg(F.max(F.struct("payload_bytes", "payload_digest", "page_id")).alias("to")), "named-responses")  # a plain scan, so that the join can be split
    back = found.join(first.hint("merge"), F.col("refers_id") == F.col("named"), "left")
    lost = F.when(F.col("refers_id").isNotNull() & F.col("named").isNull(), F.lit("response missing"))
    return back.select(
        "record_id", "kind", "page_id", "uri", F.coalesce("payload_bytes", "to.payload_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "to.payload_digest").alias("payload_digest"),
        F.col("to.page_id").alias("refers_to"), F.coalesce("problem", lost).alias("problem"),
    )
