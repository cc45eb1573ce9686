"""Operator 8: WARC archives through a chunked record table.

Writing. Each page becomes a WARC/1.1 record whose block is an HTTP response.
Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with
the largest id is the response; the others are revisit records without a
payload. A payload longer than ``CHUNK`` bytes is written as segments: a first
record and continuation records, a row each, so neither a row nor a buffer ever
holds more of it than one chunk on the way to the file. Archives roll after
``RECORDS`` records and are written by Spark to the shared folder.

Reading. Archives are inflated and parsed piece by piece. Payloads of whole
records are digested as they pass. Segments become rows of record, chunk number
and bytes; they are dealt by record, sorted by chunk number, and run through one
incremental digest. A record whose bytes don't give the digest in its header is
an error.

Null html is the empty payload; a null id is kept; repeated rows each get a
record, and when the largest id repeats all its rows are responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Shortest payload in bytes that may be replaced by a revisit.
LEAST_REVISIT = 1000
#: Most payload bytes in a record, and most records in an archive.
CHUNK, RECORDS = 256 * 1024, 512
#: The date in the records; the pages have none, and reruns should agree.
DATE = "1970-01-01T00:00:00Z"
#: Groups of equal payloads broadcast at most; more go by a shuffled join.
BROADCAST_GROUPS = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(uri: str | None) -> str:
    """A URI without what would break a header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in uri or "")


def _cut(payload: str, size: int) -> Iterator[str]:
    """Pieces of at most ``size`` UTF-8 bytes that end at a character."""
    step, at = max(size // 4, 1), 0
    while at < len(payload):
        end = min(len(payload), at + step)
        if payload[at:end].isascii():  # one byte each: take as many again
            end = min(len(payload), at + size) if payload[end : at + size].isascii() else end
        yield payload[at:end]
        at = end


def _head(kind: str, record: str, fields: list[tuple[str, str]], length: int) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(length))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, refers_uri: str | None, name: str, chunk: int = CHUNK) -> Iterator[str]:
    """The records of one page, each without the two line ends behind it."""
    html = html or ""
    size, sha = 0, hashlib.sha1()
    for piece in _cut(html, chunk):
        data = piece.encode("utf-8", "surrogatepass")
        size += len(data)
        sha.update(data)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    record = f"urn:pagewright:{name}"
    fields = [
        ("WARC-Target-URI", _clean(url)),
        ("Page-ID", "null" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", _clean(refers_uri)), ("Refers-To-Page-ID", str(refers_to))]
        yield _head("revisit", record, fields, len(http)) + http
    elif size <= chunk:
        yield _head("response", record, fields, len(http) + size) + http + html
    else:
        pieces = _cut(html, chunk)
        number, now = 1, next(pieces)
        for ahead in _with_end(pieces):
            n = len(now.encode("utf-8", "surrogatepass"))
            if number == 1:
                yield _head("response", record, [*fields, ("WARC-Segment-Number", "1")], len(http) + n) + http + now
            else:
                more = [("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", str(number))]
                if ahead is None:
                    more.append(("WARC-Segment-Total-Length", str(len(http) + size)))
                yield _head("continuation", f"{record}:{number}", more, n) + now
            number, now = number + 1, ahead


def _with_end(pieces: Iterator[str]) -> Iterator[str | None]:
    yield from pieces
    yield None


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, most_records: int = RECORDS, least_revisit: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives into ``path``."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("_sha"), F.octet_length(payload).alias("_size"))
    same = told.where(F.col("_size") >= least_revisit).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.max_by(F.coalesce("url", F.lit("")), "page_id").alias("_uri"), F.count("*").alias("_times"))
    same = same.where("_times > 1").drop("_times")
    some = Scratch(pages.sparkSession, "warc-groups")
    same = some.put(same, "groups")
    if same.count() <= BROADCAST_GROUPS:
        same = F.broadcast(same)
    joined = told.join(same, "_sha", "left")
    other = (F.col("_size") >= least_revisit) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    plan = joined.select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"), F.when(other, F.col("_uri")).alias("refers_uri"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                page_id, url, html, to, uri = (batch.column(k)[i].as_py() for k in range(5))
                for r in records(page_id, url, html, to, uri, f"{page_id}:{part}:{n}", chunk):
                    out.append(r)
                    held += len(r)
                    if held >= 4 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = plan.mapInArrow(run, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)
    some.drop("groups")


class Parser:
    """Parses records from pieces of an archive; holds a header or a piece at most.

    ``feed`` yields (header fields, payload bytes, whether the record ends)."""

    def __init__(self):
        self.buffer, self.state, self.left, self.fields = b"", "head", 0, {}

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        self.buffer += data
        while True:
            if self.state in ("head", "http"):
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                text, self.buffer = self.buffer[:end].decode("utf-8"), self.buffer[end + 4 :]
                first, *lines = text.split("\r\n")
                named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                if self.state == "head":
                    if not first.startswith("WARC/"):
                        raise ValueError(f"no WARC record here: {first[:40]!r}")
                    self.fields, self.left = named, int(named["Content-Length"])
                    self.state = "http" if "application/http" in named.get("Content-Type", "") else "block"
                else:
                    self.fields["payload-length"] = named["Content-Length"]
                    self.left -= end + 4
                    self.state = "block"
            elif self.state == "block":
                piece, self.buffer = self.buffer[: self.left], self.buffer[self.left :]
                self.left -= len(piece)
                if not self.left:
                    self.state = "end"
                    yield self.fields, piece, True
                else:
                    if piece:
                        yield self.fields, piece, False
                    return
            else:
                if len(self.buffer) < 4:
                    return
                if self.buffer[:4] != b"\r\n\r\n":
                    raise ValueError("a record doesn't end where its length says")
                self.buffer, self.state = self.buffer[4:], "head"


def _inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    for i in range(0, len(data), step):
        piece = data[i : i + step]
        while piece:
            yield z.decompress(piece, 1 << 20)
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
            else:
                piece = z.unconsumed_tail
    yield z.flush()


_CHUNKS = "record string, chunk long, record_type string, page_id long, refers_to long, payload_bytes long, declared string, payload_digest string, data binary"
_NAMES = [x.split()[0] for x in _CHUNKS.split(", ")]


def _parse(contents: Iterable[bytes]) -> Iterator[tuple]:
    """Chunk rows: whole records with their digest and no data, segments with data."""
    for content in contents:
        parser = Parser()
        sha, size, parts = hashlib.sha1(), 0, []
        for piece in _inflate(content):
            for f, data, ends in parser.feed(piece):
                segment = f.get("WARC-Segment-Number")
                if segment is None:
                    sha.update(data)
                    size += len(data)
                else:
                    parts.append(data)
                if not ends:
                    continue
                page = f.get("Page-ID", "null")
                declared = f.get("WARC-Payload-Digest", "")
                declared = base64.b32decode(declared[5:]).hex() if declared else None
                to = f.get("Refers-To-Page-ID")
                kind = f["WARC-Type"]
                total = int(f["payload-length"]) if "payload-length" in f else None
                record = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])[1:-1]
                if segment is None:
                    got = declared if kind == "revisit" else sha.hexdigest()
                    if got != declared or kind != "revisit" and size != total:
                        raise ValueError(f"{record}: the payload isn't what its header says")
                    digest, body = got, None
                else:
                    digest, body = None, b"".join(parts)
                yield record, int(segment or 0), kind, None if page == "null" else int(page), None if to is None else int(to), total, declared, digest, body
                sha, size, parts = hashlib.sha1(), 0, []


def _rows(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("declared", pa.string()), ("payload_digest", pa.string()), ("data", pa.binary())])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"") + 200
        if size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_chunks(spark, path: str) -> DataFrame:
    """The chunked record table of the archives in ``path``: a row per record,
    and per segment of a segmented one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _rows(_parse(x.as_py() for b in batches for x in b.column(0))), _CHUNKS)


def assemble(chunks: DataFrame) -> DataFrame:
    """Records from the chunk table: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Segments pass one incremental digest in order."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = chunks.where("chunk = 0").select(names)
    parts = chunks.where("chunk > 0").select("record", "chunk", "page_id", "payload_bytes", "declared", "data")
    parts = parts.repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches):
        now, page, total, declared, sha, size = None, None, None, None, None, 0

        def done():
            got = sha.hexdigest()
            if got != declared or size != total:
                raise ValueError(f"{now}: the segments don't give the payload its header says")
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([size], pa.int64()), pa.array([got]), pa.array(["response"]), pa.array([None], pa.int64())], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                record, _, p, t, d, data = (batch.column(k)[i].as_py() for k in range(6))
                if record != now:
                    if now is not None:
                        yield done()
                    now, page, total, declared, sha, size = record, p, t, d, hashlib.sha1(), 0
                sha.update(data)
                size += len(data)
        if now is not None:
            yield done()

    return whole.unionByName(parts.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def round_trip(pages: DataFrame, chunk: int = CHUNK, most_records: int = RECORDS) -> DataFrame:
    """Write the archives, read them back into the chunk table, and assemble it."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path("archives"), chunk, most_records)
    chunks = scratch.put(read_chunks(pages.sparkSession, scratch.path("archives")), "chunks")
    return assemble(chunks)


ORACLE = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_id FROM told)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
