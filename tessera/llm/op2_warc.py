"""WARC archives: records written in segments with chunked transfer framing, read back and reassembled.

Writing: one record a page; its HTTP block is framed in chunks and cut into a first record and continuation records of
SEGMENT_BYTES at most. Reading: continuation records are grouped by their origin identifier, ordered by segment
number, their total length is verified, and the chunked framing is decoded as the segments stream by, so a task holds
one segment at a time. Archives are gzip files of bounded size in the shared folder.

Equal payloads (by SHA-1 and length) of ``least_revisit`` bytes or more become one response and revisits that refer to
it. Defined results: a null payload is an empty one; rows that repeat the smallest id of a payload are all responses;
a group without any non-null id is all responses; a null id is never referred to, and reads back as null; a null url
leaves out the target URI; an empty table gives an archive without records and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import fresh_path, written

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 14
RECORDS_PER_FILE = 4096
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD_FIELDS = (
    "record_id string, record_type string, page_id long, origin_id string, segment int, total long, digest string, "
    "block binary, payload_bytes long, payload_digest string"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


class ChunkDecoder:
    """Takes an HTTP response block piece by piece; yields the payload with its chunked framing removed."""

    def __init__(self):
        self.held, self.state, self.left, self.framed = b"", "head", 0, False

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.state == "head":
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                self.framed = b"transfer-encoding: chunked" in self.held[:at].lower()
                self.held, self.state = self.held[at + 4 :], "size" if self.framed else "plain"
            elif self.state == "plain":
                out, self.held = self.held, b""
                if out:
                    yield out
                return
            elif self.state == "size":
                at = self.held.find(CRLF)
                if at < 0:
                    return
                self.left = int(self.held[:at].split(b";")[0], 16)
                self.held, self.state = self.held[at + 2 :], "data" if self.left else "trailer"
            elif self.state == "data":
                out, self.held = self.held[: self.left], self.held[self.left :]
                self.left -= len(out)
                if out:
                    yield out
                if self.left:
                    return
                self.state = "end"
            elif self.state == "end":
                if len(self.held) < 2:
                    return
                if self.held[:2] != CRLF:
                    raise ValueError("a chunk doesn't end in CRLF")
                self.held, self.state = self.held[2:], "size"
            else:  # trailer fields, up to an empty line
                at = self.held.find(CRLF)
                if at < 0:
                    return
                line, self.held = self.held[:at], self.held[at + 2 :]
                if not line:
                    self.state = "over"
                    return

    def finish(self) -> None:
        if self.state not in ("over", "plain"):
            raise ValueError(f"the block breaks off in its {self.state}")


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def page_records(page_id, url, payload: bytes, copy: int, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page, without the two line ends after each."""
    own = record_uri(page_id, copy)
    digest = "sha1:" + base32_sha1(hashlib.sha1(payload).digest())
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    about = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("X-Page-Id", page_id)]
    if revisit:
        block = HTTP_HEAD + CRLF
        about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for i, piece in enumerate(pieces, 1):
        fields = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", own if i == 1 else record_uri(page_id, copy)[:-1] + f":{i}>")]
        fields += about if i == 1 else about[:2]
        if len(pieces) > 1:
            fields += [("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", own if i > 1 else None), ("WARC-Segment-Total-Length", len(block) if i == len(pieces) else None)]
        fields += [("Content-Type", "application/http; msgtype=response" if i == 1 else None), ("Content-Length", len(piece))]
        yield _head(fields) + piece


def write_archives(pages: DataFrame, path: str, least_revisit: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC archives under ``path``."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = own.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = first.where("n > 1 AND first_id IS NOT NULL").drop("n")
    # Copy numbers keep the identifiers of repeated rows apart; once written, the archive fixes them.
    decided = own.join(shared, "sha", "left").withColumn("copy", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, first_id, copy in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "copy")), strict=True):
                revisit = first_id is not None and page_id != first_id
                for record in page_records(page_id, url, html.encode(), copy, revisit, segment):
                    out.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = decided.select("page_id", "url", "html", "first_id", "copy").mapInArrow(run, "record binary")
    # The text writer puts bytes out as they are; its line end is what closes a WARC record.
    writer = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
    writer.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Inflated:
    """Reads a gzip file's bytes in bounded steps."""

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.held = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while self.at < len(self.data) or self.z.unused_data:
            if self.z.eof:
                rest, self.z = self.z.unused_data, zlib.decompressobj(31)
                self.held += self.z.decompress(rest) if rest else b""
                if rest:
                    return True
            step = self.data[self.at : self.at + (1 << 18)]
            self.at += len(step)
            self.held += self.z.decompress(step)
            if self.held:
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        seen = 0
        while (at := self.held.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("the archive breaks off in a record's head")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive breaks off in a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record of a gzip WARC file."""
    source = _Inflated(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != CRLF * 2:
            raise ValueError("a record doesn't end in two line ends")
        yield fields, block


def _payload_of(pieces: Iterator[bytes], keep: bool) -> tuple[int, str, bytes | None]:
    decoder, digest, size, kept = ChunkDecoder(), hashlib.sha1(), 0, []
    for piece in pieces:
        for part in decoder.feed(piece):
            digest.update(part)
            size += len(part)
            if keep:
                kept.append(part)
    decoder.finish()
    return size, base32_sha1(digest.digest()), b"".join(kept) if keep else None


_NAMES = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_TYPES = [_KINDS[f.split()[1]] for f in RECORD_FIELDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], _NAMES)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per response or revisit under ``path``: RECORD_FIELDS; ``block`` is the payload if ``payloads``, else null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parse_archive(content.as_py()):
                    page = int(f["x-page-id"]) if "x-page-id" in f else None
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    done = (None, None, None)
                    if number is None and f["warc-type"] == "response":
                        done = _payload_of(iter([block]), payloads)
                    kept = block if number is not None else done[2]
                    rows.append((f["warc-record-id"], f["warc-type"], page, origin, number, total, digest, kept, done[0], done[1]))
                    size += len(kept or b"") + 500
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by origin and segment; those of one origin are adjacent."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

        source, ahead, out = rows(), [], []

        def blocks(head: tuple) -> Iterator[bytes]:
            expected, total, seen = 1, None, 0
            row = head
            while row is not None and row[3] == head[3]:
                if row[4] != expected:
                    raise ValueError(f"segment {expected} of {head[3]} is missing or doubled")
                expected, total, seen = expected + 1, row[5] if row[5] is not None else total, seen + len(row[7])
                yield row[7]
                row = next(source, None)
            if row is not None:
                ahead.append(row)
            if total != seen:
                raise ValueError(f"{head[3]} has {seen} bytes; its total length is {total}")

        while (row := ahead.pop() if ahead else next(source, None)) is not None:
            if row[4] is not None:
                size, digest, kept = _payload_of(blocks(row), payloads)
                row = (*row[:7], kept, size, digest)
            if row[6] is not None and row[9] is not None and row[6] != row[9]:
                raise ValueError(f"{row[0]}: the payload's digest differs from the record's field")
            out.append(row)
            if len(out) >= (16 if payloads else 4096):
                yield _batch(out)
                out = []
        yield _batch(out)

    parsed = files.mapInArrow(parse, RECORD_FIELDS)
    by_origin = parsed.repartition("origin_id").sortWithinPartitions("origin_id", "segment")
    return by_origin.mapInArrow(reassemble, RECORD_FIELDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``: for revisits, the smallest page among the responses whose payload, as read back,
    has the revisit's digest. Size and digest of a revisit are that response's."""
    responses = records.where("record_type = 'response'")
    targets = responses.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    found = revisits.join(targets, "digest", "left").withColumn("payload_digest", F.when(F.col("refers_to").isNotNull(), F.col("digest")))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = written(read_archives(spark, path).drop("block"), "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
