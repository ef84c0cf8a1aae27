"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record, written by Spark's text sink. The sink puts a separator behind
each row; the separator is an empty gzip member, so that a file stays a valid gzip stream. Files are
committed as any Spark output is, on any file system that Spark can write.

Reader: Spark's text source splits files into byte ranges and cuts them at the gzip magic; a task owns
what starts inside its range. The magic also occurs inside compressed data, so that each piece is only
a candidate: it is a member if it and the pieces behind it inflate to a whole WARC record, and stays
open until that is known, even where the magic occurs before the first byte comes out. If the end is
in another range, the few loose ends are shuffled by file and joined there. Archives need a name
without ``.gz``, which Spark would unpack as one stream.

Defined results: a null payload is an empty payload; rows that repeat the smallest id are each a
response; a null id is written as empty and read as null; truncated or foreign members are dropped
by the reader, as they aren't records, and so are responses whose payload hasn't their digest; an empty table gives an archive without records; extra
columns are ignored; a payload is one record, inflated as a whole by one task, however long.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.common import staged

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing (RFC 1952), the separator between records.
EMPTY_MEMBER = MAGIC + bytes(6) + b"\x03" + b"\x03" + bytes(9)
#: What a record starts with.
START = b"WARC/1."
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("loose", pa.binary())])
RECORD_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, block long, seq long, loose binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id, url, payload: bytes, refers_to, level: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    lines += [f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple | None:
    head, sep, body = data.partition(b"\r\n\r\n")
    if not data.startswith(START) or not sep:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    try:
        body = body[: int(fields[b"content-length"])]
        of = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None
        kind = fields[b"warc-type"]
        digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(body)
        if kind == "response" and digest != base32_sha1(body):
            return None
        return (of(b"warc-record-id"), fields.get(b"warc-target-uri"), kind, of(b"warc-refers-to"), int(fields.get(b"warc-payload-length", len(body))), digest, body)
    except (KeyError, ValueError):
        return None


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, level: int = 6) -> None:
    """``pages``: page_id, url, html. Of equal payloads of ``min_payload`` bytes or more, all but the smallest page_id's become revisits.

    A row without an id is a revisit where one with an id has the same payload, and else a response.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("*", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("size"))
    firsts = keyed.filter(F.col("size") >= min_payload).groupBy("key", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    linked = keyed.join(firsts, ["key", "size"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [build_record(*x, level) for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = linked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class _Members:
    """Finds the members in pieces that follow each other, each without the magic before it.

    A piece is an open candidate as long as it and what follows inflate without an error and what came
    out is a prefix of a WARC record: the magic may occur before a member gives its first byte. If
    that fails, only the first piece is given up and those behind it are tried anew.
    """

    def __init__(self) -> None:
        self.open: list[bytes] = []
        self.z, self.out = None, bytearray()

    def add(self, *pieces: bytes) -> Iterator[tuple[bytes | None, bytes | None]]:
        """(piece, None) for each that starts no member, (None, content) for each whole member."""
        todo = deque(pieces)
        while todo:
            if not self.open:
                self.z, self.out = zlib.decompressobj(31), bytearray()
            self.open.append(todo.popleft())
            try:
                self.out += self.z.decompress(MAGIC + self.open[-1])
                good = self.out.startswith(START) or START.startswith(self.out)
            except zlib.error:
                good = False
            if not good:
                first, *rest = self.open
                todo.extendleft(reversed(rest))
                self.open = []
                yield first, None
            elif self.z.eof:
                self.open = []
                yield None, bytes(self.out)

    def end(self) -> Iterator[tuple[bytes | None, bytes | None]]:
        """The same where nothing follows: what is open is cut off."""
        while self.open:
            first, *rest = self.open
            self.open = []
            yield first, None
            yield from self.add(*rest)


def _decode(with_payload: bool):
    none7, none4 = (None,) * 7, (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        head, seq = True, 0
        members = _Members()
        rows: list[tuple] = []

        def loose(pieces: list[bytes]) -> None:
            nonlocal seq
            for p in pieces:
                rows.append((*none7, at[0], at[1], seq, p))
                seq += 1

        for batch in batches:
            for file, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != at:
                    loose(members.open)
                    at, head, seq, members = (file, block), block > 0, 0, _Members()
                    if not block:
                        continue  # what is before the first magic
                for other, content in members.add(piece):
                    if other is None:
                        head = False
                        found = parse_record(content)
                        if found:
                            rows.append((*(found if with_payload else (*found[:6], None)), *none4))
                    elif head:  # may go on a member of the range before
                        loose([other])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(RECORD, zip(*rows, strict=True), strict=True)], schema=RECORD)
                rows = []
        loose(members.open)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(RECORD, zip(*rows, strict=True), strict=True)], schema=RECORD)

    return run


def _join_loose(with_payload: bool):
    """Over the loose ends sorted by file, block and place: joins each member's start to what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, members, rows = None, _Members(), []

        def records(events: Iterator[tuple[bytes | None, bytes | None]]) -> None:
            for _, content in events:
                if content is not None and (found := parse_record(content)):
                    rows.append((*(found if with_payload else (*found[:6], None)), *(None,) * 4))

        for batch in batches:
            for f, piece in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if f != file:
                    records(members.end())
                    file = f
                records(members.add(piece))
        records(members.end())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for t, c in zip(RECORD, zip(*rows, strict=True), strict=True)], schema=RECORD)

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Decodes the archives under ``path`` and stages their records: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, payload."""
    text = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("piece"))
    decoded = staged(pieces.mapInArrow(_decode(payload), RECORD_DDL), "records")  # so that archives are inflated once
    whole = decoded.filter("loose is null")
    ends = decoded.filter("loose is not null").select("file", "block", "seq", "loose")
    stitched = ends.repartition("file").sortWithinPartitions("file", "block", "seq").select("file", "loose").mapInArrow(_join_loose(payload), RECORD_DDL)
    out = whole.union(stitched).drop("file", "block", "seq", "loose")
    return out if payload else out.drop("payload")
