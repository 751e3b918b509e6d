"""WARC archives: one gzip member per record, written and read back in sequence.

Writing: rows are dealt out by page id. Of pages with equal payloads the one with
the largest id is a ``response`` record and the others are ``revisit`` records
that refer to it; which that is follows from digests alone, so payloads are
shuffled once and never grouped. Each task streams its records into an archive,
one gzip member each, and starts a new archive at ``ARCHIVE_BYTES``.

Reading: one task per archive, front to back. A member is decompressed
incrementally, its header is read up to the empty line, its block is framed by
``Content-Length``, and the block's and (for responses) the payload's SHA-1
digests are verified. Memory is bounded by a record, not by an archive.

Revisit records keep the HTTP header of the original answer, whose
``Content-Length`` is the payload's size.

Edge cases: a null payload is an empty one, and empty payloads are payloads like
others; rows with a null id get the record id ``null`` and never are the page
that others refer to, unless all pages of that payload have none; a page id that
stands several times with the same payload is a response once, and its other rows
revisit it; other columns but the URL are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm import store
from pairbench.llm.common import dealt, stage, text_of
from pairbench.session import shared_dir

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
WARC_DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str | None) -> str:
    """A value that fits on a header line."""
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in value or "")


def record(page: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """A record as a gzip member; ``refers_to`` is given for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    name = lambda p: f"<{PAGE}{'null' if p is None else p}>"
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": name(page),
        "WARC-Date": WARC_DATE,
        "WARC-Target-URI": _line(url),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
    }
    if refers_to:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to[0])}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class Reader:
    """Records of an archive, in sequence, from a source with ``read(size)``."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk = source, chunk
        self.raw, self.plain, self.member = b"", bytearray(), None

    def _more(self) -> bool:
        """Decompress another piece of the present member; False at its end."""
        if self.member.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(self.chunk)
            if not self.raw:
                raise ValueError("the archive ends within a record")
        self.plain += self.member.decompress(self.raw)
        self.raw = self.member.unused_data if self.member.eof else b""
        return True

    def _take(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self._more():
                raise ValueError("a record is shorter than it says")
        found = bytes(self.plain[:size])
        del self.plain[:size]
        return found

    def _until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self._more():
                raise ValueError("a header does not end")
        return self._take(at + len(mark))

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            self.raw = self.raw or self.source.read(self.chunk)
            if not self.raw:
                return
            self.member = zlib.decompressobj(31)
            head = self._until(b"\r\n\r\n").decode().split("\r\n")
            if head[0] != VERSION:
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in head[1:] if line)
            block = self._take(int(fields["Content-Length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where it says")
            while self._more():
                pass
            if self.plain:
                raise ValueError("a member holds more than its record")
            if fields["WARC-Block-Digest"] != "sha1:" + digest(block):
                raise ValueError("a block's digest is wrong")
            yield fields, block


def page_of(name: str) -> int | None:
    value = name.removeprefix(f"<{PAGE}").removesuffix(">")
    return None if value == "null" else int(value)


def described(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; checks payloads."""
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, stated = int(lines["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != stated):
        raise ValueError("a payload differs from its size or digest")
    refers = page_of(fields["WARC-Refers-To"]) if revisit else None
    return page_of(fields["WARC-Record-ID"]), size, stated, fields["WARC-Type"], refers


def _writer(folder: str, limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, size, count = [], None, None, 0, 0
        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "key", "target"))):
                page, url, payload, key, target = row
                # The rows of a page come together; the first of the chosen page is the response.
                first = page == target and (page, key) != last
                last = (page, key)
                if out is None:
                    path = store.new_file(folder, ".warc.gz")
                    system, place = store.located(path)
                    out, size, count = system.open_output_stream(place, compression=None), 0, 0
                data = record(page, url, payload, None if first else (target,))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= limit:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        names = ["path", "records", "bytes"]
        columns = list(zip(*done)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names
        )

    return rows


def write(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives; returns their manifest, (path, records, bytes)."""
    folder = store.make_folder(shared_dir(pages.sparkSession) + "-warc")
    data = text_of(payload).cast("binary")
    rows = pages.select(
        F.col(id).alias("page"), F.col(url).cast("string").alias("url"), data.alias("payload"), F.sha2(data, 256).alias("key")
    )
    # Digests only: payload bytes are not grouped.
    targets = stage(
        rows.groupBy("key").agg(F.max("page").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "target")
    )
    joined = rows.join(targets, "key", "left").withColumn("target", F.coalesce("target", "page"))
    dealt = joined.repartition("page").sortWithinPartitions("page", "key", "url")
    manifest = dealt.select("page", "url", "payload", "key", "target").mapInArrow(
        _writer(folder, limit), "path string, records long, bytes long"
    )
    return stage(manifest)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, place = store.located(path)
            found = []
            with system.open_input_stream(place, compression=None) as source:
                for fields, block in Reader(source):
                    found.append(described(fields, block))
                    if len(found) == 4096:
                        yield batch_of(found)
                        found = []
            if found:
                yield batch_of(found)


def read(manifest: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), one per record of the archives."""
    return dealt(manifest.select("path"), "path").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
