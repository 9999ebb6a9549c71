"""WARC archives in ZIP packages: written, then read by ranges without extraction.

A package holds archive/data.warc.gz, stored as it is, a gzip member a record, and indexes/index.cdx, one line a record
with its place. The reader finds both through the central directory, ZIP64 records included, and reads single records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import arrow_schema, work_dir, written

WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdx"
_DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit, without, of the response of refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    clean = "".join(c for c in url or "" if c > " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


class Package:
    """Collects records; its bytes are a ZIP file whose members are stored."""

    def __init__(self, level: int = 4):
        self.level, self.body, self.index, self.size = level, [], [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), self.level, mtime=0)
        self.index.append(f"{'-' if page_id is None else page_id} {self.size} {len(packed)}\n")
        self.body.append(packed)
        self.size += len(packed)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((WARC_NAME, b"".join(self.body)), (INDEX_NAME, "".join(self.index).encode())):
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
        return out.getvalue()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


class ZipRanges:
    """Members of a ZIP file that is read by ranges: f has read_at(n, offset) and size()."""

    def __init__(self, f):
        self.f, self.end, self.starts = f, f.size(), {}
        self.members = {m.name: m for m in self._directory()}

    def _read(self, offset: int, n: int) -> bytes:
        data = bytes(self.f.read_at(n, offset))
        if len(data) < n:
            raise ValueError("the archive ends early")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.end - 22 - 65535)
        tail = self._read(tail_at, self.end - tail_at)
        at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))  # its fixed part is 22 bytes long
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF in (count,) or 0xFFFFFFFF in (size, start):
            mark, _, where, _ = struct.unpack("<4sIQI", self._read(tail_at + at - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            wide = self._read(where, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, size, start = struct.unpack_from("<QQQ", wide, 32)
        raw, i = self._read(start, size), 0
        for _ in range(count):
            if raw[i : i + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<HH", raw, i + 8)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, i + 20)
            header = struct.unpack_from("<I", raw, i + 42)[0]
            name = raw[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[i + 46 + n_name : i + 46 + n_name + n_extra]
            j = 0
            while j + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, j)
                if tag == 1:  # ZIP64: only the fields that are full above, in this order
                    k = j + 4
                    if full == 0xFFFFFFFF:
                        full, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                    if packed == 0xFFFFFFFF:
                        packed, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, k)[0]
                j += 4 + n
            yield Member(name, method, header, packed, full)
            i += 46 + n_name + n_extra + n_note

    def start(self, m: Member) -> int:
        """Where a member's data begins: its own header may have other extra fields than the directory."""
        if m.name not in self.starts:
            head = self._read(m.header, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("a broken member")
            self.starts[m.name] = m.header + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self.starts[m.name]

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        """A range of a stored member; a deflated one is read whole first."""
        m = self.members[name]
        if m.method == 0:
            n = m.size - offset if n is None else n
            if offset + n > m.size:
                raise ValueError("the range ends outside the member")
            return self._read(self.start(m) + offset, n)
        if m.method != 8:
            raise ValueError(f"compression method {m.method} is not supported")
        whole = zlib.decompress(self._read(self.start(m), m.packed), -15)
        return whole[offset : None if n is None else offset + n]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and the HTTP payload in its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers.setdefault("http-" + name.strip().lower(), value.strip())
    return headers, payload


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = 16 << 20, level: int = 4) -> DataFrame:
    """Write packages of about package_bytes into folder; the rows (path, records) name them.

    Of equal payloads, that of the smallest id becomes the response, the others revisits of it. A task that runs again
    writes other files; only those of the attempt that counted are named.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    named = rows.select("id", "sha1")
    shared = written(named.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first"), "shared-payloads")
    revisits = written(named.join(shared, "sha1").where("NOT id <=> first").select(F.col("id").alias("again"), F.col("sha1").alias("digest"), "first").distinct(), "revisits")
    marked = rows.join(revisits, F.col("id").eqNullSafe(F.col("again")) & (F.col("sha1") == F.col("digest")), "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        package = Package(level)

        def flush() -> pa.RecordBatch:
            nonlocal package
            path = f"{root}/{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(path) as out:
                out.write(package.to_bytes())
            n, package = len(package.index), Package(level)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("id", "url", "payload", "first")), strict=True):
                package.add(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())
                if package.size >= package_bytes:
                    yield flush()
        if package.index:
            yield flush()

    return written(marked.mapInArrow(run, "path string, records long"), "packages")


def read_archives(packages: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Every record of the packages named in `path`, by index and range; a response whose payload fails its digest is an error."""
    schema = RECORD + ", payload binary" * with_payload
    out_schema = arrow_schema(packages.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as source:
                    package = ZipRanges(source)
                    rows: list[tuple] = []
                    for line in package.read(INDEX_NAME).decode().splitlines():
                        _, offset, n = line.split(" ")
                        head, payload = parse_record(gzip.decompress(package.read(WARC_NAME, int(offset), int(n))))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        row = (_page(head["warc-record-id"]), head["warc-target-uri"], int(head["http-content-length"]), digest, head["warc-type"], _page(head.get("warc-refers-to")))
                        rows.append((*row, payload) if with_payload else row)
                        if len(rows) >= 4096 or with_payload and len(rows) >= 64:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    return packages.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False, **options) -> DataFrame:
    """Write all pages to packages in a shared folder and read every record back: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to (and the payload: empty for a revisit).

    A null html is an empty payload, and empty payloads are equal as others are. A null id's record has none and is a
    response. Repeated rows of the smallest id are responses each. An empty table gives an empty one; other columns are
    ignored. Long pages make long records; a package then holds few.
    """
    folder = folder or work_dir(pages.sparkSession, "warc-packages")
    packages = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col, **options)
    return read_archives(packages, folder, with_payload=with_payload)
