"""WARC records in ZIP packages, written and read by range.

Each package holds two stored members: ``archive/data.warc.gz``, one gzip
member for each record, and ``indexes/index.cdx``, a line for each record with
its place in the archive.  The reader looks at the end of a package for its
directory (ZIP64 where it says so), finds the stored members, reads the index
and then each record's own range; nothing is extracted.

Packages lie in the cluster's shared folder and are read and written through
pyarrow's file systems, so that folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint_dir, cut, table, text_of

LEAST_REVISIT = 0  # payloads of at least so many bytes are written once and then revisited
PACKAGE_BYTES = 64 << 20
READ_TASKS = 20_000  # at most so many tasks read packages
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
KEPT_IN_KEYS = ":/?#[]@!$&'()*+,;=%~"
DATE = "2024-01-01T00:00:00Z"

# fixed values: signatures and sizes of the ZIP format
END_SIG, END_SIZE, LOCATOR_SIG, END64_SIG, ENTRY_SIG, LOCAL_SIG = b"PK\x05\x06", 22, b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # where its local header begins


def _at(file: BinaryIO, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("the package ends too early")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """The members that a package's central directory lists."""
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(END_SIG)
    while end >= 0 and end + END_SIZE + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END_SIG, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR_SIG:
        end64 = _at(file, struct.unpack_from("<Q", tail, end - 12)[0], 56)
        if end64[:4] != END64_SIG:
            raise ValueError("the ZIP64 end record isn't where its locator says")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    listing, found, at = _at(file, start, length), [], 0
    for _ in range(count):
        if listing[at : at + 4] != ENTRY_SIG:
            raise ValueError("the central directory is broken")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", listing, at + 20)
        header = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, e = listing[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values, each only where the 32-bit field is full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            e += 4 + n
        found.append(Member(name, method, full, packed, header))
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file: BinaryIO, member: Member) -> int:
    local = _at(file, member.header, 30)
    if local[:4] != LOCAL_SIG or member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} isn't a stored member")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP head, which tells the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))]) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http_head, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:]), payload


class Package:
    """A ZIP package being written: records first, then the index."""

    def __init__(self, sink: BinaryIO, zip64: bool = True):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.at, self.lines = 0, []

    def add(self, key: str, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.member.write(packed)
        self.lines.append(f"{quote(key, safe=KEPT_IN_KEYS)} {self.at} {len(packed)}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()


def read_package(file: BinaryIO, size: int) -> Iterator[bytes]:
    """Every record that a package's index names, each by its own range."""
    members = {m.name: m for m in directory(file, size)}
    at, index = data_start(file, members[DATA]), _at(file, data_start(file, members[INDEX]), members[INDEX].size)
    for line in index.decode().splitlines():
        _, offset, length = line.rsplit(" ", 2)
        yield zlib.decompress(_at(file, at + int(offset), int(length)), 31)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_packages(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, most_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write each row of ``pages(page_id, url, html)`` as a record; ``(path, records)`` of each package written.

    Of equal payloads of at least ``least`` bytes that with the smallest page_id
    is a response and the others revisit it.  Only digests that repeat are
    joined to their smallest page_id, by broadcast if there are few; else Spark
    may split the rows of a payload that many pages share.  A null html is
    empty; a page without a page_id is a response; of rows that repeat, one is
    the response: those rows alone are dealt out by payload and page.
    A task that runs again writes packages of new names, and the list that is
    kept names those of one run only.
    """
    rows = pages.select("page_id", "url", text_of("html").cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("_n", F.octet_length("payload").cast("long"))
    named = rows.where("page_id is not null").where(F.col("_n") >= least).groupBy("sha1", "_n", "page_id").agg(F.count("*").alias("rows"))
    firsts = named.groupBy("sha1", "_n").agg(F.min("page_id").alias("first"), F.min_by("rows", "page_id").alias("same"), F.sum("rows").alias("all"))
    firsts = cut(firsts.where(F.col("all") > 1).drop("all"))
    ready = rows.join(broadcast_if_small(firsts, 64), ["sha1", "_n"], "left").select("page_id", "url", "payload", "sha1", "first", "same")
    if not firsts.where("same > 1").isEmpty():
        again = F.coalesce((F.col("same") > 1) & (F.col("page_id") == F.col("first")), F.lit(False))
        ready = ready.where(~again).unionByName(ready.where(again).repartition("sha1", "page_id"))
    ready = ready.drop("same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        sink = package = path = None
        given: set[int] = set()  # first pages of this task that are written: a repeated row of one revisits it
        for batch in batches:
            for page_id, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    path = f"{root}/{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(path)
                    package = Package(sink)
                refers_to = None if page_id is None or first is None or (first == page_id and page_id not in given) else first
                if first is not None and first == page_id:
                    given.add(page_id)
                package.add(url or "-", record_bytes(page_id, url, payload, digest32(sha1), refers_to))
                if package.at >= most_bytes:
                    package.close()
                    sink.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(package.lines)]})
                    package = None
        if package is not None:
            package.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(package.lines)]})

    return ready.mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record in the packages.

    A response's digest is computed from its payload and must be the one that
    its header states; a revisit has both figures from its headers.
    """

    def number(field: str | None) -> int | None:
        return int(field[10:-1]) if field and field[10:-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_file(path) as file:
                    for record in read_package(file, file.size()):
                        warc, http, payload = parse_record(record)
                        stated = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if warc["WARC-Type"] == "response" and digest32(hashlib.sha1(payload).digest()) != stated:
                            raise ValueError(f"a record in {path} has another payload than its digest says")
                        rows.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), stated, warc["WARC-Type"], number(warc.get("WARC-Refers-To"))))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    paths = packages.select("path")
    return paths.repartition(max(1, min(paths.count(), READ_TASKS))).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as packages into a new folder in the shared one, read them back, and remove them."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, root = _file_system(folder)
    store.create_dir(root, recursive=True)
    try:
        return cut(read_packages(cut(write_packages(pages, folder)), folder))
    finally:
        store.delete_dir(root)


def op8_warc_zip_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ZIP packages and back; a row for each row of ``pages``, as ``write_packages`` and ``read_packages`` say."""
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
