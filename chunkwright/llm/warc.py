"""Web archives inside ZIP packages: written once, then read by ranges.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member for each WARC record) and ``indexes/index.cdx`` (a line for each record).
The reader never unpacks: it finds the end record, the ZIP64 end record if there
is one, and the central directory, resolves a stored member to a byte range of
the package, reads the index, and then fetches records by offset and length,
neighbouring ones with one request.

Packages lie in a folder of the shared file system.  A task names its packages
freshly and reports them when they are complete, so what a lost executor left
half-written is never read.

Defined cases: a null payload is empty; a null url has no target line; a null
page_id is kept as null; equal rows each get a record; among equal payloads of at
least ``revisit_bytes`` those with the largest page_id are responses and the
others revisit it; a payload of any length is one record, held whole by the task that
writes or reads it; an empty table gives no archive and no rows.  Only page_id, url
and html are read, whatever other columns there are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.runtime import fresh_path, ship, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed when its records reach so many bytes.
PACKAGE_BYTES = 512 << 20
#: Records that begin in the same stretch of so many bytes are fetched with one request.
REQUEST_BYTES = 1 << 20
#: Packed bytes that a task reads, at most and at least; between them there is one task for each shuffle partition.
READ_BYTES = 64 << 20, 1 << 20
#: Shorter payloads are never revisits.
REVISIT_BYTES = 1000

# Signatures of the ZIP format
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class ArchiveError(ValueError):
    """The package or a record in it isn't what its directories say."""


# records


def _line(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "None" else int(number)


@dataclass
class Record:
    page_id: int | None
    kind: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None  # a revisit has none


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    if not first.startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    block = rest[: int(fields["content-length"])]
    http_head, _, body = block.partition(b"\r\n\r\n")
    size = int(_fields(http_head)[1]["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "revisit":
        return Record(_page(fields["warc-record-id"]), "revisit", size, digest, _page(fields["warc-refers-to"]), None)
    if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
        raise ArchiveError("a payload differs from its digest")
    return Record(_page(fields["warc-record-id"]), fields["warc-type"], size, digest, None, body)


# packages


class PackageWriter:
    """Streams records into the data member; the index follows at the end."""

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.stream = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id: int | None, kind: str, record: bytes) -> None:
        packed = gzip.compress(record, compresslevel=1, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{page_id} {self.size} {len(packed)} {kind}\n")
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.stream.close()


def locate(source: pa.NativeFile, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Name -> (local header's offset, stored size, method, flags), from the central directory alone."""

    def read(at: int, n: int) -> bytes:
        if at < 0 or len(data := source.read_at(n, at)) != n:
            raise ArchiveError("the package ends too early")
        return data

    tail = read(max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(EOCD)
    while at >= 0 and (len(tail) - at < 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ArchiveError("no end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    place = size - len(tail) + at
    if place >= 20 and (locator := read(place - 20, 20))[:4] == LOCATOR64:
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != EOCD64:
            raise ArchiveError("no ZIP64 end record where the locator says")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ArchiveError("a central directory entry is missing")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # only the fields that overflowed are there, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[i + 4 : i + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            i += 4 + n
        found[name] = (offset, packed, method, flags)
        at += 46 + n_name + n_extra + n_note
    return found


def stored_range(source: pa.NativeFile, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the package."""
    offset, packed, method, flags = entry
    if method != 0 or flags & 1:
        raise ArchiveError("a member is compressed or encrypted; only stored ones can be read by ranges")
    head = source.read_at(30, offset)
    if head[:4] != LOCAL:
        raise ArchiveError("no local header where the directory says")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, packed


# Spark


def classify(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only digests that come more than once matter; this table is small where copies are few,
    # and then Spark broadcasts it by its measured size instead of moving payloads.
    copies = stage(
        full.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest"),
        "warc-copies",
    )
    refers = F.when(F.col("page_id") == F.col("newest"), F.lit(None)).otherwise(F.col("newest"))
    return full.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(spark: SparkSession, records: DataFrame, folder: str) -> DataFrame:
    """Write packages into ``folder``; per package: path, n_records, bytes."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        writer, path, done = None, "", []

        def close() -> None:
            writer.close()
            done.append((path, len(writer.lines), writer.size))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                if writer is None:
                    filesystem.create_dir(base, recursive=True)
                    path = f"{uuid.uuid4().hex}.zip"
                    writer = PackageWriter(filesystem, f"{base}/{path}")
                page, to = page_id.as_py(), refers_to.as_py()
                writer.add(page, "response" if to is None else "revisit", warc_record(page, url.as_py(), payload.as_py(), digest.as_py(), to, to is not None))
                if writer.size >= PACKAGE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "n_records", "bytes"])

    columns = records.select("page_id", "url", "payload", "digest", "refers_to")
    return stage(columns.mapInArrow(run, "path string, n_records bigint, bytes bigint"), "warc-manifest")


def read_index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per record, from the packages' own directories and indexes: path, start (in the package), length."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_file(f"{base}/{path}") as source:
                    entries = locate(source, source.size())
                    data, _ = stored_range(source, entries[DATA])
                    at, n = stored_range(source, entries[INDEX])
                    lines = [line.split() for line in source.read_at(n, at).decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines), pa.string()), pa.array([data + int(x[1]) for x in lines], pa.int64()), pa.array([int(x[2]) for x in lines], pa.int64())], names=["path", "start", "length"]
                )

    return manifest.select("path").mapInArrow(run, "path string, start bigint, length bigint")


def read_records(spark: SparkSession, index: DataFrame, folder: str, with_payload: bool = False, total_bytes: int | None = None) -> DataFrame:
    """Fetch records by range: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, if wanted).

    ``total_bytes``: of all records in the index, if known; else the index is summed.  Index rows are small, so the number of
    tasks follows the bytes that they fetch.
    """
    ship(spark)
    if total_bytes is None:
        total_bytes = index.agg(F.sum("length")).first()[0] or 0
    most, least = READ_BYTES
    tasks = max(1, -(-total_bytes // most), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes // least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        source, opened = None, None

        def table(records: list[Record]) -> pa.RecordBatch:
            columns = [
                pa.array([r.page_id for r in records], pa.int64()),
                pa.array([r.payload_bytes for r in records], pa.int64()),
                pa.array([r.payload_digest for r in records], pa.string()),
                pa.array([r.kind for r in records], pa.string()),
                pa.array([r.refers_to for r in records], pa.int64()),
            ]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            if with_payload:
                columns.append(pa.array([r.payload for r in records], pa.binary()))
                names.append("payload")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            paths, starts, lengths = (c.to_pylist() for c in batch.columns)
            i, records = 0, []
            while i < len(paths):
                j, end = i, starts[i]
                while j < len(paths) and paths[j] == paths[i] and starts[j] == end and end - starts[i] < REQUEST_BYTES:
                    end += lengths[j]
                    j += 1
                if opened != paths[i]:
                    source, opened = filesystem.open_input_file(f"{base}/{paths[i]}"), paths[i]
                data = source.read_at(end - starts[i], starts[i])
                for k in range(i, j):
                    low = starts[k] - starts[i]
                    records.append(parse_record(gzip.decompress(data[low : low + lengths[k]])))
                i = j
                if with_payload or len(records) >= 4096:
                    yield table(records)
                    records = []
            if records:
                yield table(records)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    near = index.withColumn("stretch", F.expr(f"start div {REQUEST_BYTES}")).repartition(tasks, "path", "stretch").sortWithinPartitions("path", "start")
    return near.select("path", "start", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(spark, classify(pages), folder)
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return read_records(spark, read_index(spark, manifest, folder), folder, with_payload, total)
