"""Operator 4: WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``
with one gzip member for each record, and ``indexes/index.cdxj`` with each record's
place. The reader takes the ZIP's central directory (ZIP64 where fields overflow)
from the end of the file, finds the members' data, reads the index, and then only
ranges of records; nothing is extracted.

Archives are opened through pyarrow's file systems (local, HDFS, S3, ...), so the
folder can be any that all executors reach. A write task names its files by its
attempt and reports them when closed; a lost attempt's files are in no report.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from uuid import UUID

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelflight.llm.common import column
from shelflight.sources.sinks import freeze

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Records of one archive; its index is kept until the archive is closed.
ARCHIVE_RECORDS = 100_000
# Bytes of records that one range read takes, about.
RANGE_BYTES = 4 << 20
LEVEL = 1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])
RANGES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


# ---- ZIP ------------------------------------------------------------------

# Signatures and sizes of the ZIP format (fixed values).
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
)
_END_SIZE, _LOCATOR_SIZE, _CENTRAL_SIZE, _LOCAL_SIZE, _COMMENT = 22, 20, 46, 30, 65_535
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def stored_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset, length) of the stored members' data in a ZIP file of ``size``
    bytes; ``read(offset, length)`` reads a range. A compressed member is left out."""
    tail_at = max(0, size - _END_SIZE - _COMMENT - _LOCATOR_SIZE)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (
        len(tail) - end < _END_SIZE
        or end + _END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)
    ):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if (count, length, offset) != (0, 0, 0) and (count == _FULL16 or _FULL32 in (length, offset)):
        at = end - _LOCATOR_SIZE
        if at < 0 or tail[at:at + 4] != _LOCATOR:
            raise ValueError("ZIP64 locator is missing")
        record = read(struct.unpack_from("<Q", tail, at + 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("ZIP64 end of central directory is missing")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = read(offset, length), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        start = struct.unpack_from("<I", directory, at + 42)[0]
        name_at = at + _CENTRAL_SIZE
        name = directory[name_at:name_at + n_name].decode("utf-8", "replace")
        extra = directory[name_at + n_name:name_at + n_name + n_extra]
        _, packed, start = _wide(extra, plain, packed, start)
        if method == 0:
            head = read(start, _LOCAL_SIZE)
            if head[:4] != _LOCAL:
                raise ValueError(f"damaged local header of {name}")
            local_name, local_extra = struct.unpack_from("<HH", head, 26)
            found[name] = (start + _LOCAL_SIZE + local_name + local_extra, packed)
        at = name_at + n_name + n_extra + n_comment
    return found


def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
    """Values with those that overflowed taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return tuple(next(wide) if v == _FULL32 else v for v in values)
        at += 4 + size
    return values


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` is the same as ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class Archive:
    """An archive that is being written."""

    def __init__(self, path: str):
        self.path, self.index, self.at = path, [], 0
        system, inner = _place(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, record: bytes, page_id: int | None) -> None:
        packer = zlib.compressobj(LEVEL, wbits=31)
        member = packer.compress(record) + packer.flush()
        self.data.write(member)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(member)}))
        self.at += len(member)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({
            "profile": "data-package", "wacz_version": "1.1.1",
            "resources": [{"name": n.rsplit("/", 1)[1], "path": n} for n in (DATA, INDEX)],
        }))
        self.zip.close()
        size = self.file.tell()
        self.file.close()
        return self.path, size


# ---- WARC -----------------------------------------------------------------


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.md5(str(page_id).encode()).digest())}>"


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None
) -> bytes:
    """A response record, or a revisit record that names the response and holds no
    payload. Line breaks in a URL become spaces."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    parts = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in parts if k}


def parse_record(record: bytes) -> list:
    """The values of RECORDS. A response's size and digest are taken from its payload
    and must agree with its headers; a revisit's are in its headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    if warc["warc-type"] == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError(f"damaged record {warc['warc-record-id']}")
    else:
        payload = None
    page, refers = warc.get("page-id"), warc.get("refers-to-page-id")
    return [
        None if page is None else int(page), warc.get("warc-target-uri"), warc["warc-type"], size, digest,
        None if refers is None else int(refers), payload,
    ]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- Spark ----------------------------------------------------------------


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write a record for each row into archives in ``folder``; returns ``path, size``
    of the archives (a written table).

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of
    ``least_bytes`` or more, the one with the smallest id is a response and the others
    revisit it. Rows that repeat that id with that payload are responses each, and so
    are rows of equal payloads whose ids are all null; a null id is otherwise larger
    than any. An empty table writes no archive.
    """
    payload = F.coalesce(column(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"),
    )
    copies = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and first_id is not null").select("digest", "first_id")
    )
    joined = rows.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
        "first_id",
    )

    def run(batches: Iterator[pa.RecordBatch]):
        context, archive, count, made = TaskContext.get(), None, 0, []
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for page, url, body, sha, revisit, first in zip(*columns):
                if archive is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.wacz"
                    archive = Archive(f"{folder.rstrip('/')}/{name}")
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                page = page.as_py()
                archive.add(
                    warc_record(page, url.as_py(), body.as_py(), digest, revisit.as_py(), first.as_py()), page
                )
                count += 1
                if count == ARCHIVE_RECORDS:
                    made.append(archive.close())
                    archive, count = None, 0
        if archive is not None:
            made.append(archive.close())
        if made:
            paths, sizes = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], names=ARCHIVES.names)

    return freeze(joined.mapInArrow(run, ARCHIVES), "archives")


def _reader(path: str):
    system, inner = _place(path)
    file = system.open_input_file(inner)

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return file, read


def record_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, offset, length``: ranges of whole records, from the archives' indexes."""

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                file, read = _reader(path)
                with file:
                    members = stored_members(read, size)
                    data, _ = members[DATA]
                    offsets, lengths = [], []
                    for line in read(*members[INDEX]).splitlines():
                        entry = json.loads(line)
                        if lengths and lengths[-1] + entry["length"] <= range_bytes:
                            lengths[-1] += entry["length"]
                        else:
                            offsets.append(data + entry["offset"])
                            lengths.append(entry["length"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())], names=RANGES.names,
                )

    return archives.select("path", "size").mapInArrow(run, RANGES)


def _records(data: bytes) -> Iterator[bytes]:
    while data:
        unpacker = zlib.decompressobj(wbits=31)
        yield unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives (RECORDS), read by ranges in parallel.

    ``payload`` is null for revisits, and for all records without ``with_payload``;
    sizes and digests are checked against the payload either way.
    """
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow_types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                file, read = _reader(path)
                with file:
                    rows = [parse_record(r) for r in _records(read(offset, length))]
                if not with_payload:
                    rows = [[*row[:-1], None] for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), arrow_types)], names=RECORDS.names
                )

    spread = record_ranges(archives).repartition(parts, "path", "offset")
    return spread.mapInArrow(run, RECORDS)
