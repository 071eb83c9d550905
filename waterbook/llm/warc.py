"""WARC records in ZIP-packaged archives: writer and range reader.

An archive is a ZIP file with stored (uncompressed) members: ``DATA_MEMBER``,
WARC records each gzipped by itself, and ``INDEX_MEMBER``, one JSON line per
record with its offset and length in the data member. The reader parses the
end record, its ZIP64 forms and the central directory by ranges from the end
of the file, finds where each stored member lies, reads the index, and then
reads records by range straight out of the archive; nothing is extracted.

Archives of other writers are read too: every ``archive/*`` member, gzipped or
plain, by whatever of ``indexes/*`` is there (JSON or CDXJ lines, gzipped or
not); an archive member that no index names is searched for its records. Other
members may be compressed, as nothing is read from them. A payload is held
against its digest where that is a SHA-1 and the body was sent as it is.

Files are opened with pyarrow's file systems, so any of its URIs will do.
Names of archives differ between task attempts and only those of finished
tasks reach the manifest, so lost executors leave unlisted files, not wrong
results.

Defined results: a null payload is empty; null ids are written as such; rows
with equal id and payload are separate records of the same type; when all ids
of a payload are null its records are responses. An empty table writes no
archive. Other columns of the pages are ignored, whatever their names. A payload
is held whole by the task that writes or reads its record, one at a time beside
its batch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:waterbook:page:"


def file_system(uri: str):
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# --- ZIP directories -------------------------------------------------------


def locate_members(read: Callable[[int, int], bytes], size: int, wanted: Callable[[str], bool] = lambda name: True) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of every stored member, by name.

    ``read(offset, length)`` reads a range of the archive. Only members with a
    ``wanted`` name are located. Raises ValueError for an archive that is cut
    off and for a wanted member that is compressed or encrypted.
    """
    tail_at = max(0, size - 65_557)  # end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if tail_at + at >= 20:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, p = read(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # 64-bit values, only of the fields that do not fit
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + n
        p += 46 + n_name + n_extra + n_comment
        if not wanted(name):
            continue
        if method or flags & 1:
            raise ValueError(f"member {name} is not stored plainly")
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name_here, n_extra_here = struct.unpack_from("<HH", local, 26)
        out[name] = (header + 30 + n_name_here + n_extra_here, packed)
    return out


# --- WARC records ----------------------------------------------------------


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit if ``refers_to`` is given: the HTTP
    header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and HTTP body of a record."""

    def headers(block: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs if k}

    head, mark, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not mark:
        raise ValueError("not a WARC record")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) < int(warc["content-length"]):
        raise ValueError("a WARC record is cut off")
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, headers(http), body


# --- writing ---------------------------------------------------------------


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, digest, refers_to) of the rows that repeat a payload; the row
    with the largest key is the one that they refer to."""
    t = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.sha1(t).alias("digest"), F.octet_length(t).alias("n")).filter(F.col("n") >= least_bytes)
    first = rows.groupBy("digest").agg(F.max("k").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and refers_to is not null").drop("rows")
    return rows.join(first, "digest").filter("not (k <=> refers_to)").select("k", "digest", "refers_to").distinct()


def _write_batches(folder: str, archive_bytes: int, date: str, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        data, index, raw = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            """The archive built so far, at most ``archive_bytes`` and one record."""
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                z.writestr(DATA_MEMBER, data.getbuffer())
                z.writestr(INDEX_MEMBER, "".join(f"{json.dumps(x)}\n" for x in index))
            row = [[name if "://" not in folder else f"{folder}/{name.rpartition('/')[2]}"], [len(index)], [data.tell()]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, text, refers_to in zip(*batch.columns, strict=True):
                record = warc_record(page_id.as_py(), url.as_py(), (text.as_py() or "").encode(), refers_to.as_py(), date)
                packed = gzip.compress(record, level, mtime=0)
                index.append({"id": page_id.as_py(), "offset": data.tell(), "length": len(packed)})
                data.write(packed)
                raw += len(record)
                if raw >= archive_bytes:
                    yield close()
                    data, index, raw = io.BytesIO(), [], 0
        if index:
            yield close()

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    date: str = "2026-01-01T00:00:00Z",
    level: int = 6,
) -> DataFrame:
    """Write a record per row into archives below ``folder``; returns the
    manifest (path, records, bytes), itself stored."""
    again = stored(revisits(pages, key, payload, least_bytes), "warc-revisits").alias("r")
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("t"), F.sha1(F.coalesce(F.col(payload), F.lit(""))).alias("digest")).alias("p")
    rows = rows.join(again, F.col("p.k").eqNullSafe(F.col("r.k")) & (F.col("p.digest") == F.col("r.digest")), "left")
    rows = rows.select("p.k", F.col("u").cast("string"), "t", "refers_to")
    done = rows.mapInArrow(_write_batches(folder, archive_bytes, date, level), "path string, records bigint, bytes bigint")
    return stored(done, "warc-manifest")


# --- reading ---------------------------------------------------------------


#: Bytes of a member read at once, and ranges handed on at once.
BLOCK, RANGES = 1 << 20, 500


def blocks(read: Callable[[int, int], bytes], at: int, length: int) -> Iterator[bytes]:
    for start in range(at, at + length, BLOCK):
        yield read(start, min(BLOCK, at + length - start))


def index_lines(read: Callable[[int, int], bytes], at: int, length: int, packed: bool) -> Iterator[bytes]:
    """Lines of an index, read block by block; ``packed``: gzip members."""
    rest, unzip = b"", zlib.decompressobj(31)
    for data in blocks(read, at, length):
        while data:
            plain, data = (unzip.decompress(data), unzip.unused_data) if packed else (data, b"")
            if packed and unzip.eof:
                unzip = zlib.decompressobj(31)
            *lines, rest = (rest + plain).split(b"\n")
            yield from lines
    yield rest


def index_entries(name: str, lines: Iterator[bytes]) -> Iterator[tuple[str | None, int, int]]:
    """(archive member or None, offset, length) of the records an index names."""
    for line in lines:
        begin = line.find(b"{")
        if begin < 0 or line.startswith(b"!"):
            continue
        entry = json.loads(line[begin:])
        if "offset" in entry and "length" in entry:
            yield entry.get("filename"), int(entry["offset"]), int(entry["length"])


def gzipped_records(read: Callable[[int, int], bytes], at: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member; what it holds is not kept."""
    unzip, begin, seen = zlib.decompressobj(31), 0, 0
    for data in blocks(read, at, length):
        while data:
            unzip.decompress(data)
            seen += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
            if unzip.eof:
                yield begin, seen - begin
                unzip, begin = zlib.decompressobj(31), seen
    if begin < seen:
        raise ValueError("a gzipped WARC record is cut off")


def plain_records(read: Callable[[int, int], bytes], at: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of an uncompressed member, by its headers."""
    begin = 0
    while begin < length:
        head, size = b"", min(4096, length - begin)
        while b"\r\n\r\n" not in head and len(head) < length - begin:
            head = read(at + begin, size)
            size = min(2 * size, length - begin)
        text = head.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:\s*(\d+)", text)
        if not text.startswith(b"WARC/") or not found:
            raise ValueError("not a WARC record")
        whole = len(text) + 4 + int(found[1]) + 4
        yield begin, min(whole, length - begin)
        begin += whole


def archive_records(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the archive of the records of all its WARC members."""
    members = locate_members(read, size, lambda n: n.startswith(("archive/", "indexes/")) and not n.endswith(("/", ".idx")))
    data = {n: m for n, m in members.items() if n.startswith("archive/")}
    seen: dict[str, set[int]] = {n: set() for n in data}  # offsets: two indexes may name a record
    for index, (at, length) in members.items():
        if index in data:
            continue
        for file, offset, n in index_entries(index, index_lines(read, at, length, index.endswith(".gz"))):
            name = f"archive/{file.rpartition('/')[2]}" if file else DATA_MEMBER
            if name not in data or offset + n > data[name][1]:
                raise ValueError(f"{index} names a record outside of {name}")
            if offset not in seen[name]:
                seen[name].add(offset)
                yield data[name][0] + offset, n
    for name, (at, length) in data.items():
        if length and not seen[name]:
            find = gzipped_records if read(at, 2) == b"\x1f\x8b" else plain_records
            yield from ((at + offset, n) for offset, n in find(read, at, length))


def _range_batches(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(path: str, groups: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        ranges = pa.list_(pa.int64())
        columns = [pa.array([path] * len(groups), pa.string()), *(pa.array([[r[i] for r in g] for g in groups], ranges) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["path", "offsets", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:

                    def read(offset: int, length: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(length)

                    groups: list[list[tuple[int, int]]] = []
                    size = chunk_bytes
                    for offset, length in archive_records(read, f.size()):
                        if size + length > chunk_bytes:
                            if len(groups) == RANGES:
                                yield batch_of(path, groups)
                                groups = []
                            groups.append([])
                            size = 0
                        groups[-1].append((offset, length))
                        size += length
                if groups:
                    yield batch_of(path, groups)

    return run


RECORD = "path string, offset bigint, record_type string, record_id string, uri string, payload_digest string, payload_length bigint, refers_to string, payload binary"


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strip = lambda x: x[1:-1] if x and x.startswith("<") else x
    for batch in batches:
        for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = file_system(path)
            rows = []
            with fs.open_input_file(name) as f:
                for offset, length in zip(offsets, lengths, strict=True):
                    f.seek(offset)
                    data = f.read(length)
                    warc, http, body = parse_record(gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data)
                    stated = warc.get("warc-payload-digest", "")
                    digest = stated.removeprefix("sha1:") or None
                    if warc["warc-type"] == "response" and stated.startswith("sha1:") and "transfer-encoding" not in http and digest32(body) != digest:
                        raise ValueError(f"payload of {warc['warc-record-id']} in {path} does not have its digest")
                    n = int(http["content-length"]) if "content-length" in http else len(body)
                    payload = body if warc["warc-type"] != "revisit" else None
                    rows.append((path, offset, warc["warc-type"], strip(warc["warc-record-id"]), warc.get("warc-target-uri"), digest, n, strip(warc.get("warc-refers-to")), payload))
            names = [x.split()[0] for x in RECORD.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, paths: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives named in column ``path``. Archives are cut
    into ranges of about ``chunk_bytes``, dealt evenly to the readers."""
    ranges = paths.select("path").mapInArrow(_range_batches(chunk_bytes), "path string, offsets array<bigint>, lengths array<bigint>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts).mapInArrow(_record_batches, RECORD)
