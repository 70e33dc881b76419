"""WARC records in ZIP packages, read by range without extraction.

`write_archives` makes, per task, ZIP packages with two stored members: `archive/data.warc.gz` (a warcinfo record, then
the records, each its own gzip member) and `indexes/index.cdxj` (a line for each record: its URL key, its time, and as
JSON its place, length and digest; in the order of keys).  Payloads seen before are
revisit records; they name the first record and keep the HTTP header, with the payload's length, but not the payload.
A record is named by its page_id and payload digest: exactly repeated rows are copies of one record and share its name.
The list of archives is a table in the shared folder.
`ZipArchive` parses the end record, the ZIP64 records and the central directory itself, finds where a stored member
begins, and reads records by range through the index.

Defined results: a null page is an empty payload; of equal payloads (from `min_bytes` on) the smallest page_id is
the response, and all its repeated rows are; a null page_id is never another's response and is itself a response unless
an id has the payload; a null url is left out; an empty table makes no archive; further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op4_token_store import filesystem
from .store import Tables, new_folder

#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:siftgauge:page:"
_TIME = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """The sort key of a URL: its host from the last label on, then the path; `-` without one."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return re.sub(r"\s", lambda x: f"%{ord(x[0]):02X}", url or "-")
    return re.sub(r"\s", lambda x: f"%{ord(x[0]):02X}", ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/"))


def _name(page_id: int | None, digest: str) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}:{digest}>"


def _packed(head: list[str], block: bytes) -> bytes:
    data = ("WARC/1.1\r\n" + "\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def warcinfo() -> bytes:
    """The first record of an archive, as a gzip member."""
    block = b"software: siftgauge\r\nformat: WARC File Format 1.1\r\n"
    return _packed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_TIME}", "Content-Type: application/warc-fields"], block)


def warc_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One gzip member: the response, or a revisit of the page `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = payload_digest(payload)
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {_TIME}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first, digest)}"]
    return _packed([*head, "Content-Type: application/http; msgtype=response"], http if first is not None else http + payload)


def parse_record(member: bytes) -> dict:
    """type, id, digest, refers_to, HTTP length and payload (None for a revisit) of a record's gzip member."""
    data = zlib.decompress(member, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
    number = lambda name: int(x) if name and (x := name[1:-1].removeprefix(_URN).split(":")[0]) else None
    kind = fields["WARC-Type"]
    return {"type": kind, "id": number(fields["WARC-Record-ID"]), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")), "length": length, "payload": payload if kind == "response" else None}


def zip_package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP file of stored members, each given in parts; ZIP64 records where sizes ask for it or `zip64` is set."""
    parts, directory, at = [], [], 0
    for name, data in members:
        raw, crc, full = name.encode(), 0, sum(map(len, data))
        for part in data:
            crc = zlib.crc32(part, crc)
        wide = zip64 or max(full, at) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, full, full) if wide else b""
        size = 0xFFFFFFFF if wide else full
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        far = struct.pack("<HHQQQ", 1, 24, full, full, at) if wide else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(far), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + far)
        parts += [local, *data]
        at += len(local) + full
    listed = b"".join(directory)
    n = len(members)
    if zip64 or at + len(listed) >= 0xFFFFFFFF or n >= 0xFFFF:
        parts += [listed, struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listed), at), struct.pack("<4sIQI", b"PK\6\7", 0, at + len(listed), 1), struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)]
    else:
        parts += [listed, struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, len(listed), at, 0)]
    return parts


class ZipArchive:
    """Members of a ZIP file by their central directory; `file` has size(), seek() and read() (pyarrow's or Python's)."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        tail = self._read(max(0, end - 65_557), min(end, 65_557))
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        n, _, size, start = struct.unpack_from("<HHII", tail, at + 8)
        place = end - len(tail) + at
        if n == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self._read(place - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, _, size, start = struct.unpack_from("<QQQQ", record, 24)
        self.members = dict(self._directory(self._read(start, size), n))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def _directory(data: bytes, n: int) -> Iterator[tuple[str, dict]]:
        at = 0
        for _ in range(n):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", data, at + 10)
            crc, packed, size, names, extras, notes = struct.unpack_from("<IIIHHH", data, at + 16)
            start, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + names].decode()
            extra, k = data[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                k += 4 + length
            yield name, {"method": method, "crc": crc, "size": size, "header": start}
            at += 46 + names + extras + notes

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin in the file."""
        member = self.members[name]
        if member["method"]:
            raise ValueError(f"{name} is not stored")
        if "start" not in member:
            local = self._read(member["header"], 30)
            if local[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            member["start"] = member["header"] + 30 + sum(struct.unpack_from("<HH", local, 26))
        return member["start"]

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """A range of a stored member."""
        size = self.members[name]["size"]
        return self._read(self.start(name) + at, max(0, min(size - at, size if n is None else n)))


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes all rows of (page_id, url, html); returns a row for each archive."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("p"), F.unhex(F.sha1(html)).alias("d"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    firsts = keys.groupBy("d").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = keys.join(firsts, "d").where("p IS NULL OR p <> first").where("first IS NOT NULL").select("p", "d", "first").distinct()
    rows = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("u"), html.cast("binary").alias("h"), F.unhex(F.sha1(html)).alias("d"))
    joined = rows.join(again, rows["p"].eqNullSafe(again["p"]) & (rows["d"] == again["d"]), "left").select(rows["p"], "u", "h", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, data, index, at = TaskContext.get().partitionId(), 0, [], [], 0  # index: (key, line)

        def close() -> pa.RecordBatch:
            nonlocal made, data, index, at
            path = f"{folder}/part-{task:06d}-{made:04d}.wacz"
            store, place = filesystem(path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            attempt = f"{place}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                for part in zip_package([(DATA, data), (INDEX, ["".join(line for _, line in sorted(index)).encode()])], zip64):
                    out.write(part)
            store.move(attempt, place)
            done = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([at], pa.int64())})
            made, data, index, at = made + 1, [], [], 0
            return done

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                if not data:
                    data.append(warcinfo())
                    at = len(data[0])
                link, raw = url.as_py(), payload.as_py()
                record = warc_record(page_id.as_py(), link, raw, first.as_py())
                entry = {"url": link, "mime": "text/html" if first.as_py() is None else "warc/revisit", "status": "200", "digest": f"sha1:{payload_digest(raw)}", "length": len(record), "offset": at, "filename": DATA}
                index.append((surt(link), f"{surt(link)} 19700101000000 {json.dumps(entry)}\n"))
                data.append(record)
                at += len(record)
                if at >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return Tables(pages.sparkSession, "archives").write(joined.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = filesystem(path)
                with store.open_input_file(place) as file:
                    package, rows = ZipArchive(file), []
                    for line in io.StringIO(package.read(INDEX).decode()):
                        entry = json.loads(line.split(" ", 2)[2])
                        got = parse_record(package.read(entry["filename"], entry["offset"], entry["length"]))
                        if got["payload"] is not None and (len(got["payload"]) != got["length"] or payload_digest(got["payload"]) != got["digest"]):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        rows.append((got["id"], got["length"], got["digest"], got["type"], got["refers_to"]))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(read, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc")))
