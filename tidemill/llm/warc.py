"""Web archives packaged in ZIP files: written by tasks, read by range without extraction.

A package holds stored members: ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj`` (a line with offset and length for
each record). The reader finds the members through the end record, the ZIP64 records and the central directory, reads the index by range, and deals
stretches of records over all tasks, so a large package is no single task. A package without an index is read as one stretch.

Files go through ``pyarrow.fs`` in the folder that all executors share. A task writes under a name of its own and moves the whole file into its place, so a task that
runs again leaves the same file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import MAX_BROADCAST_ROWS, materialise, shared_folder
from tidemill.sources.paths import open_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
STRETCH = 4 << 20
STRETCHES_PER_TASK = 8
LEAST_PAYLOAD = 100
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, size long, records long"
STRETCHES = "path string, start long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string"


# Writing.

def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit carries the HTTP head alone."""
    url = "".join((url or "").split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        system, base = open_path(folder)
        final, own = f"{base}/part-{part:06d}.zip", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
        lines, offset, records = [], 0, 0
        with system.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as data:
                for batch in batches:
                    for row in batch.to_pylist():
                        packed = _gzip(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                        data.write(packed)
                        lines.append(f"{''.join((row['url'] or '').split()) or '-'} {DATE} " + json.dumps({"offset": offset, "length": len(packed), "filename": DATA}))
                        offset += len(packed)
                        records += 1
            with package.open(INDEX, "w", force_zip64=True) as index:
                index.write("\n".join(lines).encode())
        system.move(own, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/part-{part:06d}.zip"]), pa.array([system.get_file_info(final).size], pa.int64()), pa.array([records], pa.int64())],
            names=["path", "size", "records"])
    return run


def write_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one record for each row, a package for each partition; returns the manifest (path, size, records).

    Payloads are UTF-8, a null one is empty. Of rows with equal payloads of at least ``LEAST_PAYLOAD`` bytes those with the smallest page_id are responses,
    the others revisits of it; rows that repeat that id are responses too. A null id is never the smallest while there is another. A null url is empty.
    An empty table writes no records. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, base = open_path(folder)
    system.create_dir(base)
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= LEAST_PAYLOAD).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = large.join(first, "digest").filter("not (page_id <=> refers_to) and refers_to is not null")
    again = materialise(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct())
    side = F.broadcast(again) if again.count() <= MAX_BROADCAST_ROWS // 4 else again
    rows = rows.join(side, rows["page_id"].eqNullSafe(side["_id"]) & (rows["digest"] == side["_digest"]), "left").drop("_id", "_digest")
    return materialise(rows.mapInArrow(_write(folder), MANIFEST))


# Reading.

class Member:
    """A member of a package: name, method (0 is stored), place of its local header, size."""

    def __init__(self, name: str, method: int, header: int, size: int):
        self.name, self.method, self.header, self.size = name, method, header, size


def directory(file, size: int) -> list[Member]:
    """The members of a ZIP file by its central directory; ``file`` needs ``read_at(length, offset)``. ZIP64 records are followed where they are used."""
    tail_at = max(0, size - 65557)
    tail = bytes(file.read_at(size - tail_at, tail_at))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP package: no end of central directory")
    entries, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[end - 12:end - 4])[0]
        wide = bytes(file.read_at(56, at))
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", wide[32:56])
    data, at, found = bytes(file.read_at(length, start)), 0, []
    for _ in range(entries):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[at + 8:at + 12])
        packed, plain, name_size, extra_size, note_size = struct.unpack("<IIHHH", data[at + 20:at + 34])
        header = struct.unpack("<I", data[at + 42:at + 46])[0]
        name = data[at + 46:at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + name_size:at + 46 + name_size + extra_size], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e:e + 4])
            if kind == 1:  # ZIP64: the fields that are full above, in this order
                wide, w = extra[e + 4:e + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, w = struct.unpack("<Q", wide[w:w + 8])[0], w + 8
                if packed == 0xFFFFFFFF:
                    packed, w = struct.unpack("<Q", wide[w:w + 8])[0], w + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", wide[w:w + 8])[0]
            e += 4 + n
        found.append(Member(name, method, header, packed))
        at += 46 + name_size + extra_size + note_size
    return found


def member_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    head = bytes(file.read_at(30, member.header))
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in its package; only stored members can be read by range")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def places(lines: bytes) -> list[tuple[str | None, int, int]]:
    """File name (null: none given), offset and length of each line of an index; a line is a key, a time, and a JSON object, and the key may hold any signs but spaces.

    Offsets and lengths may be numbers or texts. Lines without them, such as headers, are passed over."""
    out = []
    for line in lines.splitlines():
        parts = line.split(None, 2)
        if len(parts) == 3 and parts[2].startswith(b"{"):
            about = json.loads(parts[2])
            if "offset" in about and "length" in about:
                out.append((about.get("filename"), int(about["offset"]), int(about["length"])))
    return out


def member_stretches(member: Member, indexed: list[tuple[str | None, int, int]], alone: bool) -> list[tuple[int, int]]:
    """Stretches (offset, length) of whole records of a member. Lines of the index belong to it by the file name, or without one where it is the only member;
    they may come in any order. If they do not cover the member without gaps, it is one stretch."""
    mine = sorted((at, size) for name, at, size in indexed if (alone if name is None else name in (member.name, member.name.rpartition("/")[2])))
    ends = [0, *(at + size for at, size in mine)]
    if ends[-1] != member.size or any(at != end for (at, _), end in zip(mine, ends[:-1], strict=True)):
        return [(0, member.size)] if member.size else []
    out, low = [], 0
    for at, size in mine:
        if at > low and at + size - low > STRETCH:
            out.append((low, at - low))
            low = at
    return [*out, (low, member.size - low)] if member.size > low else out


def _locate(batches):
    """Stretches of records (path, start, length) of the packages in a batch of paths."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = open_path(path)
            rows = []
            with system.open_input_file(name) as file:
                members = directory(file, file.size())
                indexed = []
                for m in members:
                    if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj")):
                        indexed += places(bytes(file.read_at(m.size, member_start(file, m))))
                data = [m for m in members if m.name.startswith("archive/") and not m.name.endswith("/")]
                for m in data:
                    start = member_start(file, m)
                    rows += [(start + low, length) for low, length in member_stretches(m, indexed, len(data) == 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                                 names=["path", "start", "length"])


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a run of gzip members or plain records."""
    while data:
        if data[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            plain, data = unpack.decompress(data) + unpack.flush(), unpack.unused_data
        else:
            plain, data = data, b""
        while plain.strip(b"\r\n"):
            head, _, rest = plain.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers["content-length"])
            yield headers, rest[:size]
            plain = rest[size + 4:]


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            system, name = open_path(row["path"])
            with system.open_input_file(name) as file:
                data = bytes(file.read_at(row["length"], row["start"]))
            out = []
            for headers, block in parse_records(data):
                payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
                if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
                out.append((_page(headers.get("warc-record-id")), headers.get("warc-target-uri", ""), headers["warc-type"], _page(headers.get("warc-refers-to")), payload, digest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)],
                names=["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"])


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """path of the packages in a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")


def read_packages(paths: DataFrame) -> DataFrame:
    """Records of the packages named in the first column: page_id, url, record_type, refers_to, payload (null for revisits), payload_digest.

    Payloads of responses are checked against their digests; a mismatch, a broken directory or a compressed member raises. Packages without records give no rows.
    """
    stretches = materialise(paths.select(F.col(paths.columns[0]).cast("string").alias("path")).repartition("path").mapInArrow(_locate, STRETCHES))
    tasks = max(1, -(-stretches.count() // STRETCHES_PER_TASK))  # a given number: rows this small would else be joined into one task
    return stretches.repartition(tasks, "path", "start").mapInArrow(_read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """The digest columns of each record; a revisit takes the size of the response it refers to."""
    rows = records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    rows = materialise(rows)
    source = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    return rows.join(source, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
