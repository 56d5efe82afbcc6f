"""WARC records in ZIP archives: written once, then read by byte ranges.

Each task writes its pages as gzip members of ``archive/data.warc.gz``, stored
uncompressed in a ZIP file beside ``indexes/index.cdxj``. A page whose payload
another page holds is a revisit record without payload. The reader never
extracts an archive: it parses the end record (ZIP64 too) and the central
directory, locates the stored members, reads the index, and then reads the
records' byte ranges; neighbouring ranges are fetched together.

Archives go to the shared folder under names of their own, and a manifest table
lists those of the tasks that succeeded; what a lost executor leaves is not in it.

Defined results: a null html is an empty payload; a null url has no target
header; payloads below MIN_REVISIT bytes are always responses; rows that share
an id and a payload are alike; a page without an id is a response, and no page refers to it;
a payload may be as long as a binary value; other columns are not archived; an empty
table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import partitions, saved, shared_dir

MIN_REVISIT = 1000
#: Archives are closed at this size; ranges are fetched together up to this size.
ARCHIVE_BYTES, FETCH_BYTES = 256 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, payload_bytes, refers_to): refers_to is the page that holds the payload of a revisit."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes")).distinct()
    holders = p.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("c")).where("c > 1")
    refers = F.when(F.col("holder") != F.col("page_id"), F.col("holder")).alias("refers_to")
    return p.join(holders.drop("c"), ["digest", "payload_bytes"], "left").select("page_id", "digest", "payload_bytes", refers)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. ``digest`` is SHA-1 in hex."""
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        block = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _sha1(named: str | None) -> str | None:
    """The hex form of a payload digest header, or None if it names another hash or none."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(member: bytes) -> dict | None:
    """page_id, url, record_type, payload (None for a revisit), payload_bytes, payload_digest and refers_to of a record.

    Records of other types than response and revisit are None. What other writers leave out is None: an id
    that is no page's, and the length of a revisited payload; a digest that they leave out is computed."""
    raw = gzip.decompress(member) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    if warc.get("WARC-Type") not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    digest = _sha1(warc.get("WARC-Payload-Digest"))
    revisit = warc["WARC-Type"] == "revisit"
    if not revisit and digest not in (None, hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"payload of {warc['WARC-Record-ID']} does not have its digest")
    length = _headers(b"\r\n" + http).get("Content-Length")
    return {
        "page_id": _page(warc.get("WARC-Record-ID")),
        "url": warc.get("WARC-Target-URI"),
        "record_type": warc["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": (int(length) if length else None) if revisit else len(payload),
        "payload_digest": digest if revisit or digest else hashlib.sha1(payload).hexdigest(),
        "refers_to": _page(warc.get("WARC-Refers-To")) if revisit else None,
    }


class ArchiveWriter:
    """A ZIP file of one data member and its index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key: int | None, member: bytes) -> None:
        self.data.write(member)
        self.lines.append(json.dumps({"page": key, "offset": self.at, "length": len(member)}))
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


ReadAt = Callable[[int, int], bytes]


def directory(read: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """Data offset and length of each stored member, from the central directory. A data or index member that is compressed is an error, as no range of it can be read."""
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        big = read(at, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    central, at, members = read(start, length), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack("<HH", central[at + 8 : at + 12])
        packed, full, n, m, k = struct.unpack("<IIHHH", central[at + 20 : at + 34])
        local = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = central[at + 46 + n : at + 46 + n + m], 0
        while x + 4 <= len(extra):
            tag, size_ = struct.unpack("<HH", extra[x : x + 4])
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                values = iter(struct.unpack(f"<{size_ // 8}Q", extra[x + 4 : x + 4 + size_ // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            x += 4 + size_
        if method == 0:
            n_, m_ = struct.unpack("<HH", read(local + 26, 4))
            members[name] = (local + 30 + n_ + m_, packed)
        elif name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
            raise ValueError(f"{name} is not stored but compressed")
        at += 46 + n + m + k
    return members


def ranges(entries: list[tuple[int, int]], most: int = FETCH_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring (offset, length) of up to ``most`` bytes together."""
    run: list[tuple[int, int]] = []
    for offset, length in sorted(entries):
        if run and (offset != sum(run[-1]) or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def indexed(lines: list[bytes], only: str) -> dict[str, set[tuple[int, int]]]:
    """(offset, length) by data member: of lines of JSON, alone or behind a key and a time; ``only`` is the data member of lines that name none."""
    found: dict[str, set[tuple[int, int]]] = {}
    for line in lines:
        if b"{" not in line or line.startswith(b"!"):
            continue
        x = json.loads(line[line.index(b"{") :])
        name = x.get("filename", only)
        found.setdefault(name if name.startswith("archive/") else f"archive/{name}", set()).add((int(x["offset"]), int(x["length"])))
    return found


def scanned(read: ReadAt, start: int, size: int, most: int = FETCH_BYTES) -> Iterator[bytes]:
    """The gzip members of a data member that no index lists, one after another."""
    opened, kept, at = zlib.decompressobj(31), b"", 0
    while at < size or opened.unused_data:
        chunk = opened.unused_data
        if not chunk:
            chunk = read(start + at, min(most, size - at))
            at += len(chunk)
        elif opened.eof:
            opened = zlib.decompressobj(31)
        kept += opened.decompress(chunk)
        if opened.eof:
            yield kept
            kept = b""
            if not opened.unused_data:
                opened = zlib.decompressobj(31)


def records(path: str) -> Iterator[dict]:
    """The records of an archive, read by the ranges that its indexes list; data members without any are read through."""
    fs, local = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(local) as f:
        read = lambda at, n: f.read_at(n, at)
        members = directory(read, f.size())
        data = [n for n in members if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))]
        lines: list[bytes] = []
        for name, (start, size) in members.items():
            if name.startswith("indexes/") and not name.endswith(".idx"):
                raw = read(start, size)
                lines += (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).splitlines()
        listed = indexed(lines, data[0] if data else DATA)
        if missing := set(listed) - set(data):
            raise ValueError(f"{path} lists records of {', '.join(sorted(missing))}, which it does not have")
        for name in data:
            start, size = members[name]
            for run in ranges(list(listed.get(name, ()))):
                first, last = run[0][0], sum(run[-1])
                block = read(start + first, last - first)
                for offset, length in run:
                    if found := parse(block[offset - first : offset - first + length]):
                        yield found
            if name not in listed:
                if not name.endswith(".gz"):
                    raise ValueError(f"{name} is neither compressed by record nor indexed")
                yield from filter(None, map(parse, scanned(read, start, size)))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html); gives the manifest (archive, n_records, n_bytes), a table in the shared folder."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    r = roles(pages).select(F.col("page_id").alias("page"), F.col("digest").alias("sha1"), "refers_to")
    both = p.join(r, p.page_id.eqNullSafe(r.page) & (p.digest == r.sha1)).select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches):
        writer, closed = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page_id, url, raw, digest, refers = (v.as_py() for v in row)
                writer = writer or ArchiveWriter(folder)
                writer.add(page_id, record(page_id, url, raw, digest, refers))
                if writer.at >= archive_bytes:
                    closed.append(writer.close())
                    writer = None
        if writer:
            closed.append(writer.close())
        if closed:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*closed, strict=True)], ["archive", "n_records", "n_bytes"])

    return saved(both.mapInArrow(write, "archive string, n_records long, n_bytes long"), "manifest")


READ = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def read_archives(manifest: DataFrame, tasks: int) -> DataFrame:
    """A row per record of the archives that ``manifest`` lists."""

    def read(batches):
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, held = [], 0
                for x in records(path):
                    rows.append(x)
                    held += len(x["payload"] or b"")
                    if held > FETCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(READ))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(READ))

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return manifest.select("archive").repartition(tasks).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives below the shared folder and read back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "archives")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return read_archives(write_archives(pages, folder), partitions(spark))
