"""WARC records in ZIP-packaged archives: written from pages, read back by byte ranges.

An archive is a ZIP file with two stored members, ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdxj`` (offset and length of each).
The reader takes the end records (ZIP64 ones too), the central directory and a
member's local header from byte ranges, then reads single records by the
index; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.llm.shared import materialize, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2026-01-01T00:00:00Z"
DEDUP_BYTES = 1000
#: Repeated payloads known up to this number go to all tasks (about 60 bytes each); beyond, they meet pages in a shuffled join.
REPEATS_IN_MEMORY = 500_000
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

Range = Callable[[int, int], bytes]


# --- ZIP -----------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """A ZIP file of stored members. ``zip64`` writes sizes and offsets in ZIP64 fields whatever their size."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        big = zip64 or len(data) >= 0xFFFFFFFF or len(out) >= 0xFFFFFFFF
        crc, at, raw = zlib.crc32(data), len(out), name.encode()
        small = 0xFFFFFFFF if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra
    n, at = len(members), len(out)
    out += central
    big = zip64 or n >= 0xFFFF or at >= 0xFFFFFFFF or len(central) >= 0xFFFFFFFF
    if big:
        end = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at) + LOCATOR + struct.pack("<IQI", 0, end, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, *([0xFFFF] * 2 if big else [n] * 2), *([0xFFFFFFFF] * 2 if big else [len(central), at]), len(comment)) + comment
    return bytes(out)


def zip_members(read: Range, size: int) -> dict[str, tuple[int, int, int]]:
    """Offset of the local header, size and method of each member, from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail_at + at >= 20:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == LOCATOR:
            head = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
    central, p, found = read(start, length), 0, {}
    for _ in range(n):
        if central[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, names, extras, comments, offset = struct.unpack_from("<H", central, p + 10) + struct.unpack_from("<IIHHH", central, p + 20) + struct.unpack_from("<I", central, p + 42)
        name, extra = central[p + 46 : p + 46 + names].decode("utf-8", "replace"), central[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that are full in the record, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + k :]
        found[name] = (offset, packed, method)
        p += 46 + names + extras + comments
    return found


def member_range(read: Range, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie; its local header tells their start."""
    offset, size, method = member
    if method != 0:
        raise ValueError("not a stored member: its records have no byte ranges")
    head = read(offset, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header where the central directory points")
    names, extras = struct.unpack_from("<HH", head, 26)
    return offset + 30 + names + extras, size


# --- WARC ----------------------------------------------------------------


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers only) of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of a record of an HTTP response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    for x in http.decode("latin-1").split("\r\n")[1:]:
        k, _, v = x.partition(":")
        headers[f"http:{k.strip().lower()}"] = v.strip()
    return {"headers": headers, "payload": payload}


def archive(records: list[tuple[str, bytes]], comment: bytes = b"") -> bytes:
    """An archive of (record id, record) pairs."""
    data, index = [], []
    at = 0
    for name, raw in records:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = z.compress(raw) + z.flush()
        index.append(json.dumps({"id": name, "offset": at, "length": len(packed)}))
        data.append(packed)
        at += len(packed)
    return zip_stored([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())], comment)


def read_archive(read: Range, size: int) -> Iterator[bytes]:
    """Records of an archive, one byte range each."""
    members = zip_members(read, size)
    at, n = member_range(read, members[INDEX])
    start, length = member_range(read, members[DATA])
    for line in read(at, n).decode().splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > length:
            raise ValueError("index points beyond the member")
        yield zlib.decompress(read(start + entry["offset"], entry["length"]), 31)


# --- Spark ---------------------------------------------------------------


def _pack(target_bytes: int):
    def fn(batches):
        rows: list[tuple[str, bytes]] = []
        held = 0

        def done():
            # The text writer ends a file with a line feed; it is the archive's comment.
            return pa.RecordBatch.from_arrays([pa.array([archive(rows, b"\n")[:-1]], pa.binary())], ["zip"])

        for batch in batches:
            pages, urls, htmls = batch.column("page_id"), batch.column("url"), batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                payload = htmls[i].as_py() or b""
                page = pages[i].as_py()
                raw = record(page, urls[i].as_py(), payload, batch.column("digest")[i].as_py(), batch.column("refers_to")[i].as_py())
                rows.append((f"urn:page:{page}", raw))
                held += len(raw)
                if held >= target_bytes:
                    yield done()
                    rows, held = [], 0
        if rows:
            yield done()

    return fn


def write_archives(pages: DataFrame, path: str, target_bytes: int = 16 << 20, repeats_in_memory: int = REPEATS_IN_MEMORY) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in the folder ``path``.

    Payloads are the html in UTF-8 (null: empty). Of rows with equal payloads of
    at least 1000 bytes, those with the largest page_id are responses and the
    others revisit it; smaller ones and rows without page_id are all responses.
    Rows that repeat the largest page_id are responses each. Other columns are
    ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = rows.where((F.octet_length("html") >= DEDUP_BYTES) & F.col("page_id").isNotNull()).select("digest", "page_id")
    repeated = long.groupBy("digest").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("least")).where("keep > least").select("digest", "keep")
    repeated = materialize(repeated, "repeated").withColumnRenamed("digest", "key")
    small = repeated.limit(repeats_in_memory + 1).count() <= repeats_in_memory
    # Short payloads, which many rows share, have a key of their own: they meet nothing and lie in no one task.
    able = (F.octet_length("html") >= DEDUP_BYTES) & F.col("page_id").isNotNull()
    keyed = rows.withColumn("key", F.when(able, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    told = keyed.join(F.broadcast(repeated) if small else repeated, "key", "left").select("page_id", "url", "html", "digest", F.when((F.octet_length("html") >= DEDUP_BYTES) & (F.col("keep") > F.col("page_id")), F.col("keep")).alias("refers_to"))
    packed = told.mapInArrow(_pack(target_bytes), "zip binary").select(F.col("zip").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _store(path: str):
    """The file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def ranges_readable(path: str) -> bool:
    """Whether tasks can read ranges of files in a folder without Spark: local and shared file systems, HDFS, object stores."""
    try:
        store, name = _store(path)
        return store.get_file_info(name).type != pafs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _records(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            size = batch.column("length")[i].as_py()
            content = batch.column("content")[i].as_py() if "content" in batch.schema.names else None
            if content is None:
                f = _open(batch.column("path")[i].as_py())

                def read(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)
            else:
                f = None

                def read(at: int, n: int, content=content) -> bytes:
                    return content[at : at + n]

            out = []
            try:
                for raw in read_archive(read, size):
                    r = parse_record(raw)
                    h = r["headers"]
                    page = h["warc-record-id"].removeprefix("<urn:page:").rstrip(">")
                    refers = h.get("warc-refers-to", "").removeprefix("<urn:page:").rstrip(">")
                    response = h["warc-type"] == "response"
                    digest = hashlib.sha1(r["payload"]).hexdigest() if response else h["warc-payload-digest"].removeprefix("sha1:")
                    out.append((int(page) if page else None, h.get("warc-target-uri"), h["warc-type"], int(h["http:content-length"]), digest, int(refers) if refers else None, r["payload"] if response else None))
            finally:
                if f is not None:
                    f.close()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 500], strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives in a folder: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Directories and members are read by ranges, on local and shared file
    systems, HDFS and object stores; where only Spark's readers reach a store, an
    archive (of bounded size) comes as one file's bytes. A revisit's payload is
    null; its size and digest are those of its response. Records of any size
    are read whole, one by one; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.select("path", "length") if ranges_readable(path) else files.select("path", "length", "content")
    return files.mapInArrow(_records, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back.

    Empty input gives no rows. Rows that repeat a page_id give a record each.
    """
    import uuid

    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
