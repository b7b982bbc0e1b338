"""WARC archives with a two-level capture index.

Write: each task streams its records, one gzip member each, to an archive of its own in the shared
folder and returns a line for each record; lines are written as a table, so only archives of finished
tasks are ever named. Index: lines sorted by reversed-host URL key are cut into compressed blocks; the
first and last key of each block make a sparse directory of at most 65,536 blocks (blocks grow with the
corpus instead), which is all that is sent to every task. Read: a key is binary-searched in the
directory, then in its block; ranges of archives are then read in file order.

Nulls and odd rows: null html is an empty payload; a null url has the key "-"; a null page_id can't be
referred to, and is a response only if its payload has no row with an id; rows that repeat a page_id
and payload are all responses; control characters in URLs are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, spread_join, tasks_for

LEAST_REVISIT = 1000
BLOCK_LINES, MOST_BLOCKS = 3000, 65536
READ_BYTES = 1 << 20
LINE_BYTES = 256
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
INDEX = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query in lower case, without scheme, port of the scheme, and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return quote(url.lower(), safe="/:?&=%,)(")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + path.lower(), safe="/:?&=%,)(;@+*!'$~")


def capture_key(url: str | None, page_id: int | None) -> str:
    """A url's key and the capture; unique for each page_id."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id, '020d')}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", "",
    ]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """RECORD of one WARC record; a response's digest is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    if not first.startswith("WARC/") or rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), fields["warc-target-uri"]


def _write(folder: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        stream, name, at = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= ARCHIVE_BYTES:
                    if stream:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page_id, url, html, digest, refers_to)) + squeeze.flush()
                stream.write(data)
                lines.append((capture_key(url, page_id), page_id, name, at, len(data)))
                at += len(data)
            if lines:
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*lines, strict=True))], names)
        if stream:
            stream.close()

    return run


def write_archives(pages: DataFrame) -> tuple[DataFrame, str]:
    """Archives of pages (page_id, url, html) in a fresh shared folder: their lines (INDEX) and the folder."""
    folder = fresh_path(pages.sparkSession, "archives")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    p = p.withColumn("digest", F.sha1("html"))
    long = F.length("html") >= LEAST_REVISIT
    first = p.where(long).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    p = spread_join(p, cut(first, "repeated"), "digest", "page_id", "left").select("page_id", "url", "html", "digest", F.when(long & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))
    return cut(p.mapInArrow(_write(folder), INDEX), "capture-lines"), folder


def _blocks(lines: int):
    def run(batches):
        held: list[str] = []

        def block(part):
            names = [x.split(" {")[0] for x in (part[0], part[-1])]
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "first": names[:1], "last": names[1:], "n": [len(part)], "data": [zlib.compress("\n".join(part).encode())]})

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(f"{key} {json.dumps({'page': page_id, 'file': file, 'offset': offset, 'length': length})}")
                if len(held) == lines:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return run


class CaptureIndex:
    """blocks: a table of compressed blocks; first, last, ids: the directory, in key order."""

    def __init__(self, lines: DataFrame):
        count = lines.count()
        size = max(BLOCK_LINES, -(-count // MOST_BLOCKS))
        rows = lines.repartitionByRange(tasks_for(count * LINE_BYTES), "key").sortWithinPartitions("key", "file", "offset")
        self.blocks = cut(rows.mapInArrow(_blocks(size), "block string, first string, last string, n long, data binary"), "capture-blocks")
        directory = self.blocks.select("first", "last", "block").orderBy("first", "last").collect()
        self.first, self.last, self.ids = ([r[i] for r in directory] for i in range(3))
        self.sent = lines.sparkSession.sparkContext.broadcast((self.first, self.last, self.ids))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """For the distinct column key of keys (capture keys, or URL keys for all their captures): key, page_id, file, offset, length."""
        sent = self.sent

        def route(batches):
            first, last, ids = sent.value
            for batch in batches:
                out = []
                for key in batch.column(0).to_pylist():
                    at = bisect.bisect_left(last, key)
                    while at < len(ids) and first[at] <= key + " ￿":
                        out.append((key, ids[at]))
                        at += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "block"])

        def search(asked, blocks):
            out = []
            for data in blocks.column("data").to_pylist():
                lines = zlib.decompress(data).decode().split("\n")
                names = [x.split(" {")[0] for x in lines]
                for key in asked.column("key").to_pylist():
                    at = bisect.bisect_left(names, key)
                    while at < len(lines) and (names[at] == key or names[at].startswith(key + " ")):
                        x = json.loads(lines[at][len(names[at]) + 1 :])
                        out.append((names[at], x["page"], x["file"], x["offset"], x["length"]))
                        at += 1
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["key", "page_id", "file", "offset", "length"])

        asked = keys.select("key").where("key is not null").distinct().mapInArrow(route, "key string, block string")
        return asked.groupBy("block").cogroup(self.blocks.select("block", "data").groupBy("block")).applyInArrow(search, INDEX)


def _read(folder: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if at != name:
                    name, file = at, fs.open_input_file(f"{base}/{at}")
                out.append(parse(zlib.decompress(file.read_at(length, offset), 31)))
            if out:
                fields = [x.split() for x in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    return run


def read_records(places: DataFrame, folder: str, size: int) -> DataFrame:
    """The records at places (file, offset, length), of `size` bytes in all, as RECORD."""
    n = tasks_for(size)
    spread = places.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return spread.mapInArrow(_read(folder), RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every capture up and read it back."""
    lines, folder = write_archives(pages)
    size = lines.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    return read_records(CaptureIndex(lines).lookup(lines.select("key")), folder, size)
