"""WARC archives and their two-level capture index.

Writing: every task writes one archive of its pages to the shared folder, each
record a gzip member of its own.  A page whose payload (of at least `least` bytes)
also belongs to a larger page_id is written as a revisit of that record, without
payload.  Index: captures are sorted by reversed-host URL key and page; each range
becomes an index file of compressed blocks of lines, ending in its own sparse
directory (first key, place and length of each block).  A lookup searches the first
keys of the files, then that directory, reads one block by range, searches it, and
reads the record by range.

Files carry a fresh name for every task attempt; only those named in the tables that
Spark commits are ever read, so a lost or repeated task leaves an unread file at most.

Defined results: a null html is an empty payload; a page without url has the key of
`urn:page:<id>`; of pages with equal payloads those with the largest page_id (several
rows, if it repeats) are responses; pages with null ids revisit others but are never
revisited; an unusual url is percent-encoded, its key is its own text if it can't be split.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.scratch import new_folder, written

LEAST_BYTES, BLOCK_LINES, INDEX_FILES = 1000, 1000, 1024
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a url that stand in a header as they are; others are percent-encoded.
PLAIN = "!#$%&'()*+,/:;=?@[]~"


def target_uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe=PLAIN) if url else f"urn:page:{page_id}"


def url_key(uri: str) -> str:
    """Reversed-host sort key: http://www.a.org/x?y is org,a,www)/x?y."""
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname, parts.port
    except ValueError:
        return uri.lower()
    if not host:
        return uri.lower()
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")).replace(" ", "%20")


def capture_key(uri: str, page_id: int | None) -> str:
    """Sort key of one capture: its url key, then its page in numeric order."""
    return f"{url_key(uri)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = http + payload if refers_to is None else http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@dataclass
class Archive:
    """Folder of the files, the captures, and (first key, file) of the index files in order."""

    folder: str
    captures: DataFrame
    index: list[tuple[str, str]]


def write_archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archives and index of pages (page_id, url, html)."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    size = F.octet_length("payload")
    shared = rows.where(size >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    shared = written(shared, "shared-payloads")  # a plain scan, so that the join can split a frequent payload
    refers = F.when((size >= least) & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    typed = rows.join(shared.drop("n"), "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, stream = f"{uuid.uuid4().hex}.warc.gz", 0, None
        store, base = _store(folder)
        for batch in batches:
            if stream is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}", compression=None)
            keys, places, lengths = [], [], []
            for page, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                uri = target_uri(url, page)
                member = record(page, uri, html, refers_to, date)
                stream.write(member)
                keys.append(capture_key(uri, page))
                places.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                names=["capture", "file", "place", "length"])
        if stream is not None:
            stream.close()

    captures = written(typed.mapInArrow(write, "capture string, file string, place long, length long"), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, lines, directory, at, stream = f"{uuid.uuid4().hex}.cdx.gz", [], [], 0, None
        store, base = _store(folder)

        def flush() -> int:
            member = gzip.compress("\n".join(lines).encode(), 5, mtime=0)
            directory.append((lines[0].rsplit(" ", 3)[0], at, len(member)))
            stream.write(member)
            lines.clear()
            return at + len(member)

        for batch in batches:
            if stream is None and batch.num_rows:
                stream = store.open_output_stream(f"{base}/{name}", compression=None)
            for line in zip(*[c.to_pylist() for c in batch.columns]):
                lines.append(" ".join(map(str, line)))
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if stream is not None:
            if lines:
                at = flush()
            tail = gzip.compress(json.dumps(directory).encode(), 5, mtime=0)
            stream.write(tail + len(tail).to_bytes(8, "big"))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "file": name}])

    files = min(INDEX_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = captures.repartitionByRange(files, "capture", "file", "place").sortWithinPartitions("capture", "file", "place")
    tops = ranges.mapInArrow(index, "first string, file string").orderBy("first").collect()  # at most INDEX_FILES rows
    return Archive(folder, captures, [(r["first"], r["file"]) for r in tops])


class Reader:
    """Lookups in an archive's index; keeps the last directory, block and files at hand."""

    def __init__(self, folder: str, tops: list[tuple[str, str]]):
        self.store, self.base = _store(folder)
        self.tops = tops
        self.firsts = [t[0] for t in tops]
        self.files: dict[str, object] = {}
        self.at: tuple = ()
        self.directory: list = []
        self.block_at: tuple = ()
        self.block: list[str] = []

    def _open(self, name: str):
        if name not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.base}/{name}")
        return self.files[name]

    def _lines(self, top: int, block: int) -> list[str]:
        name = self.tops[top][1]
        if self.at != (top,):
            f = self._open(name)
            size = f.size()
            n = int.from_bytes(f.read_at(8, size - 8), "big")
            self.directory, self.at, self.block_at = json.loads(gzip.decompress(f.read_at(n, size - 8 - n))), (top,), ()
        if block < 0:
            return []
        if self.block_at != (top, block):
            _, at, n = self.directory[block]
            self.block = gzip.decompress(self._open(name).read_at(n, at)).decode().split("\n")
            self.block_at = (top, block)
        return self.block

    def find(self, capture: str) -> Iterator[bytes]:
        """The records of a capture key."""
        # equal keys may begin in the last block before the first one that starts with the key
        top = max(0, bisect.bisect_left(self.firsts, capture) - 1)
        while top < len(self.tops) and self.firsts[top] <= capture:
            self._lines(top, -1)
            block = max(0, bisect.bisect_left([d[0] for d in self.directory], capture) - 1)
            while block < len(self.directory) and self.directory[block][0] <= capture:
                lines = self._lines(top, block)
                i = bisect.bisect_left(lines, capture + " ")
                while i < len(lines) and lines[i].startswith(capture + " "):
                    _, file, place, length = lines[i].rsplit(" ", 3)
                    yield self._open(file).read_at(int(length), int(place))
                    i += 1
                block += 1
            top += 1


def read_archive(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of some capture keys (`capture`, repeats are read once), looked up in the index."""
    spark = captures.sparkSession
    folder, tops = archive.folder, spark.sparkContext.broadcast(archive.index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, tops.value)
        for batch in batches:
            out, size = [], 0
            for key in batch.column(0).to_pylist():
                for member in reader.find(key):
                    fields, payload = parse(member)
                    page = fields.get("X-Page-ID")
                    out.append({"page_id": None if page is None else int(page), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
                                "record_id": fields["WARC-Record-ID"], "refers_to_id": fields.get("WARC-Refers-To"),
                                "digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "payload": payload})
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    names = ["page_id", "url", "record_type", "record_id", "refers_to_id", "digest", "payload"]
    schema = pa.schema([(n, {"page_id": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
    keys = captures.select("capture").distinct()
    files = min(INDEX_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(files, "capture").sortWithinPartitions("capture")
    return ordered.mapInArrow(run, "page_id long, url string, record_type string, record_id string, refers_to_id string, digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits stand for the payload they refer to.

    A record id may stand for several pages of one page_id; a revisit means that of its own payload's digest."""
    own = written(records.select("page_id", "record_type", "record_id", "refers_to_id", "digest", F.octet_length("payload").cast("long").alias("n"),
                                 F.sha1("payload").alias("sha1")), "records")
    original = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"), F.col("sha1").alias("digest")).agg(
        F.max("page_id").alias("to"), F.max("n").alias("to_n"))
    original = written(original, "responses")
    revisits = own.where("record_type = 'revisit'").join(original, ["refers_to_id", "digest"], "left").select(
        "page_id", F.col("to_n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("to").alias("refers_to"))
    return own.where("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(revisits)
