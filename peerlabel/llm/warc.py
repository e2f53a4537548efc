"""WARC archives: written by tasks, read back by byte ranges.

Every record is a gzip member of its own. A read task owns the members that start in
its range: it looks for gzip's magic bytes, takes a place as the start of a record only
if it decodes to a WARC header, and reads on past the end of its range to finish the last
one. Files are reached through ``pyarrow.fs``, by URI, in any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.llm.common import materialize, shared_dir, text_or_empty

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
READ_BYTES = 1 << 20
SMALL_TABLE = 500_000  # rows that may be broadcast
SALTS = 32
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
NO_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers give it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, record_id: str, uri: str, refers_to: str | None, payload: bytes, level: int) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{refers_to}>"),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass(frozen=True)
class WarcWriter:
    """Writes records to files of about ``file_bytes`` under a folder that tasks share.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest key
    is a response, the others revisit it; shorter ones are all responses.
    """

    file_bytes: int = 256 << 20
    min_bytes: int = 0
    level: int = 1

    def write(self, pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
        """The manifest (path, n_records, n_bytes) of the files written.

        NULL payloads and URIs are empty. Rows with a NULL key are responses and are no
        one's target; of rows that share a key and payload one is the response. A task
        that is run again writes files of new names, and only those of the run that
        counted are in the manifest, so lost executors leave unlisted files at most.
        Without rows no file is written.
        """
        records = pages.select(
            F.col(key).cast("string").alias("key"),
            F.col(key).alias("order"),
            text_or_empty(uri).alias("uri"),
            text_or_empty(payload).alias("payload"),
        ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
        # Only keys and digests are grouped; a frequent payload is combined in each task.
        shared = (
            records.where((F.octet_length("payload") >= self.min_bytes) & F.col("order").isNotNull())
            .groupBy("digest")
            .agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("copies"))
            .where("copies > 1")
        )
        linked = self._linked(records, materialize(shared, "warc-shared")).select(
            "key", "uri", "payload", F.when(F.col("order") > F.col("first"), F.col("first")).cast("string").alias("to")
        )
        manifest = linked.mapInArrow(self._writer(path), "path string, n_records long, n_bytes long")
        return materialize(manifest, "warc-manifest")

    @staticmethod
    def _linked(records: DataFrame, shared: DataFrame) -> DataFrame:
        """``records`` with ``first``, the smallest key of their payload where that is shared.

        While few payloads are shared, their table goes to the records, which stay where they lie.
        Else records are dealt out by digest and a salt, so that a payload that
        half of them repeat is no single task.
        """
        if shared.count() <= SMALL_TABLE:
            return records.join(F.broadcast(shared), "digest", "left")
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("key", "uri"), F.lit(SALTS)).cast("int")
        return records.withColumn("salt", salt).join(salted, ["digest", "salt"], "left")

    def _writer(self, folder: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = store_of(folder)
            store.create_dir(base, recursive=True)
            context = TaskContext.get()
            part = context.partitionId() if context else 0
            out, done = None, []
            for batch in batches:
                for k, uri, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                        out, n, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    kind = "response" if to is None else "revisit"
                    record = member(kind, record_id(k), uri, to and record_id(to), html.encode(), self.level)
                    out.write(record)
                    n, size = n + 1, size + len(record)
                    if size >= self.file_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", n, size))
                        out = None
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))
            columns = zip(*done, strict=True) if done else ([], [], [])
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
                ["path", "n_records", "n_bytes"],
            )

        return run


def store_of(uri: str):
    """The file system of a URI as Hadoop names it, and the path there."""
    import pyarrow.fs as pafs

    if uri.startswith(("s3a://", "s3n://")):
        uri = f"s3{uri[3:]}"
    elif uri.startswith("dbfs:/"):
        uri = f"file:///dbfs/{uri.removeprefix('dbfs:').lstrip('/')}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


def record_id(key: str | None) -> str:
    return f"urn:record:{key}" if key is not None else f"urn:uuid:{uuid.uuid4()}"


@dataclass(frozen=True)
class WarcReader:
    """Reads files of gzipped records, ``range_bytes`` of a file to a task."""

    range_bytes: int = 8 << 20

    def read(self, files: DataFrame) -> DataFrame:
        """The records of ``files`` (path, n_bytes), each once, in no order.

        ``payload`` is that of a response (without HTTP header) and NULL for a revisit;
        ``payload_bytes`` is the full payload's length as the HTTP header tells it. Bytes
        that are no record are passed over, wherever ranges begin; a record whose digest
        does not fit its payload fails the read.
        """
        step = F.lit(self.range_bytes).cast("long")
        last = F.greatest(F.col("n_bytes") - 1, F.lit(0))
        ranges = files.where("n_bytes > 0").select(
            "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, step)).alias("begin")
        )
        n = ranges.count()
        if n:
            ranges = ranges.repartition(min(n, 100_000), "path", "begin")
        return ranges.mapInArrow(self._reader(), RECORD)

    def _reader(self):
        size = self.range_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [field.split()[0] for field in RECORD.split(", ")]
            kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            for batch in batches:
                for row in batch.to_pylist():
                    store, path = store_of(row["path"])
                    with store.open_input_file(path) as source:
                        found = records_in(source, row["begin"], row["begin"] + size, row["n_bytes"])
                        for some in _grouped(found):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names
                            )

        return run


def _grouped(records: Iterator[tuple], size: int = 8 << 20) -> Iterator[list[tuple]]:
    some, total = [], 0
    for record in records:
        some.append(record)
        total += len(record[-1] or b"")
        if total >= size or len(some) >= 5000:
            yield some
            some, total = [], 0
    if some:
        yield some


class _Window:
    """A file read forwards, in steps; ``data[off:]`` are its bytes from ``at`` on."""

    def __init__(self, source, at: int, end: int):
        self.source, self.at, self.end, self.data, self.off = source, at, end, b"", 0

    def have(self, n: int) -> bool:
        """Whether n bytes from ``at`` on are at hand now."""
        while len(self.data) - self.off < n:
            begin = self.at + len(self.data) - self.off
            if begin >= self.end:
                return False
            more = self.source.read_at(min(READ_BYTES, self.end - begin), begin)
            self.data, self.off = self.data[self.off :] + more, 0
        return True

    def skip(self, n: int) -> None:
        self.at, self.off = self.at + n, self.off + n


def records_in(source, begin: int, stop: int, end: int) -> Iterator[tuple]:
    """The records that start at begin <= offset < stop of a file of ``end`` bytes."""
    window = _Window(source, begin, end)
    while window.at < stop and window.have(len(MAGIC)):
        place = window.data.find(MAGIC, window.off)
        if place < 0:  # the last bytes may be the start of the magic ones
            window.skip(len(window.data) - window.off - len(MAGIC) + 1)
            continue
        window.skip(place - window.off)
        if window.at >= stop:
            return
        length, record = decode_member(window)
        if record is not None:
            yield record
        window.skip(length)


def decode_member(window: _Window) -> tuple[int, tuple | None]:
    """Length and record of the member at the window's start; (1, None) if there is none.

    The first bytes decide: what does not inflate, or not to a WARC version, is no record.
    """
    inflate = zlib.decompressobj(31)
    out, used, checked = [], 0, False
    try:
        while not inflate.eof and window.have(used + 1):
            at = window.off + used
            piece = window.data[at : at + (READ_BYTES if checked else 512)]
            out.append(inflate.decompress(piece))
            used += len(piece)
            if not checked and (inflate.eof or sum(map(len, out)) >= len(VERSION)):
                checked = True
                if not b"".join(out).startswith(VERSION):
                    return 1, None
        record = parse(b"".join(out)) if inflate.eof and checked else None
    except zlib.error:
        return 1, None
    return (used - len(inflate.unused_data), record) if record is not None else (1, None)


def parse(raw: bytes) -> tuple | None:
    """The columns of RECORD; None if the header or its lengths do not hold."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = dict(_fields(head))
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    http, mark, body = rest[: int(length)].partition(b"\r\n\r\n")
    told = dict(_fields(http)).get("content-length")
    kind, known = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and known and digest(body) != known:
        raise ValueError(f"record {fields.get('warc-record-id')} does not fit its digest")
    return (
        fields.get("warc-record-id", "").strip("<>"),
        kind,
        fields.get("warc-target-uri"),
        fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        known or None,
        int(told) if told and told.isdigit() else len(body),
        body if kind == "response" else None,
    )


def _fields(head: bytes) -> Iterator[tuple[str, str]]:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        yield name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()


def archive(pages: DataFrame, writer: WarcWriter | None = None, reader: WarcReader | None = None) -> DataFrame:
    """``pages`` written to a new shared folder and read back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return (reader or WarcReader()).read((writer or WarcWriter()).write(pages, folder))
