"""Web archives: a writer with one gzip member per record, and a sequential reader.

The reader takes an archive in small blocks, unpacks one gzip member after the other, takes the
header block and then exactly as many bytes as Content-Length says, and compares the digests of
block and payload. It never holds more than one record.

Of records with equal payloads (SHA-256 and length) of at least ``min_bytes`` the one with the
largest page id is stored in full, the others as revisits that name it.

Archives are written to the folder all executors share (any place pyarrow's file systems
reach), each attempt of a task under names of its own. The list of archives that count is a table
which Spark commits; archives of lost attempts are in no list.

Defined results: null html is an empty payload; a null url is written as an empty target; a null
page id is smaller than any other; of repeated rows exactly one is stored in full and the
others refer to the id they have in common. An empty table gives no archives and no rows. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches
from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage, new_table_path

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Packed bytes that a reading task gets at most, roughly, where there are many archives.
READ_BYTES = 256 << 20
_BLOCK = 1 << 16
_VERSION = "WARC/1.1"
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_END = b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class CorruptRecord(ValueError):
    """An archive that breaks its framing or does not match its digests."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def record_member(page_id: int | None, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` is set) keeps the HTTP header only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to else http + payload
    lines = [
        _VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS | 16)
    return packer.compress("\r\n".join(lines).encode() + _HTTP_END + block + _HTTP_END) + packer.flush()


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces of its content; a member must be read to its end."""
    held = stream.read(_BLOCK)

    def content() -> Iterator[bytes]:
        nonlocal held
        unpacker = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while True:
            out = unpacker.decompress(held, _BLOCK)
            held = unpacker.unconsumed_tail
            if unpacker.eof:
                held = unpacker.unused_data
                if out:
                    yield out
                return
            if out:
                yield out
            elif not held:
                held = stream.read(_BLOCK)
                if not held:
                    raise CorruptRecord("an archive ends inside a record")

    while held or (held := stream.read(_BLOCK)):
        yield content()


class _Framed:
    """Reads by length from the pieces of one member."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            raise CorruptRecord("a record is shorter than its framing says")
        self.held += piece

    def until(self, end: bytes) -> bytes:
        searched = 0
        while (at := self.held.find(end, max(0, searched - len(end)))) < 0:
            searched = len(self.held)
            self._more()
        return self._take(at + len(end))

    def exactly(self, length: int) -> bytes:
        while len(self.held) < length:
            self._more()
        return self._take(length)

    def rest(self) -> bytes:
        return bytes(self.held) + b"".join(self.pieces)

    def _take(self, length: int) -> bytes:
        taken = bytes(self.held[:length])
        del self.held[:length]
        return taken


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode().rstrip("\r\n").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order; stops with an error at the first broken one."""
    for pieces in _members(stream):
        frame = _Framed(pieces)
        head = frame.until(_HTTP_END)
        if not head.startswith(b"WARC/1."):
            raise CorruptRecord("a member does not begin with a WARC record")
        headers = _fields(head)
        block = frame.exactly(int(headers["content-length"]))
        if frame.rest() != _HTTP_END:
            raise CorruptRecord("a record is longer than its framing says")
        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise CorruptRecord(f"block digest of {headers['warc-record-id']}")
        http, _, payload = block.partition(_HTTP_END)
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise CorruptRecord(f"payload digest of {headers['warc-record-id']}")
        yield Record(headers, _fields(http), payload)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with scheme and host, as Spark's own file systems understand it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def with_targets(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the record a page revisits, null if it is stored in full.

    The largest id of each payload is found without the payloads. These then meet it by payload and
    id, so that a payload with very many copies spreads over the tasks; only rows that repeat
    both share a key, and the first of them counts as the one.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"),
    ).withColumns({
        "same": F.concat_ws(":", F.octet_length("payload"), F.sha2("payload", 256)),
        "id_key": F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
    })
    ids = cut_lineage(rows.groupBy("same", "id_key").agg(F.max("page_id").alias("id")), "payload-ids")
    tops = cut_lineage(ids.groupBy("same").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")), "payload-tops")
    targets = lookup_join(ids, tops.drop("n"), ["same"], counts=tops, spread=["id_key"]).select("same", "id_key", "top")
    repeats = Window.partitionBy("same", "id_key").orderBy("url")
    met = rows.withColumn("nth", F.row_number().over(repeats)).join(targets, ["same", "id_key"])
    stored = (F.col("page_id").eqNullSafe(F.col("top")) & (F.col("nth") == 1)) | (F.octet_length("payload") < min_bytes)
    uri = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("top").cast("string"), F.lit("none")), F.lit(">"))
    return met.select("page_id", "url", "payload", F.when(~stored, uri).alias("refers_to"))


_LIST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages to archives below ``folder``; gives the committed list of archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            store, base = _open(folder)
            store.create_dir(base, recursive=True)
            prefix = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            out, name, records, size, number = None, "", 0, 0, 0
            for page_id, url, payload, refers_to in rows_of(batches):
                if out is None:
                    name = f"{prefix}-{number:04d}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    records, size, number = 0, 0, number + 1
                member = record_member(page_id, url, payload, refers_to)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield f"{folder}/{name}", records, size
            if out is not None:
                out.close()
                yield f"{folder}/{name}", records, size

        return batched(each(), _LIST)

    folder = qualified(pages.sparkSession, folder)
    small_batches(pages.sparkSession)
    return cut_lineage(
        with_targets(pages, min_bytes).mapInArrow(run, "archive string, records long, bytes long"), "archives"
    )


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
_READ_SPARK = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives; each archive is read by one task.

    ``payload`` is null for revisits, and for all records unless ``payloads``. The archives are dealt over tasks of some
    archives' bytes each, and over as many tasks as there are cores at least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for name, expected in rows_of(batches):
                store, path = _open(name)
                seen = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_archive(stream):
                        seen += 1
                        yield _row(record, payloads)
                if seen != expected:
                    raise CorruptRecord(f"{name}: {seen} records, {expected} were written")

        return batched(each(), _READ, 32 if payloads else 256)

    small_batches(archives.sparkSession)
    count, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = archives.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(4 * cores, size // READ_BYTES)))
    # Adaptive execution does not merge a number of partitions that is given; rows are dealt one by one.
    names = archives.select("archive", "records").repartition(tasks)
    return names.mapInArrow(run, _READ_SPARK)


def _row(record: Record, payloads: bool) -> tuple:
    headers = record.headers
    kind, target = headers["warc-type"], headers.get("warc-refers-to")
    return (
        page_of(headers["warc-record-id"]), headers["warc-target-uri"], int(record.http["content-length"]),
        headers["warc-payload-digest"].removeprefix("sha1:"), kind, page_of(target) if target else None,
        record.payload if payloads and kind == "response" else None,
    )


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """Revisits among ``records`` whose response is missing, or has another payload digest than they name.

    Responses are told by page id and digest; a page id that is null stands for itself.
    """
    key = F.concat_ws(":", "payload_digest", F.coalesce(F.col("of").cast("string"), F.lit("none")))
    revisits = records.filter("record_type = 'revisit'").withColumn("of", F.col("refers_to")).withColumn("target", key)
    stored = records.filter("record_type = 'response'").withColumn("of", F.col("page_id")).select(key.alias("target")).distinct()
    return lookup_join(revisits, stored, ["target"], "left_anti").drop("target", "of")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return new_table_path(spark, "warc")
