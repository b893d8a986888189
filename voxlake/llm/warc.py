"""WARC archives with a Zstandard dictionary.

An archive is a leading skippable frame that holds the dictionary (itself compressed), then one Zstandard frame per record.
The dictionary is trained on the archive's own first records, so each archive can be read by itself and
any record by its offset. Records with equal payloads are written once; the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_dir, small_batches, stored

#: Of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
DICT_BYTES = 112_640
#: Raw bytes of an archive's first records that its dictionary is trained on; they are also what a task buffers at most, with one record.
SAMPLE_BYTES = 4 << 20
#: Raw bytes after which a new archive is begun.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Payloads of at least so many bytes are written once.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Tasks that read archives, at most; each takes one archive after the other.
MOST_TASKS = 20_000


def _record_id(page_id: int | None, n: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'row:{n}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str, n: str) -> bytes:
    """A record's bytes. A revisit has the HTTP header but no payload; digest and size are of the full payload in both."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, n)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, '')}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary; where the sample is too small to train on, its last bytes serve as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def _load(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class Writer:
    """Writes one archive. ``out`` is a writable file; nothing is written before the sample is full or the archive closed."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.level, self.waiting, self.raw, self.compressor = out, level, [], 0, None

    def add(self, rec: bytes) -> None:
        self.raw += len(rec)
        if self.compressor:
            self.out.write(self.compressor.compress(rec))
            return
        self.waiting.append(rec)
        if self.raw >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        trained = dictionary(self.waiting)
        frame = zstandard.ZstdCompressor(level=19).compress(trained)
        self.out.write(struct.pack("<II", DICT_MAGIC, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=_load(trained), write_content_size=True, write_checksum=True)
        for rec in self.waiting:
            self.out.write(self.compressor.compress(rec))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.out.close()


def read_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, one record in memory at a time."""
    head = f.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    raw = f.read(size)
    if len(raw) < size:
        raise ValueError("the archive ends inside its dictionary")
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unpack = zstandard.ZstdDecompressor(dict_data=_load(raw))
    rest, more = b"", True
    while True:
        one, parts, begun = unpack.decompressobj(), [], False
        while not one.eof:
            if not rest:
                rest = f.read(CHUNK)
                if not rest:
                    more = False
                    break
            begun = True
            parts.append(one.decompress(rest))
            rest = one.unused_data
        if not more:
            if begun:
                raise ValueError("the archive ends inside a record")
            return
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = tail[: int(fields["Content-Length"])]
        if tail[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, block


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, size, refers_to: of rows with equal payloads of at least ``least`` bytes, those whose page_id isn't the largest refer to it.

    Only payloads that occur more than once are looked up; rows are counted before they are dealt by digest, and the
    look-up is a plain equi-join, whose large keys Spark can split.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))
    groups = p.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "last")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return p.join(groups, ["digest", "size"], "left").select("page_id", "url", "html", "digest", "size", F.when(other, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``path``, a folder all executors can write to; returns the manifest (path, n_records, raw_bytes).

    Null html is an empty payload, a null url ``urn:page:<id>``. Payloads under ``LEAST_REVISIT`` bytes are always responses, as is every row
    that has the largest page_id of its payload; rows without a page_id refer to it like others. Repeated rows are archived each; an empty table
    gives an empty manifest. A task writes under a name of its attempt, and only the manifest's files count, so retried and speculative tasks do no harm.
    """

    small_batches(pages.sparkSession)

    def save(batches):
        where, base = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        made, writer, n = [], None, 0
        for batch in batches:
            for page_id, url, html, digest, size, refers_to in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "size", "refers_to")), strict=True):
                if writer is None:
                    name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.zst"
                    writer, n = Writer(where.open_output_stream(name)), 0
                writer.add(record(page_id, url, html.encode(), digest, size, refers_to, refers_to is not None, date, f"{name}:{n}"))
                n += 1
                if writer.raw >= archive_bytes:
                    writer.close()
                    made.append((name, n, writer.raw))
                    writer = None
        if writer is not None:
            writer.close()
            made.append((name, n, writer.raw))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["path", "n_records", "raw_bytes"])

    return stored(with_revisits(pages).mapInArrow(save, "path string, n_records long, raw_bytes long"), "manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record of the manifest's archives.

    A response whose payload hasn't its digest is an error, as is an archive that ends inside a record or hasn't the records that the manifest (path, n_records) counts.
    """

    small_batches(manifest.sparkSession)

    def load(batches):
        where, _ = pafs.FileSystem.from_uri(path)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for name, n_records in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with where.open_input_stream(name) as f:
                    for fields, block in read_records(f):
                        n += 1
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload hasn't its digest")
                        number = lambda x: None if x is None else int(x)
                        rows.append((number(fields.get("X-Page-ID")), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID")), payload))
                        size += len(block)
                        if size > CHUNK * 4:
                            yield pack(rows)
                            rows, size = [], 0
                if n != n_records:
                    raise ValueError(f"{name}: {n} records of {n_records}")
                if rows:
                    yield pack(rows)

    # a path is few bytes, an archive is many: the number keeps Spark from merging the partitions by the paths' size
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("path", "n_records").repartition(tasks).mapInArrow(load, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    path = new_dir(pages.sparkSession, "warc")
    return read(write(pages, path), path)
