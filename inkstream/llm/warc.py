"""WARC archives with an embedded Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary trained on
that archive's own records; every record follows as one frame compressed with
it, so records stay addressable one by one. A record whose payload equals that
of a page with a smaller id is a ``revisit`` of that page.

Scale: duplicates are found on (digest, id) rows only; payloads are shuffled once
by id. A task buffers at most ``archive_bytes`` of records (or one record, if that
is longer). An archive's name holds the attempt that wrote it, and only the manifest says which archives count: it is
written by Spark, so it lists one attempt of each task. Nothing is moved or overwritten, which some stores
refuse; what a lost or speculative attempt wrote is left unread. Files go through ``pyarrow.fs``, to
any file system it knows, in the folder given.

The dictionary is trained on at most ``sample_bytes`` of evenly spaced records of
its archive. This bound touches the compression ratio only, never the content.
With too few records to train on, the sample itself becomes a raw dictionary.

Edge cases: null payload is empty; empty payloads count as equal payloads; a null
page id is never a revisit and never referred to; repeated rows of one page id with
the payload's smallest id are all responses; null urls give no target header, and
control characters in urls are percent-encoded; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import materialize, text_batches, tidy, utf8

SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
NO_ID = uuid.UUID(int=(1 << 128) - 1)
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def id_to_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{NO_ID if page_id is None else uuid.UUID(int=page_id & (1 << 64) - 1)}>"


def urn_to_id(urn: str | None) -> int | None:
    if not urn:
        return None
    n = uuid.UUID(urn[10:-1]).int
    return None if n == NO_ID.int else n - (1 << 64) if n >> 63 else n


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP header, with the full length, and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {id_to_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {id_to_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def train(records: list[bytes], dict_bytes: int, sample_bytes: int):
    """A dictionary from evenly spaced records."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // sample_bytes)
    sample = [r[:131072] for r in records[::step]]
    try:
        if len(sample) >= 16:
            return zstd.train_dictionary(min(dict_bytes, max(1024, sum(map(len, sample)) // 8)), sample, k=1024, d=8)
    except zstd.ZstdError:
        pass
    return zstd.ZstdCompressionDict(b"".join(sample)[:dict_bytes] or b"WARC/1.1", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], level: int = 3, dict_bytes: int = 65536, sample_bytes: int = 2_000_000) -> bytes:
    """An archive: dictionary in a skippable frame, then one frame for each record."""
    import zstandard as zstd

    d = train(records, dict_bytes, sample_bytes)
    raw = d.as_bytes()
    c = zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(c.compress, records)])


def unpack(stream) -> Iterator[bytes]:
    """Records of an archive, read as a stream, one frame at a time."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = stream.read(size)
    d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if raw[:4] == DICT_MAGIC else zstd.DICT_TYPE_RAWCONTENT)
    ctx, rest, obj, out = zstd.ZstdDecompressor(dict_data=d), b"", None, []
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            if obj is not None:
                raise ValueError("the archive ends inside a record")
            return
        obj = obj or ctx.decompressobj()
        out.append(obj.decompress(rest))
        rest = obj.unused_data
        if obj.eof:
            yield b"".join(out)
            obj, out = None, []


def parse(rec: bytes) -> tuple:
    """Fields of a record as in RECORDS; a response's payload is checked against its digest."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != full or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return urn_to_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), full, digest, kind, urn_to_id(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the rows whose payload a smaller page id holds."""
    rows = pages.select("page_id", "digest").where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to")
    return rows.join(first, "digest").where("page_id > refers_to").distinct()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 32_000_000, level: int = 3, dict_bytes: int = 65536, sample_bytes: int = 2_000_000, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write all rows as ``.warc.zst`` files; returns the manifest: path, records, bytes."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    refs = revisits(rows.select("page_id", "digest", F.length("payload").alias("n")), min_revisit_bytes)
    ready = rows.join(refs, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    ready = ready.sortWithinPartitions("page_id", "digest", "url")  # a task that runs again cuts the same archives

    run = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        there.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        total, n = 0, 0
        made: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal total, n
            name = f"part-{task.partitionId():05d}-{n:04d}-{task.taskAttemptId()}-{run}.warc.zst"
            data = pack(held, level, dict_bytes, sample_bytes)
            with there.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            made.append((f"{folder}/{name}", len(held), len(data)))
            held.clear()
            total, n = 0, n + 1

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to = (b.column(k)[i].as_py() for k in range(5))
                rec = record(page_id, url, payload, base64.b32encode(digest).decode(), refers_to, date)
                if held and total + len(rec) > archive_bytes:
                    flush()
                held.append(rec)
                total += len(rec)
        if held:
            flush()
        yield pa.record_batch([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialize(ready.mapInArrow(tidy(write), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives that a manifest lists, one archive a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                there, at = fs.FileSystem.from_uri(path)
                with there.open_input_stream(at, compression=None) as f:
                    rows, held = [], 0
                    for rec in unpack(f):
                        row = parse(rec)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(rec) if with_payload else 100
                        if held > 4_000_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 100_000)).mapInArrow(tidy(read), RECORDS)
