"""WARC archives: write, read, and resolve equal payloads into revisit records.

Archives are gzip files of one member per record, written by the tasks into the
shared folder through ``pyarrow.fs``. A task names its files by a random id and
reports them in its rows, so files of lost or repeated attempts are never read.
The rows (a manifest, then headers and decisions) are Spark tables: headers are
shuffled by payload digest, the smallest source id of each digest keeps its
response, and the others become revisits of it in archives with fresh headers.
A file is closed at ``FILE_BYTES``, which bounds what one task rewrites.

Defined cases: a null payload is empty; payloads of at least ``min_bytes`` bytes
are compared, smaller ones stay responses; null source ids rank last and are
null when read back; of equal ids the first record in file order is the
response; a null or empty URL is left out; control characters and blanks in a
URL are percent-encoded; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import open_store

FILE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
MANIFEST_DDL = "path string, records long, bytes long"
HEADERS = pa.schema([("path", pa.string()), ("position", pa.int64()), ("source_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("refers_to_source", pa.int64())])
HEADERS_DDL = "path string, position long, source_id long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, refers_to_source long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def response_record(source_id: int | None, url: str | None, payload: bytes, record_id: str, date: str = DATE) -> bytes:
    block = _http(len(payload)) + payload
    return _record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Source-ID", "" if source_id is None else str(source_id))], block)


def revisit_record(header: dict, record_id: str, refers_to: str, refers_to_source: int | None, refers_to_uri: str | None, date: str = DATE) -> bytes:
    block = _http(header["payload_bytes"])
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(header["target_uri"])), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", _uri(refers_to_uri)), ("WARC-Refers-To-Date", date), ("WARC-Payload-Digest", f"sha1:{header['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Bytes", str(header["payload_bytes"])), ("X-Source-ID", "" if header["source_id"] is None else str(header["source_id"])), ("X-Refers-To-Source-ID", "" if refers_to_source is None else str(refers_to_source))], block)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    return fields, rest[:n]


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


class Writer:
    """Writes records into files of bounded size under one folder of any store that ``pyarrow.fs`` opens."""

    def __init__(self, folder: str):
        self.fs, self.folder = open_store(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.scheme = folder[: len(folder) - len(self.folder)] if folder.endswith(self.folder) else ""
        self.out, self.done, self.records, self.bytes = None, [], 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = self.fs.open_output_stream(self.name, compression=None), 0, 0
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.out.write(packed)
        self.records += 1
        self.bytes += len(packed)
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"path": self.scheme + self.name, "records": self.records, "bytes": self.bytes})
            self.out = None

    def manifest(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield pa.RecordBatch.from_pylist(self.done, schema=MANIFEST)
            self.done = []


def records(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, read in blocks; one record at a time is in memory."""
    store, name = open_store(path)
    with store.open_input_stream(name, compression=None) as file:
        unpacker, parts = zlib.decompressobj(31), []
        block = file.read(step)
        while block:
            parts.append(unpacker.decompress(block))
            block = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
            block = block or file.read(step)
        if parts:
            raise ValueError(f"{path} ends inside a record")


def header(path: str, position: int, raw: bytes) -> dict:
    """One row of HEADERS; a response's digest and size are those of the payload that was read."""
    fields, block = parse_record(raw)
    number = lambda k: int(fields[k]) if k in fields else None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = payload_digest(payload), len(payload)
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"{path}: the payload of record {position} does not match its digest")
    else:
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
    return {"path": path, "position": position, "source_id": number("X-Source-ID"), "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "target_uri": fields.get("WARC-Target-URI"), "payload_digest": digest, "payload_bytes": size, "refers_to": fields.get("WARC-Refers-To"), "refers_to_source": number("X-Refers-To-Source-ID")}


def _write_responses(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            for source_id, url, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                out.add(response_record(source_id.as_py(), url.as_py(), (payload.as_py() or "").encode(), new_id()))
            yield from out.manifest()
        out.close()
        yield from out.manifest()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, source_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write every row as a response record under ``folder``; returns the manifest, already materialised."""
    from ..runtime import persist

    rows = pages.select(F.col(source_id).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string"))
    return persist(spark, rows.mapInArrow(_write_responses(folder), MANIFEST_DDL), "warc-manifest")


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            for position, raw in enumerate(records(path)):
                rows.append(header(path, position, raw))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=HEADERS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=HEADERS)


def read_headers(manifest: DataFrame, tasks: int) -> DataFrame:
    """One row per record of the archives in ``manifest``, which are dealt over ``tasks`` tasks."""
    return manifest.select("path").repartition(tasks, "path").mapInArrow(_read_headers, HEADERS_DDL)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add what each record revisits (``to_*``, null for responses). Both sides of the join come from one shuffle by digest at most; a hot digest's rows can be split."""
    compared = headers.where(F.col("payload_bytes") >= min_bytes)
    first = (
        compared.groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct(F.col("source_id").isNull().alias("unknown"), "source_id", "path", "position", "record_id", "target_uri")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("first.path").alias("_path"), F.col("first.position").alias("_position"), F.col("first.record_id").alias("to_record"), F.col("first.source_id").alias("to_source"), F.col("first.target_uri").alias("to_uri"))
    )
    joined = headers.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    revisits = F.col("_digest").isNotNull() & ~((F.col("path") == F.col("_path")) & (F.col("position") == F.col("_position")))
    return joined.select(*HEADERS.names, *[F.when(revisits, F.col(c)).alias(c) for c in ("to_record", "to_source", "to_uri")])


def _fresh_id(old: str) -> str:
    """The id of a record in the deduplicated archives, known from its id in the first ones."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, old)}>"


def _rewrite(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, source, at = Writer(folder), None, None, -1
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, source, at = row["path"], records(row["path"]), -1
                while at < row["position"]:
                    raw, at = next(source), at + 1
                if row["to_record"] is None:
                    payload = parse_record(raw)[1].partition(b"\r\n\r\n")[2]
                    out.add(response_record(row["source_id"], row["target_uri"], payload, _fresh_id(row["record_id"]), date))
                else:
                    out.add(revisit_record(row, _fresh_id(row["record_id"]), _fresh_id(row["to_record"]), row["to_source"], row["to_uri"], date))
            yield from out.manifest()
        out.close()
        yield from out.manifest()

    return run


def write_deduplicated(spark: SparkSession, resolved: DataFrame, folder: str, tasks: int, date: str = DATE) -> DataFrame:
    """Rewrite the archives that ``resolved`` describes, one file at a time; returns the new manifest, already materialised."""
    from ..runtime import persist

    columns = ["path", "position", "source_id", "record_id", "target_uri", "payload_digest", "payload_bytes", "to_record", "to_source", "to_uri"]
    ordered = resolved.select(columns).repartition(tasks, "path").sortWithinPartitions("path", "position")
    return persist(spark, ordered.mapInArrow(_rewrite(folder, date), MANIFEST_DDL), "warc-deduplicated")


def deduplicate_archives(spark: SparkSession, manifest: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Read archives, resolve revisits, write deduplicated archives under ``folder``; returns their manifest."""
    from ..runtime import discard, persist

    tasks = archive_tasks(manifest)
    headers = persist(spark, read_headers(manifest, tasks), "warc-headers")
    final = write_deduplicated(spark, resolve_revisits(headers, min_bytes), folder, tasks)
    discard(headers)
    return final


def archive_tasks(manifest: DataFrame) -> int:
    """As many tasks as files, up to 100,000."""
    return max(1, min(100_000, manifest.count()))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, deduplicate the archives, and read the new ones back."""
    from ..runtime import discard, drop_scratch, scratch_path, ship, table

    ship(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    first = write_archives(spark, pages, folder)
    final = deduplicate_archives(spark, first, scratch_path(spark, "warc"))
    discard(first)
    drop_scratch(spark, folder)  # the result is read from the deduplicated archives, which stay
    return read_headers(final, archive_tasks(final)).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_source").alias("refers_to"))


#: DuckDB has no base32: the digest's hexadecimal digits are regrouped from 4 to 5 bits.
OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT) AS g FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[CAST(j // 4 + 1 AS BIGINT)] >> (15 - 5 * (j % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM b
"""
