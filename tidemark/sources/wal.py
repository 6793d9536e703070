"""Binary change logs: record codec, a reader over any store that Spark reads, a Python data source, and a writer.

A record is a 22-byte little-endian header (magic, version, operation, time in
nanoseconds, key length, value length), key, value, and the CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import open_store
from ..types import WAL_RECORD, BadChecksum, BadMagic, BadVersion, CorruptRecord, TruncatedLog

#: Fixed values of the format.
MAGIC, VERSION = 0x4344574C, 1
OPERATIONS = {1: "put", 2: "delete"}
CODES = {v: k for k, v in OPERATIONS.items()}
HEADER = struct.Struct("<IBBqII")
MAX_PAYLOAD = 64 << 20
SEGMENT_BYTES = 16 << 20

_SCHEMA = pa.schema([("segment", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("ts_ns", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])


def encode(op: str, ts_ns: int, key: bytes, value: bytes = b"") -> bytes:
    if op not in CODES:
        raise CorruptRecord(f"unknown operation {op!r}")
    if len(key) + len(value) > MAX_PAYLOAD:
        raise CorruptRecord("record too large")
    body = HEADER.pack(MAGIC, VERSION, CODES[op], ts_ns, len(key), len(value)) + key + value
    return body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(op, ts_ns, key, value) of each record; ends cleanly only after a whole record."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise TruncatedLog(f"the log ends inside a header at byte {at}")
        magic, version, code, ts_ns, n_key, n_value = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise BadMagic(f"no record at byte {at}")
        if version != VERSION:
            raise BadVersion(f"version {version} at byte {at}")
        if code not in OPERATIONS or n_key + n_value > MAX_PAYLOAD:
            raise CorruptRecord(f"corrupt record at byte {at}")
        end = at + HEADER.size + n_key + n_value
        if len(data) < end + 4:
            raise TruncatedLog(f"the log ends inside a record at byte {at}")
        if zlib.crc32(memoryview(data)[at:end]) != struct.unpack_from("<I", data, end)[0]:
            raise BadChecksum(f"checksum mismatch at byte {at}")
        key = at + HEADER.size
        yield OPERATIONS[code], ts_ns, bytes(data[key : key + n_key]), bytes(data[key + n_key : end])
        at = end + 4


def _rows(segment: str, data: bytes, step: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = []
    for seq, (op, ts_ns, key, value) in enumerate(decode(data)):
        rows.append({"segment": segment, "seq": seq, "op": op, "ts_ns": ts_ns, "key": key, "value": value})
        if len(rows) == step:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield from _rows(path.rsplit("/", 1)[-1], content)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of the segments at ``path``. A segment is one task's work; rotation bounds its size."""
    from ..runtime import ship

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_decode_files, WAL_RECORD)


def as_feed(log: DataFrame) -> DataFrame:
    """Records as (seq, op, ts, key, value) with text keys and values; seq orders records of equal times by segment and place."""
    place = F.struct("segment", "seq")
    return log.select(place.alias("seq"), "op", F.timestamp_micros(F.expr("(ts_ns - pmod(ts_ns, 1000)) div 1000")).alias("ts"), F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"), "ts_ns")


def _encode_partition(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        task, written, parts, size, n = TaskContext.get().partitionId(), [], [], 0, 0

        def close() -> None:
            name = f"{base}/{task:06d}-{len(written):06d}-{uuid.uuid4().hex[:8]}.log"
            with store.open_output_stream(name, compression=None) as out:
                out.write(b"".join(parts))
            written.append({"path": name, "records": n, "bytes": size})

        for batch in batches:
            for row in batch.to_pylist():
                record = encode(row["op"], row["ts_ns"], row["key"], row["value"] or b"")
                if parts and size + len(record) > limit:
                    close()
                    parts, size, n = [], 0, 0
                parts.append(record)
                size, n = size + len(record), n + 1
        if parts:
            close()
        if written:
            yield pa.RecordBatch.from_pylist(written, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_log(feed: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write (op, ts_ns, key, value) rows, bytes or text, as segments of bounded size; returns the segments (path, records, bytes), already written.

    Read the segments of the returned paths: files of repeated attempts are not among them.
    """
    from ..runtime import persist, ship

    spark = feed.sparkSession
    ship(spark)
    rows = feed.select("op", "ts_ns", F.col("key").cast("binary"), F.col("value").cast("binary"))
    return persist(spark, rows.mapInArrow(_encode_partition(folder, segment_bytes), "path string, records long, bytes long"), "wal-segments")


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Segment]:
        from pyarrow import fs

        store, base = open_store(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            return [_Segment(self.path)]
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File)
        scheme = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        return [_Segment(scheme + f) for f in found]

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        store, name = open_store(partition.path)
        with store.open_input_stream(name, compression=None) as file:
            yield from _rows(name.rsplit("/", 1)[-1], file.read())


class LogDataSource(DataSource):
    """``spark.read.format("tidemark_log").load(folder)`` after ``spark.dataSource.register(LogDataSource)``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return WAL_RECORD

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options["path"])
