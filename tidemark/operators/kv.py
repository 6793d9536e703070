"""Key-value views: point reads, ordered scans, statistics, and writes as rows of a change log."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..types import AlreadyOpen, CursorClosed, InvalidKey, KeyNotFound, NilValue, NotOpen, UnknownEngine


def _check(key: str) -> str:
    if not key:
        raise InvalidKey("invalid key")
    return key


class Cursor:
    """Steps through a scan's rows, fetched partition by partition."""

    def __init__(self, rows: DataFrame):
        self._rows: Iterator[Row] | None = rows.toLocalIterator()
        self.record: Row | None = None
        self.error: Exception | None = None

    def next(self) -> bool:
        if self._rows is None:
            self.error = CursorClosed("cursor closed")
            return False
        self.record = next(self._rows, None)
        return self.record is not None

    def close(self) -> None:
        self._rows = None


class KeyValueView:
    """A DataFrame of key, value, deleted and metadata, one row per key."""

    def __init__(self, df: DataFrame, key: str = "key", deleted: str | None = "deleted", value: str = "value"):
        self.df, self.key, self.value, self.deleted = df, key, value, deleted
        self.live = df if deleted is None else df.where(~F.col(deleted))

    def get(self, key: str) -> DataFrame:
        return self.live.where(F.col(self.key) == _check(key))

    def get_raw(self, key: str) -> DataFrame:
        """Like ``get``, deleted keys included."""
        return self.df.where(F.col(self.key) == _check(key))

    def read(self, key: str) -> Row:
        row = self.get(key).first()
        if row is None:
            raise KeyNotFound(key)
        return row

    def exists(self, key: str) -> bool:
        return not self.get(key).isEmpty()

    def existing(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (a column named like the view's key) that are live."""
        return keys.join(self.live, self.key, "left_semi")

    def absent(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.live, self.key, "left_anti")

    def scan(self, prefix: str = "", start: str = "", end: str = "", limit: int = 0, reverse: bool = False) -> DataFrame:
        """Live rows by key; start is included, end is not, empty bounds are none, limits below 1 are none."""
        column, rows = F.col(self.key), self.live
        if prefix:
            rows = rows.where(column.startswith(prefix))
        if start:
            rows = rows.where(column >= start)
        if end:
            rows = rows.where(column < end)
        rows = rows.orderBy(column.desc() if reverse else column.asc())
        return rows.limit(limit) if limit > 0 else rows

    def cursor(self, **options) -> Cursor:
        return Cursor(self.scan(**options))

    def stats(self) -> DataFrame:
        """keys (deleted ones included), live_keys, bytes of keys and live values."""
        size = F.octet_length(F.col(self.key)).cast("long") + F.coalesce(F.octet_length(F.col(self.value)).cast("long"), F.lit(0))
        live = F.lit(True) if self.deleted is None else ~F.col(self.deleted)
        return self.df.agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(live, 1)).alias("live_keys"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))

    def unexpired(self, now: datetime, ttl: str = "ttl_ms", updated: str = "updated_at") -> KeyValueView:
        """Without rows whose time to live is over; rows without one stay."""
        over = F.col(ttl).isNotNull() & (F.unix_micros(F.col(updated)) + F.col(ttl) * 1000 <= F.unix_micros(F.lit(now)))
        return KeyValueView(self.df.where(~over), self.key, self.deleted, self.value)

    def puts(self, rows: DataFrame, ts, first_seq: int = 0) -> DataFrame:
        """Change-log rows that put (key, value) rows; evaluating them fails on empty keys and null values."""
        bad = F.when(F.length(self.key) == 0, F.raise_error(F.lit("invalid key"))).when(F.col(self.value).isNull(), F.raise_error(F.lit("nil value")))
        checked = rows.where(bad.cast("boolean").isNull())
        return checked.select((F.monotonically_increasing_id() + first_seq).alias("seq"), F.lit(ts).alias("ts"), F.lit("put").alias("op"), F.col(self.key).alias("key"), F.col(self.value).alias("value"))

    def deletes(self, keys: DataFrame, ts, first_seq: int = 0) -> DataFrame:
        """Change-log rows that delete keys, present or not."""
        return keys.select((F.monotonically_increasing_id() + first_seq).alias("seq"), F.lit(ts).alias("ts"), F.lit("delete").alias("op"), F.col(self.key).alias("key"), F.lit(None).cast("string").alias("value"))


_RECORD = "seq long, op string, ts timestamp, key string, value string"


class Store:
    """A change log folder with an open state: put, get, delete and scan through appended rows.

    Every call of ``write`` or ``write_rows`` is one append; many mutations belong into one ``write_rows``. Sequence numbers
    go on where the log ends, so that of writes with equal times the later one wins after a reopen too.
    """

    def __init__(self, spark, folder: str, engine: str = "parquet"):
        if engine not in ("parquet", "orc", "json"):
            raise UnknownEngine(engine)
        self.spark, self.folder, self.engine, self.is_open, self._seq = spark, folder, engine, False, 0
        self.opened_at: datetime | None = None
        self.replay_seconds = 0.0

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def open(self) -> Store:
        if self.is_open:
            raise AlreadyOpen(self.folder)
        began = datetime.now(UTC)
        self._seq = (self._rows().agg(F.max("seq")).first()[0] or 0) if self._exists() else 0
        self.is_open, self.opened_at = True, began
        self.replay_seconds = (datetime.now(UTC) - began).total_seconds()
        return self

    def close(self) -> None:
        self.is_open = False

    def health(self) -> dict:
        """Never fails, open or not."""
        return {"healthy": self.is_open, "message": "open" if self.is_open else "closed", "time": datetime.now(UTC).isoformat()}

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_RECORD).format(self.engine).load(self.folder)

    def _feed(self) -> DataFrame:
        if not self.is_open:
            raise NotOpen(self.folder)
        return self._rows() if self._exists() else self.spark.createDataFrame([], _RECORD)

    def view(self) -> KeyValueView:
        from .changelog import fold

        return KeyValueView(fold(self._feed(), tombstones=True))

    def statistics(self, snapshots: str | None = None) -> dict:
        """keys, live_keys, bytes, engine, version (of the last mutation), created, log_bytes, segments (files), replay_seconds and last_checkpoint."""
        from .changelog import load_snapshot, log_bytes

        rows = self._feed()
        last = rows.agg(F.max("seq").alias("version"), F.min("ts").alias("created")).first()
        published = None if snapshots is None else load_snapshot(self.spark, snapshots)
        found = self.view().stats().first().asDict() | {"engine": self.engine, "version": last["version"] or 0, "created": last["created"], "replay_seconds": self.replay_seconds}
        return found | {"log_bytes": log_bytes(self.spark, self.folder), "segments": len(rows.inputFiles()), "last_checkpoint": None if published is None else published[1]}

    def write(self, op: str, key: str, value: str | None, ts: datetime) -> None:
        if not self.is_open:
            raise NotOpen(self.folder)
        _check(key)
        if op == "put" and value is None:
            raise NilValue(key)
        self.write_rows(self.spark.createDataFrame([(op, ts, key, value)], "op string, ts timestamp, key string, value string"))

    def write_rows(self, rows: DataFrame) -> None:
        """Append mutations (op, ts, key, value); of rows with equal times any may count as the later one. Fails on empty keys and on puts of null."""
        if not self.is_open:
            raise NotOpen(self.folder)
        bad = F.when(F.coalesce(F.length("key"), F.lit(0)) == 0, F.raise_error(F.lit("invalid key"))).when((F.col("op") == "put") & F.col("value").isNull(), F.raise_error(F.lit("nil value")))
        checked = rows.select((F.monotonically_increasing_id() + self._seq + 1).alias("seq"), "op", F.col("ts").cast("timestamp").alias("ts"), "key", "value").where(bad.cast("boolean").isNull())
        checked.write.mode("append").format(self.engine).save(self.folder)
        self._seq = self._rows().agg(F.max("seq")).first()[0] or self._seq
