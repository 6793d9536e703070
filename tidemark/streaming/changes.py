"""Streams: folding a change log into published snapshots, keeping an index, draining hints, detecting failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import changelog
from ..operators.documents import index_changes, latest
from ..operators.replication import HintStore
from ..types import CorruptRecord


def fold_stream(spark: SparkSession, feed: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Fold a streaming feed into snapshots with tombstones under ``folder``, one per micro-batch.

    A batch is merged into the snapshot that its predecessor published, so a batch that is run again after a failure
    starts from the same state; a later batch without a published snapshot is an error, not an empty state. Each batch writes the whole
    state, so ``every``, a trigger interval, sets how often that is; without it all that is there is processed once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        current = changelog.load_snapshot(spark, folder)
        if current is not None and int(current[1]) >= batch_id:
            return
        if current is None and batch_id > 0:
            raise CorruptRecord(f"no snapshot is published under {folder}, but batch {batch_id} is not the first")
        state = changelog.fold(batch, tombstones=True) if current is None else changelog.merge(current[0], batch)
        changelog.save_snapshot(spark, state, folder, f"snapshot-{batch_id:012d}", str(batch_id))

    writer = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def index_stream(documents: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], load: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Keep an index as documents change: for each micro-batch the entries to remove and to add.

    ``pairs_of`` gives a table's index entries, ``load`` the present entries of the documents of a table of ``_id``, ``apply`` stores the changes.
    """

    def maintain(batch: DataFrame, batch_id: int) -> None:
        apply(index_changes(load(batch.select("_id").distinct()), pairs_of(latest(batch))), batch_id)

    return documents.writeStream.foreachBatch(maintain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_hints(status_changes: DataFrame, hints: HintStore, deliver: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """When nodes turn alive, deliver what waits for them, oldest first, and take it off the store.

    A hint leaves the store after its delivery, so a failure between the two delivers it again; folding by (ts, seq) makes that harmless.
    """

    def drain(batch: DataFrame, _: int) -> None:
        hints.replay(batch.where("status = 'alive'").select("node_id").distinct(), deliver)

    return status_changes.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FailureDetector(StatefulProcessor):
    """Per node: alive on a heartbeat, suspect after a silence of more than the timeout, dead after twice that. Emits changes only."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, status string")

    def _row(self, key, status: str, at_ms: int) -> pd.DataFrame:
        return pd.DataFrame({"node_id": [key[0]], "status": [status], "at": [pd.Timestamp(at_ms, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["ts"].max().timestamp() * 1000) for frame in rows)
        ms, status = self.last.get() if self.last.exists() else (-1, "")
        if newest <= ms:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.timeout_ms + 1)
        self.handle.registerTimer(newest + 2 * self.timeout_ms + 1)
        self.last.update((newest, "alive"))
        if status != "alive":
            yield self._row(key, "alive", newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, status = self.last.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        new = "dead" if due > ms + 2 * self.timeout_ms else "suspect"
        if status != "dead" and new != status:
            self.last.update((ms, new))
            yield self._row(key, new, due)

    def close(self) -> None:
        pass


def detect_stream(heartbeats: DataFrame, timeout_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """Status changes (node_id, status, at) of a stream of (node_id, ts). Needs the RocksDB state store."""
    from ..runtime import ship

    ship(heartbeats.sparkSession)
    watched = heartbeats.withWatermark("ts", lateness).groupBy("node_id")
    return watched.transformWithStateInPandas(FailureDetector(timeout_ms), "node_id string, status string, at timestamp", "append", "eventtime")


def streaming_feed(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream, one at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)
