"""Folding change logs: the last writer of each key wins, in the total order (ts, seq)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ["key", "value", "version", "created_at", "updated_at", "deleted", "seq"]


def check_operations(feed: DataFrame) -> DataFrame:
    """The feed; evaluating it fails on an unknown operation."""
    known = F.col("op").isin("put", "delete")
    return feed.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))).cast("boolean")))


def fold(feed: DataFrame, tombstones: bool = False, semantics: str = "live") -> DataFrame:
    """State of every key after a feed of (seq, ts, op, key, value): one aggregation, combined before the shuffle.

    ``live``: version counts all mutations of the key and created_at is its
    first, deletes included. ``replay``: a delete ends a key's life, and
    both start anew with the next put; deleted keys are gone.
    """
    order = F.struct("ts", "seq")
    last = F.max_by(F.struct("op", "value", "ts", "seq"), order).alias("last")
    if semantics == "replay":
        # The last delete of each key, combined before the shuffle; a hot key's rows are then split in the join.
        gone = feed.where("op = 'delete'").groupBy(F.col("key").alias("_key")).agg(F.max(order).alias("_gone"))
        lives = feed.join(gone, F.col("key") == F.col("_key"), "left")
        feed = lives.where(F.col("_gone").isNull() | (F.struct("ts", "seq") > F.col("_gone"))).drop("_key", "_gone")
    elif semantics != "live":
        raise ValueError(f"unknown semantics {semantics!r}")
    state = feed.groupBy("key").agg(last, F.count(F.lit(1)).alias("version"), F.min("ts").alias("created_at"))
    deleted = F.col("last.op") == "delete"
    state = state.select("key", F.when(~deleted, F.col("last.value")).alias("value"), "version", "created_at", F.col("last.ts").alias("updated_at"), deleted.alias("deleted"), F.col("last.seq").alias("seq"))
    return state if tombstones else state.where(~F.col("deleted"))


def merge(snapshot: DataFrame, feed: DataFrame) -> DataFrame:
    """A snapshot with tombstones (columns STATE) and a feed of other records, earlier or later: of each key the last by (ts, seq) counts."""
    later = fold(feed, tombstones=True).select(*STATE)
    now = [F.col(c).alias(f"_{c}") for c in STATE]
    both = snapshot.select(*STATE).join(later.select(*now), F.col("key") == F.col("_key"), "full_outer")
    newer = F.col("_key").isNotNull() & (F.col("key").isNull() | (F.struct("_updated_at", "_seq") > F.struct("updated_at", "seq")))
    return both.select(
        F.coalesce("key", "_key").alias("key"),
        F.when(newer, F.col("_value")).otherwise(F.col("value")).alias("value"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("_version", F.lit(0))).alias("version"),
        F.least("created_at", "_created_at").alias("created_at"),
        F.greatest("updated_at", "_updated_at").alias("updated_at"),
        F.when(newer, F.col("_deleted")).otherwise(F.col("deleted")).alias("deleted"),
        F.when(newer, F.col("_seq")).otherwise(F.col("seq")).alias("seq"),
    )


def recover(snapshot: DataFrame, feed: DataFrame, since, tombstones: bool = False) -> DataFrame:
    """A snapshot that holds everything before ``since``, and the feed from ``since`` on (records at ``since`` count)."""
    state = merge(snapshot, feed.where(F.col("ts") >= since))
    return state if tombstones else state.where(~F.col("deleted"))


def save_snapshot(spark: SparkSession, state: DataFrame, folder: str, name: str, at: str, keep: int = 2) -> None:
    """Write a snapshot, then publish it by replacing a pointer file in one rename; readers see the old one until then.

    Of the snapshots published before, in order of name, the last ``keep`` - 1 stay, so that a reader that has just read the pointer finds its files.
    """
    state.write.mode("overwrite").parquet(f"{folder}/{name}")
    _write_text(spark, f"{folder}/CURRENT", json.dumps({"name": name, "at": at}))
    store, root = _store(spark, folder)
    older = sorted(s.getPath().getName() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName() < name)
    for old in older[: max(0, len(older) - keep + 1)]:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, old), True)


def _store(spark: SparkSession, folder: str):
    """The file system of a folder, and its path there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def log_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files of a log; 0 where there is none."""
    store, root = _store(spark, folder)
    return store.getContentSummary(root).getLength() if store.exists(root) else 0


def checkpoint(spark: SparkSession, log: str, folder: str, threshold: int, name: str, at: str) -> bool:
    """Take a snapshot of the log if it has ``threshold`` bytes or more (0 or less: always), on top of the published one. Whether it was taken."""
    size = log_bytes(spark, log)
    if size < threshold or not size:
        return False
    feed, current = spark.read.parquet(log).drop("segment"), load_snapshot(spark, folder)
    state = fold(feed, tombstones=True) if current is None else merge(current[0], feed.where(F.col("ts") >= F.lit(current[1]).cast(feed.schema["ts"].dataType)))
    save_snapshot(spark, state, folder, name, at)
    return True


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, str] | None:
    """The published snapshot and its time; None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    current = json.loads(spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0])
    return spark.read.parquet(f"{folder}/{current['name']}"), current["at"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed over it, so that at any time one of both is there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, configuration = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    temporary, final = fs.Path(f"{path}.new"), fs.Path(path)
    store = final.getFileSystem(configuration)
    out = store.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), configuration).rename(store.makeQualified(temporary), store.makeQualified(final), overwrite)


def append(feed: DataFrame, folder: str) -> None:
    """Append records to the log; the file committer makes each call whole or nothing. Old segments are dropped by folder."""
    feed.withColumn("segment", F.date_format("ts", "yyyyMMddHH")).write.mode("append").partitionBy("segment").parquet(folder)


def segments(spark: SparkSession, folder: str) -> list[str]:
    """The names of a log's segments, oldest first."""
    store, root = _store(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
    return sorted(n.removeprefix("segment=") for n in names if n.startswith("segment="))


def vacuum(spark: SparkSession, folder: str, before: str | None = None, most: int | None = None) -> int:
    """Drop old segments: those named below ``before``, which a snapshot covers, and the oldest beyond ``most``."""
    store, root = _store(spark, folder)
    names = segments(spark, folder)
    old = [n for k, n in enumerate(names) if (before is not None and n < before) or (most is not None and k < len(names) - most)]
    for name in old:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"segment={name}"), True)
    return len(old)
