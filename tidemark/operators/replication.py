"""Replicas: fan-out, parked writes, majority repair, failover reads and quorums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quorum_size
from ..types import HINT
from .placement import Ring


def fan_out(mutations: DataFrame, ring: Ring, replicas: int, key: str = "key") -> DataFrame:
    """One row per mutation and owner: owner, place (0 is the primary) and role."""
    rows = mutations.select("*", F.posexplode(ring.owners(F.col(key), max(replicas, 1))).alias("place", "owner"))
    return rows.withColumn("role", F.when(F.col("place") == 0, "primary").otherwise("replica"))


def split_by_liveness(fanned: DataFrame, members: DataFrame) -> DataFrame:
    """Add ``parked``: whether the owner is not an alive member, so that the write waits as a hint."""
    alive = members.where("status = 'alive'").select(F.col("node_id").alias("owner"), F.lit(True).alias("_alive"))
    return fanned.join(alive, "owner", "left").withColumn("parked", F.col("_alive").isNull()).drop("_alive")


def hints(fanned: DataFrame, members: DataFrame) -> DataFrame:
    """Parked writes: target_node and the mutation's columns."""
    return split_by_liveness(fanned, members).where("parked").drop("parked", "place", "role").withColumnRenamed("owner", "target_node")


def pending(parked: DataFrame) -> DataFrame:
    return parked.groupBy("target_node").agg(F.count(F.lit(1)).alias("n"))


def replay_hints(parked: DataFrame, recovered: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feed with the hints of recovered nodes, hints that stay). Order comes from (ts, seq), so an old put never wins."""
    back = recovered.select(F.col("node_id").alias("target_node"))
    ready = parked.join(back, "target_node", "left_semi")
    return feed.unionByName(ready.select(feed.columns)), parked.join(back, "target_node", "left_anti")


class HintStore:
    """Parked writes in a folder: added as rows, taken off by the ids of those delivered. ``seq`` and ``target_node`` identify a hint."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = HINT):
        self.spark, self.folder, self.schema = spark, folder, schema

    def add(self, parked: DataFrame) -> None:
        parked.write.mode("append").parquet(f"{self.folder}/parked")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}") if there else self.spark.createDataFrame([], schema)

    def waiting(self) -> DataFrame:
        """Hints that were not delivered."""
        return self._read("parked", self.schema).join(self._read("delivered", "target_node string, seq long"), ["target_node", "seq"], "left_anti")

    def replay(self, recovered: DataFrame, deliver: Callable[[DataFrame], None]) -> int:
        """Hand the hints of recovered nodes (node_id) to ``deliver``; what it takes without failing is off the store. How many those were."""
        from ..runtime import discard, persist

        ready = self.waiting().join(recovered.select(F.col("node_id").alias("target_node")), "target_node", "left_semi")
        ready = persist(self.spark, ready.orderBy("ts", "seq"), "hints")
        n = ready.count()
        if n:
            deliver(ready)
            ready.select("target_node", "seq").write.mode("append").parquet(f"{self.folder}/delivered")
        discard(ready)
        return n


def majority(answers: DataFrame, key: str = "key", value: str = "value", place: str = "pos") -> DataFrame:
    """The most frequent value of each key; among equals the one that was seen first. Counts are combined before the shuffle."""
    counts = answers.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(place).alias("first_seen"))
    best = F.max_by(F.struct(F.col(value).alias("v"), "votes"), F.struct("votes", -F.col("first_seen")))
    return counts.groupBy(key).agg(best.alias("best")).select(key, F.col("best.v").alias("canonical"), F.col("best.votes").alias("votes"))


def divergent(answers: DataFrame, key: str = "key", value: str = "value", place: str = "pos") -> DataFrame:
    """Answers that differ from their key's majority, with the value that repairs them."""
    return answers.join(majority(answers, key, value, place).drop("votes"), key).where(~F.col(value).eqNullSafe(F.col("canonical")))


def read_with_failover(owned: DataFrame, members: DataFrame, stored: DataFrame, key: str = "key", value: str = "value", local: str | None = None) -> DataFrame:
    """For (key, owner, place) rows the value of the first alive owner that holds the key, not deleted; null where none does. An owner named ``local`` is asked first."""
    if local is not None:
        owned = owned.withColumn("place", F.when(F.col("owner") == local, -1).otherwise(F.col("place")))
    held = split_by_liveness(owned, members).where(~F.col("parked")).join(stored.select(key, F.col("node_id").alias("owner"), value), [key, "owner"])
    first = held.groupBy(key).agg(F.min_by(F.struct("owner", value), "place").alias("first")).select(key, F.col("first.owner").alias("served_by"), F.col(f"first.{value}").alias(value))
    return owned.select(key).distinct().join(first, key, "left")


def quorum_reached(acks: DataFrame, level: Column | str, replicas: int, key: str = "key") -> DataFrame:
    """For (key, acked) rows whether enough replicas acknowledged: acks, required and satisfied."""
    level = F.lit(level) if isinstance(level, str) else level
    counts = acks.groupBy(key).agg(F.sum(F.col("acked").cast("long")).alias("acks"))
    return counts.withColumn("required", quorum_size(level, F.lit(replicas))).withColumn("satisfied", F.col("acks") >= F.col("required"))


def quorum_metrics(outcomes: DataFrame) -> DataFrame:
    """Counters from rows of (kind: read, write or repair; satisfied)."""
    count = lambda kind, ok: F.count(F.when((F.col("kind") == kind) & (F.col("satisfied") == ok), 1))
    return outcomes.agg(count("read", True).alias("successful_reads"), count("write", True).alias("successful_writes"), count("read", False).alias("failed_reads"), count("write", False).alias("failed_writes"), F.count(F.when(F.col("kind") == "repair", 1)).alias("read_repairs"))
