"""Membership tables: merging, failure detection, leaders, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compare_versions, since_micros, status_rank


def merge_states(local: DataFrame, remote: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Two tables of nodes as one: a higher version wins whole; with equal versions the newer heartbeat counts, the status may only
    rise, and that with a heartbeat at least as new, and a different address that is not empty is taken. Columns ``by`` tell several tables apart."""
    r = remote.select(*[F.col(c).alias(f"r_{c}") for c in (*by, "node_id", "address", "status", "last_heartbeat", "version")])
    same_row = F.col("node_id") == F.col("r_node_id")
    for c in by:
        same_row = same_row & (F.col(c) == F.col(f"r_{c}"))
    both = local.join(r, same_row, "full_outer")
    order = compare_versions(F.coalesce("r_version", F.lit("")), F.coalesce("version", F.lit("")))
    new, old = F.col("node_id").isNull(), F.col("r_node_id").isNull()
    take = new | (~old & (order > 0))
    same = ~new & ~old & (order == 0)
    rises = same & (F.col("r_last_heartbeat") >= F.col("last_heartbeat")) & (status_rank(F.col("r_status")) > status_rank(F.col("status")))
    moves = same & (F.col("r_address") != "") & (F.col("r_address") != F.col("address"))
    pick = lambda c, also=F.lit(False): F.when(take | also, F.col(f"r_{c}")).otherwise(F.col(c))
    return both.select(
        *[F.coalesce(c, f"r_{c}").alias(c) for c in by],
        F.coalesce("node_id", "r_node_id").alias("node_id"),
        pick("address", moves).alias("address"),
        pick("status", rises).alias("status"),
        F.when(take, F.col("r_last_heartbeat")).when(same, F.greatest("last_heartbeat", "r_last_heartbeat")).otherwise(F.col("last_heartbeat")).alias("last_heartbeat"),
        pick("version").alias("version"),
    )


def heartbeats(events: DataFrame, node: str = "node_id", ts: str = "ts") -> DataFrame:
    """The last heartbeat of each node."""
    return events.groupBy(node).agg(F.max(ts).alias("last_heartbeat"))


def next_status(status: Column, elapsed: Column, timeout: Column | int) -> Column:
    """One tick of the detector: alive turns suspect after more than the timeout, suspect dead after more than twice that; dead stays."""
    return F.when((status == "alive") & (elapsed > timeout), "suspect").when((status == "suspect") & (elapsed > timeout * 2), "dead").otherwise(status)


def settled_status(elapsed: Column, timeout: int) -> Column:
    """What enough ticks lead to."""
    return F.when(elapsed > 2 * timeout, "dead").when(elapsed > timeout, "suspect").otherwise("alive")


def detect(nodes: DataFrame, now: Column, timeout_us: int, local: str | None = None) -> DataFrame:
    """One tick over a table of nodes; the local node never changes."""
    changed = next_status(F.col("status"), since_micros(now, F.col("last_heartbeat")), F.lit(timeout_us))
    return nodes.withColumn("status", changed if local is None else F.when(F.col("node_id") == local, F.col("status")).otherwise(changed))


def leader(nodes: DataFrame, exclude: str | None = None) -> DataFrame:
    """The smallest id, as text, among alive nodes; null if there is none."""
    alive = nodes.where("status = 'alive'")
    return (alive if exclude is None else alive.where(F.col("node_id") != exclude)).agg(F.min("node_id").alias("leader"))


def peers(nodes: DataFrame, fanout: int, local: str, seed: int) -> DataFrame:
    """At most ``fanout`` others that are not dead, by a seeded hash of their id."""
    others = nodes.where((F.col("node_id") != local) & (F.col("status") != "dead"))
    return others.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(fanout)


def join_cluster(nodes: DataFrame, joining: DataFrame) -> DataFrame:
    """Joining nodes are alive; they replace rows of the same id."""
    return nodes.join(joining, "node_id", "left_anti").unionByName(joining.withColumn("status", F.lit("alive")), allowMissingColumns=True)


def leave_cluster(nodes: DataFrame, leaving: DataFrame) -> DataFrame:
    return nodes.join(leaving, "node_id", "left_anti")


def node_list(nodes: DataFrame) -> DataFrame:
    """All ids of a membership table, in order."""
    return nodes.select("node_id").distinct().orderBy("node_id")


def answer_gossip(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An inbound exchange: the merged table, and the reply, which is a snapshot of it."""
    merged = merge_states(local, remote)
    return merged, merged


def gossip_cycle(views: DataFrame, fanout: int, seed: int) -> DataFrame:
    """One tick of every node that is not dead to itself. ``views`` has a row for each observer and node that it knows.

    In each of ``fanout`` steps the nodes are put into a seeded order and every one exchanges whole tables with the next: that one
    merges what it gets and replies with the outcome, which the sender merges. So each node sends and receives once a step, and a
    step is two joins, whatever the number of nodes.
    """
    awake = views.where((F.col("observer") == F.col("node_id")) & (F.col("status") != "dead")).select("observer")
    columns = ["observer", "node_id", "address", "status", "last_heartbeat", "version"]
    for step in range(fanout):
        # Next in the order of a hash, the first after the last; one row per node meets here, not the views.
        order = Window.orderBy(F.xxhash64("observer", F.lit(seed), F.lit(step)), "observer")
        pairs = awake.select("observer", F.coalesce(F.lead("observer").over(order), F.first("observer").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("peer")).where("observer != peer")
        sent = views.join(pairs, "observer").select(F.col("peer").alias("observer"), *columns[1:])
        received = merge_states(views, sent, by=("observer",))
        replies = received.join(pairs.select(F.col("peer").alias("observer"), F.col("observer").alias("sender")), "observer").select(F.col("sender").alias("observer"), *columns[1:])
        views = merge_states(received, replies, by=("observer",)).select(*columns)
    return views
