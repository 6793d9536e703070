"""Consistent hashing: which nodes own a key.

The ring is small (nodes times 100), lives on the driver and enters the plan as
array literals; owners are looked up by expressions, without joins or shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import crc32_key, vnode_hash
from ..types import RING_ENTRY

VNODES = 100


@dataclass(frozen=True)
class Ring:
    """Positions in ascending order, equal ones by node."""

    entries: tuple[tuple[int, str], ...]

    @classmethod
    def build(cls, nodes: Iterable[str], vnodes: int = VNODES) -> Ring:
        return cls(tuple(sorted((vnode_hash(n, i), n) for n in set(nodes) for i in range(vnodes))))

    @classmethod
    def of_members(cls, members: DataFrame, vnodes: int = VNODES) -> Ring:
        """The ring of the alive nodes of a membership table."""
        return cls.build([r["node_id"] for r in members.where("status = 'alive'").select("node_id").distinct().collect()], vnodes)

    def without(self, node: str) -> Ring:
        return Ring(tuple(e for e in self.entries if e[1] != node))

    @property
    def nodes(self) -> list[str]:
        return sorted({n for _, n in self.entries})

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.entries), RING_ENTRY)

    def owners_at(self, place: int, replicas: int) -> list[str]:
        """Distinct nodes from a place on, clockwise."""
        found: list[str] = []
        for k in range(len(self.entries)):
            node = self.entries[(place + k) % len(self.entries)][1]
            if node not in found:
                found.append(node)
                if len(found) == replicas:
                    break
        return found

    def _place(self, key: Column) -> Column:
        """Where the first position that is not below the key's hash stands, from 0; the first of all after the last."""
        # The ring is cut into 256 equal sectors; a key's sector tells where to search, so a lookup compares a few positions only.
        hashes = [h for h, _ in self.entries]
        starts = [sum(h < (sector << 24) for h in hashes) for sector in range(257)]
        widest = max(b - a for a, b in zip(starts, starts[1:], strict=False))
        h = crc32_key(key)
        sector = F.shiftright(h, 24).cast("int")
        start = F.element_at(F.array(*map(F.lit, starts)), sector + 1)
        near = F.slice(F.array(*[F.lit(x) for x in hashes]), start + 1, F.lit(max(widest, 1)))
        below = F.size(F.filter(near, lambda x: x < h))
        return (start + below) % len(hashes)

    def owner(self, key: Column) -> Column:
        """The node that owns a key; null for an empty ring or key."""
        if not self.entries:
            return F.lit(None).cast("string")
        nodes = F.array(*[F.lit(n) for _, n in self.entries])
        return F.when(F.length(key) > 0, F.element_at(nodes, self._place(key) + 1))

    def owners(self, key: Column, replicas: int) -> Column:
        """The first ``replicas`` distinct nodes from the key on; empty for an empty ring or key, or no replicas."""
        none = F.array().cast("array<string>")
        if not self.entries or replicas <= 0:
            return none
        lists = sorted({tuple(self.owners_at(k, replicas)) for k in range(len(self.entries))})
        which = {x: k for k, x in enumerate(lists)}
        of_place = F.array(*[F.lit(which[tuple(self.owners_at(k, replicas))] + 1) for k in range(len(self.entries))])
        choices = F.array(*[F.array(*map(F.lit, x)) for x in lists])
        return F.when(F.length(key) > 0, F.element_at(choices, F.element_at(of_place, self._place(key) + 1))).otherwise(none)


def moved_keys(keys: DataFrame, key: str, before: Ring, after: Ring) -> DataFrame:
    """Keys whose owner changes, with owner_before and owner_after."""
    both = keys.withColumns({"owner_before": before.owner(F.col(key)), "owner_after": after.owner(F.col(key))})
    return both.where(~F.col("owner_before").eqNullSafe(F.col("owner_after")))


def with_node(df: DataFrame, members: DataFrame, owner: str = "owner") -> DataFrame:
    """The membership row of each owner; owners that are not members drop out. Members are as many as the cluster has nodes."""
    return df.join(members.withColumnRenamed("node_id", owner), owner)
