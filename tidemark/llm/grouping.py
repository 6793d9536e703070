"""Groups from buckets: members meet a few leaders, similar pairs join to components, and crowded buckets that hold several components are compared in blocks across these."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["band", "key"]
#: Edges that a task replaces by stars at a time; it holds their nodes in memory.
EDGES_PER_TASK = 200_000


def _stars(most: int):
    """Of each ``most`` edges (a, b) of a task one for each node but the smallest of what they link: to that smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        seen, kind = 0, None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def made() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in parent if parent[x] != x]
            for lo in range(0, len(nodes), 10_000):
                own = nodes[lo : lo + 10_000]
                yield pa.record_batch([pa.array(own, kind), pa.array([root(x) for x in own], kind)], names=["a", "b"])
            parent.clear()

        for batch in batches:
            if seen + len(batch) > most:
                yield from made()
                seen = 0
            seen, kind = seen + len(batch), batch.schema.field("a").type
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        yield from made()

    return run


def local_stars(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) that link the same nodes as ``edges``, written, and how many times ``EDGES_PER_TASK`` the edges were.

    A crowd of near copies comes with many links a member. Tasks replace ``EDGES_PER_TASK`` of them at a time by stars, of at most one edge a
    node, so that the steps in Spark that follow work on about the nodes and not on all links.
    """
    from ..runtime import discard, persist, ship

    ship(spark)
    edges = persist(spark, edges.where("a != b").select("a", "b"), "edges")
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    stars = persist(spark, edges.coalesce(tasks).mapInArrow(_stars(EDGES_PER_TASK), edges.schema), "stars")
    discard(edges)
    return stars, tasks


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of the connected component.

    Edges are first replaced by stars (``local_stars``); where these are not of all edges at once, large stars and small stars alternate
    until all components are stars: every node but the centres has one edge, to a centre. Every step is written to the shared folder.
    """
    from ..runtime import discard, persist

    def step(rows: DataFrame, large: bool) -> DataFrame:
        if large:
            both = rows.select("a", "b").unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        joined = rows.join(least, "a")
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def done(rows: DataFrame) -> bool:
        ends = rows.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(rows.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    now, tasks = local_stars(spark, edges)
    while tasks > 1 and not done(now):
        before, now = now, persist(spark, step(step(now, True), False), "stars")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def meeting_rows(banded: DataFrame) -> DataFrame:
    """Of (band, key, node) rows those in buckets of two or more, with the bucket's size ``n`` and ``order``: nodes that meet many others come first.

    Where rows have the ``root`` of their node too, it stays, and only buckets of two roots or more do: the others' nodes are linked already.
    """
    rooted = [c for c in banded.columns if c == "root"]
    sizes = banded.groupBy(*KEYS).agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in rooted for f in (F.min, F.max)])
    sizes = sizes.where("min_root < max_root" if rooted else "n > 1").select(*KEYS, "n")
    members = banded.join(sizes, KEYS)
    weights = members.groupBy("node").agg(F.struct((-F.sum("n")).alias("w"), F.col("node").alias("node")).alias("order"))
    return members.join(weights, "node").select(*KEYS, "node", *rooted, "order", "n")


def leader_pairs(spark: SparkSession, members: DataFrame, leaders: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (node, leader) of members (see ``meeting_rows``) and their buckets' first ``leaders`` nodes by order; and the written leaders, to discard.

    In buckets of up to ``leaders`` + 1 nodes these are all pairs; in larger ones ``leaders`` rows a member, so their number
    is in proportion to the members. Leaders are found by a rank that Spark limits before it shuffles; they are written, so that
    the join has a shuffle of its own on both sides and Spark can split a hot bucket's rows there. Where members have a ``root``, pairs of one root are left out.
    """
    from ..runtime import persist

    rooted = [c for c in members.columns if c == "root"]
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("order"))).where(F.col("rank") <= leaders)
    ranked = persist(spark, ranked.select(*KEYS, F.col("node").alias("leader"), F.col("order").alias("leader_order"), *[F.col(c).alias(f"leader_{c}") for c in rooted]), f"{label}-leaders")
    wanted = " AND ".join(["order > leader_order", *[f"{c} != leader_{c}" for c in rooted]])
    return members.join(ranked, KEYS).where(wanted).select("node", "leader").distinct(), ranked


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their node, which is the node itself where ``roots`` has none."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def across_components(spark: SparkSession, members: DataFrame, roots: DataFrame, payload: DataFrame, compare: Callable[[DataFrame], DataFrame], most: int, block: int, label: str) -> DataFrame:
    """Links between components that meet in buckets of more than ``most`` nodes, in which not all pairs met a leader.

    ``members`` has band, key, node and n, ``roots`` node and root (nodes without a row are alone), ``payload`` node and data.
    ``compare`` takes rows of two blocks of members of one bucket (``band``, ``key``; ``members`` and ``others``: arrays of node, root and
    data; ``same``: whether it is one block), and returns what it finds between members of different components. Every pair of a
    bucket whose nodes are in different components meets in exactly one row. The members of its largest component are compared
    with all others, not with each other, so a bucket that is one component costs nothing, and one that is a large component
    and a few others costs their product. What is left is quadratic only in the members of one bucket that are *not* linked.

    No bucket is gathered: its members are dealt by hash to blocks of about ``block``, and a hot bucket's blocks are
    split in the join.
    """
    from ..runtime import discard, persist

    crowded = members.where(F.col("n") > most).select(*KEYS, "node", "n")
    # Roots are joined to a row for each node, not to its rows in buckets; then only to the rows in mixed buckets.
    rooted = with_roots(crowded.groupBy("node").agg(F.collect_list(F.struct(*KEYS)).alias("met")), roots)
    by_root = rooted.select("root", F.explode("met").alias("met")).select("met.*", "root").groupBy(*KEYS, "root").agg(F.count("*").alias("of_root"))
    mixed = by_root.groupBy(*KEYS).agg(F.max_by("root", F.struct("of_root", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    mixed = persist(spark, mixed, f"{label}-mixed")  # so that a hot bucket's rows can be split in the next join
    dealt = with_roots(crowded.join(mixed, KEYS), roots)
    dealt = dealt.select(*KEYS, "node", "root", (F.col("root") == F.col("largest")).alias("main"), F.expr(f"pmod(xxhash64(node), cast(ceil(n / {block}) as long))").alias("block"))
    dealt = persist(spark, dealt, f"{label}-dealt")
    blocks = dealt.join(payload, "node").groupBy(*KEYS, "main", "block").agg(F.collect_list(F.struct("node", "root", "data")).alias("members"))
    blocks = persist(spark, blocks, f"{label}-blocks")
    others = blocks.select(*KEYS, F.col("main").alias("other_main"), F.col("block").alias("other"), F.col("members").alias("others"))
    meeting = blocks.where("NOT main").join(others, KEYS).where("other_main OR block <= other")
    found = persist(spark, compare(meeting.select(*KEYS, (~F.col("other_main") & (F.col("block") == F.col("other"))).alias("same"), "members", "others")), f"{label}-across")
    discard(mixed, dealt, blocks)
    return found


def merge_components(spark: SparkSession, roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after joining the components of the two nodes of each of ``links`` (a, b); only the components linked are walked again."""
    first = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    first = first.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    again = components(spark, first).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(again, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = again.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return moved.unionByName(alone)


def spanning_links(similar: np.ndarray, roots: list, other_roots: list) -> list[tuple[int, int]]:
    """As few of the similar pairs (row, column) as join all components that they link."""
    names = {r: k for k, r in enumerate(dict.fromkeys([*roots, *other_roots]))}
    own, theirs = (np.array([names[r] for r in x], np.int64) for x in (roots, other_roots))
    i, j = np.nonzero(similar)
    differ = own[i] != theirs[j]
    i, j = i[differ], j[differ]
    _, first = np.unique(own[i] * len(names) + theirs[j], return_index=True)
    parent, links = list(range(len(names))), []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in first.tolist():
        x, y = root(int(own[i[k]])), root(int(theirs[j[k]]))
        if x != y:
            parent[x] = y
            links.append((int(i[k]), int(j[k])))
    return links
