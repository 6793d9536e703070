import random
import zlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import membership, replication
from tidemark.operators.placement import Ring, moved_keys, with_node

NODES = ["node-1", "node-2", "node-3"]


def owners_in_python(ring, key, n):
    h = zlib.crc32(key.encode())
    place = next((k for k, (x, _) in enumerate(ring.entries) if x >= h), 0)
    return ring.owners_at(place, n)


def test_ring_and_owners(spark):
    ring = Ring.build(NODES)
    assert len(ring.entries) == 300 and ring.entries[0] == (11527427, "node-2") and ring.entries[-1] == (4288773750, "node-2")
    golden = {"alpha": "1 2 3", "beta": "2 1 3", "gamma": "1 2 3", "delta": "3 2 1", "epsilon": "3 2 1", "doc1": "3 1 2", "key-1": "3 1 2", "users/alice": "1 3 2", "key-463": "2 3 1"}
    keys = spark.createDataFrame([(k,) for k in golden], "key string")
    rows = keys.select("key", ring.owner(F.col("key")).alias("owner"), ring.owners(F.col("key"), 3).alias("three"), ring.owners(F.col("key"), 2).alias("two"), ring.owners(F.col("key"), 9).alias("all")).collect()
    for r in rows:
        expected = [f"node-{x}" for x in golden[r["key"]].split()]
        assert r["three"] == expected == r["all"] and r["two"] == expected[:2] and r["owner"] == expected[0]


def test_owners_agree_with_python_for_any_ring(spark):
    rng = random.Random(2)
    keys = [f"k{rng.random()}" for _ in range(300)] + ["é", "日本", " "]
    for nodes in (["a"], ["a", "b"], [f"n{k}" for k in range(9)]):
        ring = Ring.build(nodes)
        rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", ring.owners(F.col("key"), 3).alias("o")).collect()
        assert all(r["o"] == owners_in_python(ring, r["key"], 3) for r in rows)


def test_no_owners(spark):
    one = spark.createDataFrame([("",), ("k",)], "key string")
    ring, empty = Ring.build(NODES), Ring.build([])
    assert [r[0] for r in one.select(ring.owners(F.col("key"), 2)).collect()][0] == []
    assert one.select(ring.owner(F.col("key"))).first()[0] is None
    assert [r[0] for r in one.select(ring.owners(F.col("key"), 0)).collect()] == [[], []]
    assert [r[0] for r in one.select(empty.owner(F.col("key"))).collect()] == [None, None]


def test_balance_and_moves(spark):
    ring = Ring.build(NODES)
    keys = spark.range(10_000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    counts = {r["owner"]: r["n"] for r in keys.groupBy(ring.owner(F.col("key")).alias("owner")).agg(F.count("*").alias("n")).collect()}
    assert counts == {"node-1": 3783, "node-2": 3427, "node-3": 2790}
    moved = {(r["owner_before"], r["owner_after"]): r["n"] for r in moved_keys(keys, "key", ring, ring.without("node-2")).groupBy("owner_before", "owner_after").agg(F.count("*").alias("n")).collect()}
    assert moved == {("node-2", "node-3"): 2630, ("node-2", "node-1"): 797}


def test_ring_of_members_and_lookup(spark):
    members = spark.createDataFrame([("node-1", "alive"), ("node-2", "dead"), ("node-3", "alive")], "node_id string, status string")
    ring = Ring.of_members(members)
    assert ring.nodes == ["node-1", "node-3"] and ring.rows(spark).count() == 200
    owned = spark.createDataFrame([("k", "node-1"), ("l", "node-9")], "key string, owner string")
    assert [r["key"] for r in with_node(owned, members).collect()] == ["k"]


def test_fan_out_hints_and_replay(spark):
    ring = Ring.build(NODES)
    members = spark.createDataFrame([("node-1", "dead"), ("node-2", "alive"), ("node-3", "alive")], "node_id string, status string")
    feed = spark.createDataFrame([(1, "put", 1, "alpha", "old"), (2, "put", 2, "alpha", "new")], "seq long, op string, ts long, key string, value string")
    fanned = replication.fan_out(feed, ring, 2)
    assert {(r["owner"], r["role"]) for r in fanned.collect()} == {("node-1", "primary"), ("node-2", "replica")}
    parked = replication.hints(fanned, members)
    assert {r["target_node"]: r["n"] for r in replication.pending(parked).collect()} == {"node-1": 2}
    back = spark.createDataFrame([("node-1",)], "node_id string")
    delivered, left = replication.replay_hints(parked, back, feed.limit(0))
    from tidemark.operators.changelog import fold

    assert fold(delivered).first()["value"] == "new" and left.count() == 0


def test_majority(spark):
    rows = [("m", 0, "a"), ("m", 1, "b"), ("m", 2, "a"), ("x", 0, "x"), ("t", 0, "p"), ("t", 1, "q"), ("n", 0, None), ("n", 1, None), ("n", 2, "z")]
    answers = spark.createDataFrame(rows, "key string, pos int, value string")
    assert {r["key"]: (r["canonical"], r["votes"]) for r in replication.majority(answers).collect()} == {"m": ("a", 2), "x": ("x", 1), "t": ("p", 1), "n": (None, 2)}
    assert {(r["key"], r["pos"], r["canonical"]) for r in replication.divergent(answers).collect()} == {("m", 1, "a"), ("t", 1, "p"), ("n", 2, None)}


def test_failover_and_quorum(spark):
    members = spark.createDataFrame([("a", "dead"), ("b", "alive"), ("c", "alive")], "node_id string, status string")
    owned = spark.createDataFrame([("k", "a", 0), ("k", "b", 1), ("k", "c", 2), ("gone", "a", 0)], "key string, owner string, place int")
    stored = spark.createDataFrame([("k", "a", "va"), ("k", "c", "vc"), ("gone", "a", "x")], "key string, node_id string, value string")
    assert {r["key"]: (r["served_by"], r["value"]) for r in replication.read_with_failover(owned, members, stored).collect()} == {"k": ("c", "vc"), "gone": (None, None)}
    acks = spark.createDataFrame([("k", True), ("k", True), ("k", False), ("l", True)], "key string, acked boolean")
    for level, expected in (("ONE", {"k": True, "l": True}), ("QUORUM", {"k": True, "l": False}), ("ALL", {"k": False, "l": False})):
        assert {r["key"]: r["satisfied"] for r in replication.quorum_reached(acks, level, 3).collect()} == expected
    outcomes = spark.createDataFrame([("read", True), ("write", False), ("repair", True)], "kind string, satisfied boolean")
    assert replication.quorum_metrics(outcomes).first().asDict() == {"successful_reads": 1, "successful_writes": 0, "failed_reads": 0, "failed_writes": 1, "read_repairs": 1}


NODE = "node_id string, address string, status string, last_heartbeat long, version string"


def merged(spark, local, remote):
    rows = membership.merge_states(spark.createDataFrame(local, NODE), spark.createDataFrame(remote, NODE)).collect()
    return {r["node_id"]: (r["address"], r["status"], r["last_heartbeat"], r["version"]) for r in rows}


def test_merge(spark):
    assert merged(spark, [("n", "a", "suspect", 5, "v1")], [("n", "a", "alive", 9, "v0")]) == {"n": ("a", "suspect", 5, "v1")}
    assert merged(spark, [("n", "a", "suspect", 5, "v1")], [("n", "b", "alive", 1, "v2")]) == {"n": ("b", "alive", 1, "v2")}
    assert merged(spark, [("n", "a", "suspect", 5, "v1")], [("n", "a", "alive", 9, "v1")]) == {"n": ("a", "alive", 9, "v1")}
    assert merged(spark, [("n", "a", "alive", 5, "v1")], [("n", "", "dead", 9, "v1")]) == {"n": ("a", "alive", 9, "v1")}
    assert merged(spark, [("n", "a", "dead", 5, "v1")], [("m", "c", "alive", 1, "v1")]) == {"n": ("a", "dead", 5, "v1"), "m": ("c", "alive", 1, "v1")}


def test_detector(spark):
    now = datetime(2024, 1, 1, 0, 0, 10)
    rows = [("a", "alive", now - timedelta(milliseconds=100)), ("b", "alive", now - timedelta(milliseconds=101)), ("c", "suspect", now - timedelta(milliseconds=201)), ("d", "alive", now - timedelta(seconds=9)), ("e", "dead", now), ("me", "alive", now - timedelta(seconds=9))]
    nodes = spark.createDataFrame(rows, "node_id string, status string, last_heartbeat timestamp")
    got = {r["node_id"]: r["status"] for r in membership.detect(nodes, F.lit(now), 100_000, local="me").collect()}
    assert got == {"a": "alive", "b": "suspect", "c": "dead", "d": "suspect", "e": "dead", "me": "alive"}


def test_leader_and_peers(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "node_id string, status string")
    assert membership.leader(table(("node-2", "alive"), ("node-1", "alive"))).first()[0] == "node-1"
    assert membership.leader(table(("node-2", "alive"), ("node-10", "alive"))).first()[0] == "node-10"
    assert membership.leader(table(("node-1", "suspect"), ("node-2", "dead"))).first()[0] is None
    assert membership.leader(table(("node-1", "alive"), ("node-2", "alive")), exclude="node-1").first()[0] == "node-2"
    nodes = table(*[(f"n{k}", "dead" if k == 3 else "alive") for k in range(8)])
    some = [r["node_id"] for r in membership.peers(nodes, 3, "n0", seed=1).collect()]
    assert len(set(some)) == 3 and not {"n0", "n3"} & set(some)
    joined = membership.join_cluster(nodes, table(("n3", "suspect"), ("n9", "dead")))
    assert {r["node_id"] for r in joined.where("status = 'alive'").collect()} >= {"n3", "n9"}
    assert membership.leave_cluster(nodes, table(("n1", "alive")).select("node_id")).count() == 7
