import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog
from tidemark.operators.kv import KeyValueView, Store
from tidemark.types import AlreadyOpen, CursorClosed, InvalidKey, KeyNotFound, NilValue, NotOpen, UnknownEngine

FEED = "seq long, op string, ts timestamp, key string, value string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, *rows):
    """Rows of (op, key, value); time and seq follow their order."""
    return spark.createDataFrame([(k, op, T0 + timedelta(seconds=k), key, value) for k, (op, key, value) in enumerate(rows)], FEED)


def state(df):
    return {r["key"]: (r["value"], r["version"]) for r in df.collect()}


def test_order_and_deletes(spark):
    log = feed(spark, ("put", "key", "first"), ("put", "key", "last"), ("put", "gone", "x"), ("delete", "gone", None))
    assert state(changelog.fold(log)) == {"key": ("last", 2)}
    assert state(changelog.fold(log, tombstones=True)) == {"key": ("last", 2), "gone": (None, 2)}


def test_equal_times_are_ordered_by_seq(spark):
    rows = [(k, "put", T0, "k", str(k)) for k in (3, 1, 4, 2)]
    assert state(changelog.fold(spark.createDataFrame(rows, FEED))) == {"k": ("4", 4)}


def test_put_delete_put(spark):
    log = feed(spark, ("put", "k", "1"), ("delete", "k", None), ("put", "k", "2"))
    live, replay = changelog.fold(log).first(), changelog.fold(log, semantics="replay").first()
    assert (live["version"], live["created_at"]) == (3, T0.replace(tzinfo=None))
    assert (replay["version"], replay["created_at"]) == (1, T0.replace(tzinfo=None) + timedelta(seconds=2))


def test_recovery_equals_the_whole_fold(spark):
    log = feed(spark, ("put", "kept", "one"), ("put", "later", "0"), ("put", "later", "two"), ("delete", "kept", None), ("delete", "absent", None))
    since = F.lit(T0 + timedelta(seconds=2))
    snapshot = changelog.fold(log.where(F.col("ts") < since), tombstones=True)
    assert state(changelog.recover(snapshot, log, since)) == state(changelog.fold(log)) == {"later": ("two", 2)}


def test_random_logs_fold_like_a_dictionary(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["put", "put", "delete"]), f"k{rng.randrange(20)}", str(n)) for n in range(400)]
    expected, versions = {}, {}
    for op, key, value in rows:
        versions[key] = versions.get(key, 0) + 1
        expected[key] = value if op == "put" else None
    log = feed(spark, *rows)
    assert state(changelog.fold(log)) == {k: (v, versions[k]) for k, v in expected.items() if v is not None}
    parts = [log.where(F.col("seq") % 3 == k) for k in (2, 0, 1)]  # merged out of order
    merged = changelog.fold(parts[0], tombstones=True)
    for part in parts[1:]:
        merged = changelog.merge(merged, part)
    assert state(merged.where("NOT deleted")) == state(changelog.fold(log))


def test_unknown_operations_fail(spark):
    with pytest.raises(Exception, match="unknown operation"):
        changelog.check_operations(feed(spark, ("move", "k", "v"))).collect()
    assert changelog.check_operations(feed(spark, ("put", "k", "v"))).count() == 1


def test_empty_feed(spark):
    empty = spark.createDataFrame([], FEED)
    assert changelog.fold(empty).count() == 0 and changelog.merge(changelog.fold(empty, tombstones=True), empty).count() == 0


def test_snapshots_and_segments(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert changelog.load_snapshot(spark, folder) is None
    log = feed(spark, ("put", "a", "1"), ("put", "b", "2"))
    for k in range(2):
        changelog.save_snapshot(spark, changelog.fold(log.where(f"seq <= {k}"), tombstones=True), folder, f"s{k}", str(k))
    df, at = changelog.load_snapshot(spark, folder)
    assert at == "1" and state(df) == {"a": ("1", 1), "b": ("2", 1)}
    changelog.append(log, str(tmp_path / "log"))
    changelog.append(log.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS")), str(tmp_path / "log"))
    assert changelog.vacuum(spark, str(tmp_path / "log"), "2024010102") == 1
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


@pytest.fixture(scope="module")
def view(spark):
    rows = [("a", "1", False), ("ab", "22", False), ("abc", "333", True), ("b", "4", False), ("ba", "", False)]
    return KeyValueView(spark.createDataFrame(rows, "key string, value string, deleted boolean"))


def keys(df):
    return [r["key"] for r in df.collect()]


def test_scans(view):
    assert keys(view.scan()) == ["a", "ab", "b", "ba"]
    assert keys(view.scan(prefix="a")) == ["a", "ab"]
    assert keys(view.scan(start="ab", end="ba")) == ["ab", "b"]
    assert keys(view.scan(prefix="b", start="ba")) == ["ba"]
    assert keys(view.scan(reverse=True, limit=2)) == ["ba", "b"]
    assert keys(view.scan(limit=1)) == ["a"] and len(keys(view.scan(limit=-3))) == 4
    plan = view.df.sparkSession.read.parquet("/root/testdata/sf0.001/customer.parquet")
    text = KeyValueView(plan, key="c_name", deleted=None, value="c_mktsegment").scan(prefix="Cust", start="Customer#1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(c_name,Cust)" in text and "GreaterThanOrEqual(c_name,Customer#1)" in text


def test_points(spark, view):
    assert view.read("ab")["value"] == "22"
    assert view.get_raw("abc").first()["deleted"]
    assert view.exists("a") and not view.exists("abc") and not view.exists("zz")
    with pytest.raises(KeyNotFound):
        view.read("abc")
    with pytest.raises(InvalidKey):
        view.get("")
    wanted = spark.createDataFrame([("a",), ("abc",), ("zz",)], "key string")
    assert keys(view.existing(wanted)) == ["a"] and sorted(keys(view.absent(wanted))) == ["abc", "zz"]


def test_stats_and_expiry(spark, view):
    assert view.stats().first().asDict() == {"keys": 5, "live_keys": 4, "bytes": 1 + 1 + 2 + 2 + 3 + 3 + 1 + 1 + 2}
    rows = [("a", "1", 1000, T0), ("b", "2", None, T0), ("c", "3", 5000, T0)]
    old = KeyValueView(spark.createDataFrame(rows, "key string, value string, ttl_ms long, updated_at timestamp"), deleted=None)
    assert keys(old.unexpired(T0 + timedelta(seconds=2)).scan()) == ["b", "c"]


def test_cursor(view):
    cursor, found = view.cursor(prefix="a"), []
    while cursor.next():
        found.append(cursor.record["key"])
    assert found == ["a", "ab"] and cursor.error is None
    cursor.close()
    assert not cursor.next() and isinstance(cursor.error, CursorClosed)


def test_writes_as_feeds(spark, view):
    rows = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    log = view.puts(rows, T0).unionByName(view.deletes(rows.where("key = 'x'").select("key"), T0 + timedelta(seconds=1)))
    assert state(changelog.fold(log)) == {"y": ("2", 1)}
    for bad in ([("", "1")], [("x", None)]):
        with pytest.raises(Exception, match="invalid key|nil value"):
            view.puts(spark.createDataFrame(bad, "key string, value string"), T0).collect()


def test_store(spark, tmp_path):
    with pytest.raises(UnknownEngine):
        Store(spark, str(tmp_path), "rocks")
    store = Store(spark, str(tmp_path / "log"))
    with pytest.raises(NotOpen):
        store.write("put", "a", "1", T0)
    assert not store.health()["healthy"]
    store.open()
    with pytest.raises(AlreadyOpen):
        store.open()
    store.write("put", "a", "1", T0)
    store.write("put", "b", "2", T0 + timedelta(seconds=1))
    store.write("delete", "a", None, T0 + timedelta(seconds=2))
    with pytest.raises(NilValue):
        store.write("put", "a", None, T0)
    assert keys(store.view().scan()) == ["b"] and store.health()["healthy"]
