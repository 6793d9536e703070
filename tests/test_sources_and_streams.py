import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog
from tidemark.operators.replication import HintStore
from tidemark.sources import wal
from tidemark.sources.json_documents import read_documents, write_documents
from tidemark.streaming.changes import detect_stream, drain_hints, fold_stream, index_stream, streaming_feed
from tidemark.types import HINT, BadChecksum, BadMagic, BadVersion, CorruptRecord, TruncatedLog


def test_golden_records():
    put = wal.encode("put", 123_000000456, b"key", b"value")
    assert put.hex() == "4c5744430101c80f5fa31c00000003000000050000006b657976616c7565dd39e464"
    assert wal.encode("delete", 123_000000457, b"key").hex() == "4c5744430102c90f5fa31c00000003000000000000006b657908ff51b2"
    assert list(wal.decode(put)) == [("put", 123_000000456, b"key", b"value")]


def test_bad_records():
    put = wal.encode("put", 1, b"k", b"v")
    with pytest.raises(BadChecksum):
        list(wal.decode(put[:-1] + bytes([put[-1] ^ 1])))
    with pytest.raises(BadMagic):
        list(wal.decode(b"x" + put[1:]))
    with pytest.raises(BadVersion):
        list(wal.decode(put[:4] + b"\x09" + put[5:]))
    with pytest.raises(CorruptRecord):
        list(wal.decode(put[:5] + b"\x09" + put[6:]))
    for cut in (1, 10, len(put) - 1):
        with pytest.raises(TruncatedLog):
            list(wal.decode(put + put[:cut]))
    assert list(wal.decode(b"")) == [] and len(list(wal.decode(put * 3))) == 3
    with pytest.raises(CorruptRecord):
        wal.encode("move", 1, b"k")


def test_log_round_trip(spark, tmp_path):
    rows = [(("put" if k % 3 else "delete"), 1_000_000_000 * k + 5, f"k{k % 4}", None if k % 3 == 0 else f"v{k}") for k in range(40)]
    feed = spark.createDataFrame(rows, "op string, ts_ns long, key string, value string").repartitionByRange(3, "ts_ns").sortWithinPartitions("ts_ns")
    segments = wal.write_log(feed, str(tmp_path / "log"), segment_bytes=200)
    paths = [r["path"] for r in segments.collect()]
    assert len(paths) > 3 and segments.agg(F.sum("records")).first()[0] == 40
    log = wal.read_log(spark, str(tmp_path / "log"))
    assert sorted((r["ts_ns"], r["op"]) for r in log.collect()) == sorted((t, op) for op, t, _, _ in rows)
    spark.dataSource.register(wal.LogDataSource)
    again = spark.read.format("tidemark_log").load(str(tmp_path / "log"))
    assert again.exceptAll(log).count() == 0 and again.count() == 40
    folded = {r["key"]: r["value"] for r in changelog.fold(wal.as_feed(log)).collect()}
    expected = {}
    for op, _, key, value in rows:
        expected[key] = value if op == "put" else None
    assert folded == {k: v for k, v in expected.items() if v is not None}


def test_json_documents(spark, tmp_path):
    lines = ['{"_id":"a","x":1}', '{"y":[1,2]}', "[1]", "{}"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    docs = read_documents(spark, str(tmp_path / "in.txt"))
    assert {r["body"]: r["problem"] for r in docs.collect()} == {lines[0]: None, lines[1]: None, lines[2]: "invalid json", lines[3]: "empty document"}
    write_documents(docs.where("problem IS NULL"), str(tmp_path / "out"))
    out = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"_id": "a", "x": 1} in out and any(d.get("y") == [1, 2] for d in out)


FEED = "seq long, op string, ts timestamp, key string, value string"


def test_streaming_fold_equals_batch_fold(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(k, "delete" if k % 7 == 0 else "put", t0 + timedelta(seconds=k), f"k{k % 11}", str(k)) for k in range(200)]
    log = spark.createDataFrame(rows, FEED)
    log.repartition(4).write.parquet(str(tmp_path / "feed"))
    for _ in range(2):  # the second run finds nothing new
        fold_stream(spark, streaming_feed(spark, str(tmp_path / "feed"), FEED), str(tmp_path / "snap"), str(tmp_path / "offsets")).awaitTermination()
    df, at = changelog.load_snapshot(spark, str(tmp_path / "snap"))
    columns = ["key", "value", "version", "created_at", "updated_at", "deleted"]
    assert df.select(columns).exceptAll(changelog.fold(log, tombstones=True).select(columns)).count() == 0 and df.count() == 11 and at == "3"


def test_index_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "create", "a", "x"), (2, 2, "update", "a", "y")], "seq long, ts long, op string, _id string, f string").write.parquet(str(tmp_path / "docs"))
    stored = []
    pairs = lambda df: df.select(F.lit("f").alias("field"), F.col("f").alias("value_key"), "_id")
    old = spark.createDataFrame([("f", "w", "a")], "field string, value_key string, _id string")
    stream = streaming_feed(spark, str(tmp_path / "docs"), "seq long, ts long, op string, _id string, f string").where("op <> 'x'")
    index_stream(stream, pairs, lambda ids: old.join(ids, "_id", "left_semi").select(old.columns), lambda changes, n: stored.extend(changes.collect()), str(tmp_path / "o")).awaitTermination()
    assert ("add", "f", "y", "a") in {tuple(r) for r in stored} and ("remove", "f", "w", "a") in {tuple(r) for r in stored}


def test_drain_hints(spark, tmp_path):
    store = HintStore(spark, str(tmp_path / "h"))
    assert store.waiting().count() == 0
    t0 = datetime(2024, 1, 1)
    store.add(spark.createDataFrame([("n1", "put", "k", "v", t0, 1), ("n2", "put", "l", "w", t0, 2)], HINT))
    got = []
    for rows in ([("n1", "alive"), ("n2", "dead")], [("n1", "alive")]):
        spark.createDataFrame(rows, "node_id string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        drain_hints(streaming_feed(spark, str(tmp_path / "s"), "node_id string, status string"), store, lambda df: got.extend(df.collect()), str(tmp_path / "o")).awaitTermination()
    assert [r["key"] for r in got] == ["k"] and [r["key"] for r in store.waiting().collect()] == ["l"]

    def fails(df):
        raise OSError

    with pytest.raises(OSError):
        store.replay(spark.createDataFrame([("n2",)], "node_id string"), fails)
    assert store.waiting().count() == 1


def test_microseconds_of_a_log_are_cut_not_rounded(spark):
    times = [0, 999, 1_000, 1_700_000_000_123_456_999, 1_699_999_999_999_999_999, -1, -1_000, -1_001]
    log = spark.createDataFrame([("s", k, "put", t, b"k", b"v") for k, t in enumerate(times)], "segment string, seq long, op string, ts_ns long, key binary, value binary")
    got = [r[0] for r in wal.as_feed(log).orderBy("seq").select(F.unix_micros("ts")).collect()]
    assert got == [t // 1000 for t in times]


def test_a_crash_while_publishing_keeps_the_published_snapshot(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "snap")
    state = lambda n: spark.range(n).select(F.col("id").cast("string").alias("key"))
    changelog.save_snapshot(spark, state(1), folder, "snapshot-1", "1")

    def crash(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(changelog, "_write_text", crash)
        with pytest.raises(OSError):
            changelog.save_snapshot(spark, state(2), folder, "snapshot-2", "2")
    assert changelog.load_snapshot(spark, folder)[1] == "1" and changelog.load_snapshot(spark, folder)[0].count() == 1
    for n in (2, 3, 4):
        changelog.save_snapshot(spark, state(n), folder, f"snapshot-{n}", str(n))
    assert changelog.load_snapshot(spark, folder)[0].count() == 4
    assert sorted(p.name for p in (tmp_path / "snap").iterdir() if p.is_dir()) == ["snapshot-3", "snapshot-4"]


def test_a_lost_pointer_is_an_error_for_later_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    write = lambda k: spark.createDataFrame([(k, "put", t0, f"k{k}", "v")], FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    run = lambda: fold_stream(spark, streaming_feed(spark, str(tmp_path / "feed"), FEED), str(tmp_path / "snap"), str(tmp_path / "offsets")).awaitTermination()
    write(1)
    run()
    (tmp_path / "snap" / "CURRENT").unlink()
    write(2)
    with pytest.raises(Exception, match="not the first"):
        run()


def test_failure_detector_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = datetime(2024, 1, 1)
    beats = [[("a", 0), ("b", 0)], [("b", 8)], [("b", 15)], [("b", 30)], [("b", 31)]]
    for k, rows in enumerate(beats):
        spark.createDataFrame([(n, t0 + timedelta(seconds=s)) for n, s in rows], "node_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "beats"))
        stream = streaming_feed(spark, str(tmp_path / "beats"), "node_id string, ts timestamp")
        detect_stream(stream, 10_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    got = [(r["node_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "node_id").collect()]
    assert [s for n, s in got if n == "a"] == ["alive", "suspect", "dead"]
    assert [s for n, s in got if n == "b"][0] == "alive"
