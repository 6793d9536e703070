"""More queries of the catalogue: point reads, logs and stores on files, requests, index lookups, hints, membership exchanges, scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changelog, membership, replication, request
from ..operators.documents import DocumentCollection, aggregate_body, check_options, index_changes, parse_documents, to_body
from ..operators.kv import KeyValueView, Store
from ..operators.placement import with_node
from ..runtime import scratch_path, table
from ..sources import wal
from ..sources.json_documents import read_documents, write_documents
from ..streaming.changes import drain_hints, index_stream, streaming_feed
from ..types import TidemarkError
from .catalog import _CRC, _E, _FANNED, _FOLD, _OWNED, _R, FIELDS, RING, _ranked, _state, answers, document_keys, event_documents, events, feed, members, order_keys, query, variant_documents


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- keys and stores -------------------------------------------------------------------------------------------------


@query("q41_get", _FOLD.format("", " AND op = 'put' AND key = '7'"))
def get(spark, sf_dir):
    return _state(KeyValueView(changelog.fold(feed(spark, sf_dir), tombstones=True)).get("7"))


@query("q42_get_by_id", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE _id = '000000000042'")
def get_by_id(spark, sf_dir):
    return event_documents(spark, sf_dir).get("000000000042").select("_id", *FIELDS)


@query("q43_cursor", "SELECT CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS step, key, value FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders) WHERE starts_with(key, '12') QUALIFY step <= 30")
def cursor(spark, sf_dir):
    steps, found = order_keys(spark, sf_dir).cursor(prefix="12", limit=30), []
    while steps.next():
        found.append((len(found) + 1, steps.record["key"], steps.record["value"]))
    steps.close()
    return spark.createDataFrame(found, "step long, key string, value string")


def _log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as records in order of time, 999 nanoseconds after their microsecond."""
    rows = feed(spark, sf_dir).select("op", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)") * 1000 + 999).alias("ts_ns"), "key", F.when(F.col("op") == "put", F.col("value")).alias("value"), "seq")
    return rows.repartitionByRange(4, "ts_ns", "seq").sortWithinPartitions("ts_ns", "seq").drop("seq")


_MICROS = """WITH m AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS key, props AS value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us DESC, seq DESC) AS k, count(*) OVER (PARTITION BY key) AS version, min(us) OVER (PARTITION BY key) AS created_at FROM m)
SELECT key, value, version, created_at, us AS updated_at FROM r WHERE k = 1 AND op = 'put'"""


def _micros(state: DataFrame) -> DataFrame:
    return state.select("key", "value", "version", F.unix_micros("created_at").alias("created_at"), F.unix_micros("updated_at").alias("updated_at"))


@query("q44_binary_log", _MICROS)
def binary_log(spark, sf_dir):
    """Written as records, read back, folded."""
    folder = scratch_path(spark, "log")
    wal.write_log(_log_rows(spark, sf_dir), folder)
    return _micros(changelog.fold(wal.as_feed(wal.read_log(spark, folder))))


@query("q45_log_data_source", "SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, count(*) AS n, max(epoch_us(ts)) * 1000 + 999 AS last_ns FROM events GROUP BY 1")
def log_data_source(spark, sf_dir):
    folder = scratch_path(spark, "log")
    wal.write_log(_log_rows(spark, sf_dir), folder)
    spark.dataSource.register(wal.LogDataSource)
    return spark.read.format(wal.LogDataSource.name()).load(folder).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ns").alias("last_ns"))


@query("q46_segments", "SELECT count(*) AS records, true AS bounded, true AS several FROM events")
def segments(spark, sf_dir):
    written = wal.write_log(_log_rows(spark, sf_dir), scratch_path(spark, "log"), segment_bytes=8192)
    return written.agg(F.sum("records").alias("records"), (F.max("bytes") <= 8192).alias("bounded"), (F.count(F.lit(1)) > 4).alias("several"))


@query("q47_rotation", "SELECT DISTINCT strftime(ts, '%Y%m%d%H') AS segment FROM events QUALIFY dense_rank() OVER (ORDER BY segment DESC) <= 3")
def rotation(spark, sf_dir):
    """An appended log, of which the last three segments stay."""
    folder = scratch_path(spark, "segments")
    changelog.append(feed(spark, sf_dir).repartition("key"), folder)
    changelog.vacuum(spark, folder, most=3)
    return spark.read.option("basePath", folder).schema("seq long, segment string").parquet(folder).select("segment").distinct()


@query("q48_checkpoints", _MICROS)
def checkpoints(spark, sf_dir):
    """Half of a log, a checkpoint, the other half, another on top of it; a third, below its threshold, is not taken."""
    rows = feed(spark, sf_dir).withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts))"))
    middle = rows.agg(F.expr("timestamp_micros(cast((min(unix_micros(ts)) + max(unix_micros(ts))) / 2 as long))").alias("t")).first()["t"]
    log, folder = scratch_path(spark, "log"), scratch_path(spark, "snapshots")
    for part, name in ((rows.where(F.col("ts") < middle), "1"), (rows.where(F.col("ts") >= middle), "2")):
        changelog.append(part, log)
        changelog.checkpoint(spark, log, folder, 0, name, str(middle))
    changelog.checkpoint(spark, log, folder, 1 << 50, "3", str(middle))
    state, _ = changelog.load_snapshot(spark, folder)
    return _micros(state.where(~F.col("deleted")))


@query("q49_store", "SELECT * FROM (VALUES ('a', 'later', 2::BIGINT), ('c', 'kept', 1)) AS t(key, value, version)")
def store(spark, sf_dir):
    """Of writes with one time the later wins, after a reopen too."""
    folder, at = scratch_path(spark, "store"), datetime(2024, 1, 1)
    first = Store(spark, folder).open()
    first.write_rows(_rows(spark, "op string, ts timestamp, key string, value string", ("put", at, "a", "first"), ("put", at, "b", "gone"), ("put", at, "c", "kept")).coalesce(1))
    first.close()
    again = Store(spark, folder).open()
    again.write("put", "a", "later", at)
    again.write("delete", "b", None, at)
    return again.view().scan().select("key", "value", "version")


@query("q50_statistics", """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_id)) AS t, arg_max(props, (ts, event_id)) AS v FROM events GROUP BY user_id)
SELECT count(*) AS keys, count(*) FILTER (t <> 'error') AS live_keys, CAST(sum(strlen(key) + CASE WHEN t <> 'error' THEN strlen(v) ELSE 0 END) AS BIGINT) AS bytes, 'parquet' AS engine, (SELECT count(*) FROM events) AS version, true AS stored FROM f""")
def statistics(spark, sf_dir):
    one = Store(spark, scratch_path(spark, "store")).open()
    rows = feed(spark, sf_dir).select("op", F.col("ts").cast("timestamp").alias("ts"), "key", F.when(F.col("op") == "put", F.col("value")).alias("value"), "seq")
    one.write_rows(rows.orderBy("ts", "seq").coalesce(1).drop("seq"))
    found = one.statistics()
    return _rows(spark, "keys long, live_keys long, bytes long, engine string, version long, stored boolean", (*(found[k] for k in ("keys", "live_keys", "bytes", "engine", "version")), found["log_bytes"] > 0 and found["segments"] > 0))


def _outcome(call) -> str:
    try:
        call()
    except TidemarkError as e:
        return type(e).__name__
    return "fine"


@query("q51_states_and_engines", "SELECT * FROM (VALUES ('new', 'closed'), ('open', 'open'), ('open twice', 'AlreadyOpen'), ('empty key', 'InvalidKey'), ('null value', 'NilValue'), ('absent key', 'KeyNotFound'), ('closed', 'closed'), ('write when closed', 'NotOpen'), ('scan when closed', 'NotOpen'), ('engine orc', 'fine'), ('engine tape', 'UnknownEngine')) AS t(what, outcome)")
def states_and_engines(spark, sf_dir):
    one, at = Store(spark, scratch_path(spark, "store")), datetime(2024, 1, 1)
    found = [("new", one.health()["message"])]
    found.append(("open", one.open().health()["message"]))
    found += [("open twice", _outcome(one.open)), ("empty key", _outcome(lambda: one.write("put", "", "x", at))), ("null value", _outcome(lambda: one.write("put", "k", None, at))), ("absent key", _outcome(lambda: one.view().read("k")))]
    one.close()
    found += [("closed", one.health()["message"]), ("write when closed", _outcome(lambda: one.write("put", "k", "v", at))), ("scan when closed", _outcome(one.view))]
    found += [(f"engine {e}", _outcome(lambda e=e: Store(spark, "x", e))) for e in ("orc", "tape")]
    return spark.createDataFrame(found, "what string, outcome string")


# --- documents as text -----------------------------------------------------------------------------------------------


@query("q52_json_round_trip", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE event_type = 'signup'")
def json_round_trip(spark, sf_dir):
    """Documents written as lines of JSON and read again."""
    folder = scratch_path(spark, "json")
    write_documents(variant_documents(spark, sf_dir).find("event_type", "signup"), folder)
    got = read_documents(spark, folder).where("problem IS NULL")
    return got.select("_id", F.try_variant_get("doc", "$.event_type", "string").alias("event_type"), F.try_variant_get("doc", "$.user_id", "bigint").alias("user_id"), F.try_variant_get("doc", "$.value", "double").alias("value"))


@query("q53_bodies", """SELECT _id, '{"_id":"' || _id || '","event_type":"' || event_type || '","user_id":' || user_id || '}' AS body FROM (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, event_type, user_id FROM events WHERE event_type = 'purchase')""")
def bodies(spark, sf_dir):
    """Keys in order, the system's id first, whatever id the document holds itself."""
    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    own = F.to_json(F.struct("user_id", "event_type", F.lit("other").alias("_id")))
    return to_body(rows.select("_id", F.try_parse_json(own).alias("doc")))


@query("q54_escapes", r"""SELECT * FROM (VALUES ('1', '{"_id":"1","a":"\u003cb\u003e \u0026"}'), ('2', '{"_id":"2","q\u003e":"\"x\" é"}'), ('3', '{"_id":"3","n":[1,"\u003c"]}')) AS t(_id, body)""")
def escapes(spark, sf_dir):
    rows = _rows(spark, "_id string, body string", ("1", '{"a":"<b> &"}'), ("2", '{"q>":"\\"x\\" é"}'), ("3", '{"n":[1,"<"]}'))
    return to_body(parse_documents(rows))


@query("q55_aggregate_bodies", """SELECT * FROM (VALUES ('none', '{"field":"event_type","value":null}'), ('sum', '{"field":"n","sum":6.0}'), ('count', '{"count":3}')) AS t(what, body)""")
def aggregate_bodies(spark, sf_dir):
    small = DocumentCollection(_rows(spark, "_id string, kind string, n long", ("1", "x", 1), ("2", "x", 2), ("3", "x", 3)), ["kind", "n"])
    found = {"none": event_documents(spark, sf_dir).aggregate("event_type", "click", "sum:event_type"), "sum": small.aggregate("kind", "x", "sum:n"), "count": small.aggregate("kind", "x", "count")}
    rows = [aggregate_body(df).select(F.lit(what).alias("what"), "body") for what, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- requests --------------------------------------------------------------------------------------------------------


@query("q56_request_page", f"WITH {_E} SELECT _id, event_type, user_id, value, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, _id) AS BIGINT) - 3 AS rank FROM e WHERE event_type = 'click' QUALIFY rank BETWEEN 1 AND 7")
def request_page(spark, sf_dir):
    return _ranked(request.answer(event_documents(spark, sf_dir), "field=event_type&value=click&sort=-value&limit=7&offset=3&limit=99"))


@query("q57_request_aggregate", "SELECT count(*) AS count FROM events WHERE user_id = 8")
def request_aggregate(spark, sf_dir):
    """With an aggregate the paging parameters are not looked at, not even wrong ones."""
    return request.answer(event_documents(spark, sf_dir), "field=user_id&value=8&aggregate=count&limit=x&offset=-4")


@query("q58_request_errors", """SELECT * FROM (VALUES ('', 'MethodNotAllowed'), ('field=a', 'BadRequest'), ('value=a', 'BadRequest'), ('field=a&value=', 'fine'), ('field=a&value=b&limit=-1', 'BadRequest'), ('field=a&value=b&limit=x', 'BadRequest'), ('field=a&value=b&offset=-1', 'BadRequest'),
('field=a&value=b&limit=0', 'fine'), ('field=a&value=b&aggregate=median:x', 'BadRequest'), ('field=a&value=b&aggregate=sum', 'BadRequest'), ('field=a&value=b&aggregate=sum:', 'BadRequest'), ('field=a&value=b&aggregate=sum:x:y', 'fine')) AS t(request, outcome)""")
def request_errors(spark, sf_dir):
    asked = ["", "field=a", "value=a", "field=a&value=", "field=a&value=b&limit=-1", "field=a&value=b&limit=x", "field=a&value=b&offset=-1", "field=a&value=b&limit=0", "field=a&value=b&aggregate=median:x", "field=a&value=b&aggregate=sum", "field=a&value=b&aggregate=sum:", "field=a&value=b&aggregate=sum:x:y"]
    return spark.createDataFrame([(q, _outcome(lambda q=q: request.parse_request(q))) for q in asked], "request string, outcome string")


@query("q59_options", "SELECT * FROM (VALUES ('limit -1', 'fine'), ('limit 0', 'fine'), ('limit -2', 'InvalidOption'), ('limit text', 'InvalidOption'), ('offset 0', 'fine'), ('offset -1', 'InvalidOption'), ('sort number', 'InvalidOption')) AS t(what, outcome)")
def options(spark, sf_dir):
    asked = {"limit -1": {"limit": -1}, "limit 0": {"limit": 0}, "limit -2": {"limit": -2}, "limit text": {"limit": "5"}, "offset 0": {"offset": 0}, "offset -1": {"offset": -1}, "sort number": {"sort": 3}}
    return spark.createDataFrame([(what, _outcome(lambda o=o: check_options(**o))) for what, o in asked.items()], "what string, outcome string")


@query("q60_paths", "SELECT * FROM (VALUES ('/v1/kv/a', 'a'), ('/v1/kv/a/b/', 'a/b'), ('/v1/kv//a', 'a'), ('/v1/kv/', 'BadRequest'), ('/v2/a', 'BadRequest')) AS t(path, key)")
def paths(spark, sf_dir):
    def key_of(path: str) -> str:
        return request.key_of_path(path) if _outcome(lambda: request.key_of_path(path)) == "fine" else _outcome(lambda: request.key_of_path(path))

    return spark.createDataFrame([(p, key_of(p)) for p in ("/v1/kv/a", "/v1/kv/a/b/", "/v1/kv//a", "/v1/kv/", "/v2/a")], "path string, key string")


# --- index -----------------------------------------------------------------------------------------------------------


@query("q61_find_by_index", f"WITH {_E} SELECT _id, event_type, user_id, value, CAST(row_number() OVER (ORDER BY user_id DESC NULLS LAST, _id) AS BIGINT) - 4 AS rank FROM e WHERE event_type = 'click' AND CAST(_id AS BIGINT) % 4 <> 0 QUALIFY rank BETWEEN 1 AND 12")
def find_by_index(spark, sf_dir):
    """The index still knows documents that are gone; they don't count towards the offset."""
    pairs = event_documents(spark, sf_dir).pairs()
    present = DocumentCollection(events(spark, sf_dir).where("event_id % 4 <> 0").select("_id", *FIELDS), FIELDS)
    return _ranked(present.find_by_index(pairs, "event_type", "click", limit=12, offset=4, sort="-user_id"))


_CHANGES = """SELECT 'remove' AS action, 'event_type' AS field, event_type AS value_key, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY ALL
UNION ALL SELECT 'add', 'event_type', 'changed', count(*) FROM events WHERE event_id % 10 = 0"""


@query("q62_index_changes", _CHANGES)
def changes_of_index(spark, sf_dir):
    rows = events(spark, sf_dir).select("_id", "event_type", "event_id")
    after = rows.withColumn("event_type", F.when(F.col("event_id") % 10 == 0, F.lit("changed")).otherwise(F.col("event_type")))
    pairs = [DocumentCollection(df.drop("event_id"), ["event_type"]).pairs() for df in (rows, after)]
    return index_changes(*pairs).groupBy("action", "field", "value_key").agg(F.count(F.lit(1)).alias("n"))


@query("q63_index_stream", _CHANGES)
def stream_of_index(spark, sf_dir):
    """The same, as the changed documents stream in."""
    source, out = scratch_path(spark, "changed"), scratch_path(spark, "changes")
    rows = events(spark, sf_dir)
    changed = rows.where("event_id % 10 = 0").select(F.col("event_id").alias("seq"), "ts", F.lit("update").alias("op"), "_id", F.lit("changed").alias("event_type"))
    changed.repartition(3).write.parquet(source)
    pairs_of = lambda df: DocumentCollection(df.select("_id", "event_type"), ["event_type"]).pairs()
    stream = streaming_feed(spark, source, spark.read.parquet(source).schema)
    index_stream(stream, pairs_of, lambda ids: pairs_of(rows).join(ids, "_id", "left_semi"), lambda found, _: found.write.mode("append").parquet(out), scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).groupBy("action", "field", "value_key").agg(F.count(F.lit(1)).alias("n"))


@query("q64_mixed_sort", "SELECT * FROM (VALUES (1::BIGINT, 'd'), (2, 'b'), (3, 'a'), (4, 'c'), (5, 'f'), (6, 'e'), (7, 'g'), (8, 'h')) AS t(rank, _id)")
def mixed_sort(spark, sf_dir):
    """Booleans, numbers by size, texts by code point; missing and null last."""
    rows = _rows(spark, "_id string, body string", ("a", '{"k":"x","v":2.5}'), ("b", '{"k":"x","v":2}'), ("c", '{"k":"x","v":10}'), ("d", '{"k":"x","v":false}'), ("e", '{"k":"x","v":"b"}'), ("f", '{"k":"x","v":"a"}'), ("g", '{"k":"x","v":null}'), ("h", '{"k":"x"}'))
    found = DocumentCollection(parse_documents(rows)).find("k", "x", limit=8, sort="v").coalesce(1)
    return found.select((F.monotonically_increasing_id() + 1).alias("rank"), "_id")


# --- nodes -----------------------------------------------------------------------------------------------------------


@query("q65_owner_rows", f"WITH {_CRC}, {_OWNED}, m(owner, address) AS (VALUES ('node-1', 'a:1'), ('node-2', 'a:2'), ('node-3', 'a:3')) SELECT address, count(*) AS n FROM o JOIN m USING (owner) GROUP BY address")
def owner_rows(spark, sf_dir):
    owned = document_keys(spark, sf_dir).withColumn("owner", RING.owner(F.col("key")))
    return with_node(owned, members(spark)).groupBy("address").agg(F.count(F.lit(1)).alias("n"))


def _parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = document_keys(spark, sf_dir).select("key", F.lit("put").alias("op"), F.col("key").alias("value"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.col("key").cast("long").alias("seq"))
    return replication.hints(replication.fan_out(writes, RING, 2), members(spark)).select("target_node", "op", "key", "value", "ts", "seq")


_DRAINED = f"{_FANNED}, n AS (SELECT count(*) AS n FROM f WHERE owner = 'node-2') SELECT 'waiting' AS what, n FROM n UNION ALL SELECT 'delivered', n FROM n UNION ALL SELECT 'delivered again', 0 FROM n UNION ALL SELECT 'left', 0 FROM n"


@query("q66_hint_replay", _DRAINED)
def hint_replay(spark, sf_dir):
    """Hints wait, are delivered once when their node is back, and are off the store then."""
    store, delivered = replication.HintStore(spark, scratch_path(spark, "hints")), []
    store.add(_parked(spark, sf_dir))
    found = [("waiting", store.waiting().count())]
    back = _rows(spark, "node_id string", ("node-2",), ("node-3",))
    store.replay(back, lambda df: delivered.append(df.count()))
    found += [("delivered", sum(delivered)), ("delivered again", store.replay(back, lambda df: None)), ("left", store.waiting().count())]
    return spark.createDataFrame(found, "what string, n long")


@query("q67_hint_drain", _DRAINED)
def hint_drain(spark, sf_dir):
    """The same, driven by a stream of status changes, in which the node turns alive twice."""
    store, out, changes = replication.HintStore(spark, scratch_path(spark, "hints")), [], scratch_path(spark, "status")
    store.add(_parked(spark, sf_dir))
    found = [("waiting", store.waiting().count())]
    counts = []
    for rows in ([("node-1", "dead"), ("node-2", "alive")], [("node-2", "alive")]):
        spark.createDataFrame(rows, "node_id string, status string").coalesce(1).write.mode("append").parquet(changes)
        before = sum(out)
        drain_hints(streaming_feed(spark, changes, "node_id string, status string"), store, lambda df: out.append(df.count()), f"{changes}-offsets").awaitTermination()
        counts.append(sum(out) - before)
    found += [("delivered", counts[0]), ("delivered again", counts[1]), ("left", store.waiting().count())]
    return spark.createDataFrame(found, "what string, n long")


@query("q68_hints_and_feed", "SELECT * FROM (VALUES ('a', 'new', 2::BIGINT), ('b', 'hinted', 1)) AS t(key, value, version)")
def hints_and_feed(spark, sf_dir):
    """A hint that comes late never beats a later write."""
    day = lambda n: datetime(2024, 1, n)
    parked = _rows(spark, "target_node string, seq long, op string, ts timestamp, key string, value string", ("n1", 1, "put", day(1), "a", "old"), ("n1", 2, "put", day(2), "b", "hinted"), ("n2", 3, "put", day(3), "c", "waits"))
    later = _rows(spark, "seq long, op string, ts timestamp, key string, value string", (9, "put", day(5), "a", "new"))
    whole, _ = replication.replay_hints(parked, _rows(spark, "node_id string", ("n1",)), later)
    return changelog.fold(whole).select("key", "value", "version")


@query("q79_local_read", f"WITH {_R} SELECT key, 'node-' || (arg_min(pos, CASE WHEN pos = 2 THEN -1 ELSE pos END) + 1) AS served_by, arg_min(value, CASE WHEN pos = 2 THEN -1 ELSE pos END) AS value FROM r WHERE pos <> 1 GROUP BY key")
def local_read(spark, sf_dir):
    """The third node asks itself first."""
    stored = answers(spark, sf_dir).withColumn("node_id", F.concat(F.lit("node-"), (F.col("pos") + 1).cast("string")))
    owned = stored.select("key", F.col("node_id").alias("owner"), F.col("pos").alias("place"))
    return replication.read_with_failover(owned, members(spark), stored.select("key", "node_id", "value"), local="node-3").where(F.col("served_by").isNotNull())


_NODE = "node_id string, address string, status string, last_heartbeat long, version string"


@query("q69_detector_tick", "SELECT * FROM (VALUES ('here', 'alive'), ('quick', 'alive'), ('late', 'suspect'), ('later', 'suspect'), ('gone', 'dead'), ('dead', 'dead')) AS t(node_id, status)")
def detector_tick(spark, sf_dir):
    rows = _rows(spark, "node_id string, status string, silent long", ("here", "alive", 500), ("quick", "alive", 10), ("late", "alive", 11), ("later", "alive", 500), ("gone", "suspect", 21), ("dead", "dead", 0))
    nodes = rows.select("node_id", "status", F.expr("timestamp'2024-01-01 01:00:00' - make_dt_interval(0, 0, 0, silent)").alias("last_heartbeat"))
    return membership.detect(nodes, F.expr("timestamp'2024-01-01 01:00:00'"), 10_000_000, "here").select("node_id", "status")


@query("q70_join_and_leave", "SELECT * FROM (VALUES ('n1', 'b:1', 'alive'), ('n3', 'a:3', 'dead'), ('n4', 'a:4', 'alive')) AS t(node_id, address, status)")
def join_and_leave(spark, sf_dir):
    nodes = _rows(spark, _NODE, ("n1", "a:1", "dead", 1, "v1"), ("n2", "a:2", "alive", 1, "v1"), ("n3", "a:3", "dead", 1, "v1"))
    joining = _rows(spark, _NODE, ("n1", "b:1", "dead", 2, "v1"), ("n4", "a:4", "suspect", 2, "v1"))
    left = membership.leave_cluster(membership.join_cluster(nodes, joining), _rows(spark, "node_id string", ("n2",), ("n9",)))
    return left.select("node_id", "address", "status")


@query("q71_node_list", "SELECT * FROM (VALUES ('members', 3::BIGINT, 'node-1,node-2,node-3'), ('ring of the alive', 2, 'node-1,node-3')) AS t(what, n, ids)")
def node_list(spark, sf_dir):
    found = [r["node_id"] for r in membership.node_list(members(spark)).collect()]
    alive = type(RING).of_members(members(spark)).nodes
    return spark.createDataFrame([("members", len(found), ",".join(found)), ("ring of the alive", len(alive), ",".join(alive))], "what string, n long, ids string")


@query("q72_gossip", "SELECT * FROM (VALUES ('nodes known at first', 1::BIGINT), ('nodes known at last', 8), ('views at last', 1), ('exchanges kept', 8)) AS t(what, n)")
def gossip(spark, sf_dir):
    """Eight nodes that know themselves only; after some cycles of two exchanges all of them know all."""
    views = _rows(spark, f"observer string, {_NODE}", *[(f"n{k}", f"n{k}", f"a:{k}", "alive", k, "v1") for k in range(8)])
    known = lambda df: df.groupBy("observer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node_id", "address", "status", "last_heartbeat", "version").cast("decimal(38,0)")).alias("mark"))
    first = known(views).agg(F.max("n")).first()[0]
    for cycle in range(4):
        views = spark.createDataFrame(membership.gossip_cycle(views, 2, cycle).collect(), views.schema)
    last = known(views).agg(F.min("n").alias("n"), F.countDistinct("mark").alias("views"), F.count(F.lit(1)).alias("kept")).first()
    return spark.createDataFrame([("nodes known at first", first), ("nodes known at last", last["n"]), ("views at last", last["views"]), ("exchanges kept", last["kept"])], "what string, n long")


@query("q73_inbound_gossip", "SELECT * FROM (VALUES ('n1', 'suspect', 'v2', true), ('n2', 'alive', 'v1', true)) AS t(node_id, status, version, replied)")
def inbound_gossip(spark, sf_dir):
    merged, reply = membership.answer_gossip(_rows(spark, _NODE, ("n1", "a:1", "alive", 5, "v1")), _rows(spark, _NODE, ("n1", "a:1", "suspect", 1, "v2"), ("n2", "a:2", "alive", 1, "v1")))
    return merged.join(reply.select("node_id", F.lit(True).alias("replied")), "node_id", "left").select("node_id", "status", "version", "replied")


@query("q74_peers", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, true), (2, 2, true), (9, 3, true)) AS t(fanout, n, eligible)")
def peers(spark, sf_dir):
    """At most so many others, none of them dead."""
    nodes = _rows(spark, _NODE, *[(f"n{k}", "", s, 1, "v1") for k, s in enumerate(["alive", "alive", "dead", "suspect", "alive"])])
    found = [membership.peers(nodes, f, "n0", 3).agg(F.lit(f).cast("long").alias("fanout"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("node_id").isin("n1", "n3", "n4")), F.lit(True)).alias("eligible")) for f in (0, 2, 9)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("q75_quorum_metrics", "SELECT 2::BIGINT AS successful_reads, 1::BIGINT AS successful_writes, 1::BIGINT AS failed_reads, 0::BIGINT AS failed_writes, 3::BIGINT AS read_repairs")
def metrics(spark, sf_dir):
    return replication.quorum_metrics(_rows(spark, "kind string, satisfied boolean", ("read", True), ("read", True), ("read", False), ("write", True), ("repair", None), ("repair", True), ("repair", False)))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("q76_ids", "SELECT * FROM (VALUES (0::BIGINT, '0000000000', 26::BIGINT), (1469918176385, '01ARYZ6S41', 26), (281474976710655, '7ZZZZZZZZZ', 26)) AS t(ms, time, length)")
def ids(spark, sf_dir):
    """The time part of ids of known moments, and their length."""
    found = [(ms, scalars.new_id(ms)) for ms in (0, 1469918176385, 281474976710655)]
    return spark.createDataFrame([(ms, x[:10], len(x)) for ms, x in found], "ms long, time string, length long")


@query("q77_scalars", """SELECT * FROM (VALUES ('status', 'DEAD', 'dead'), ('status', 'Suspect', 'suspect'), ('status', 'nonsense', 'alive'), ('uptime', '93784', '1d02h03m04s'), ('uptime', '-5', '0d00h00m00s'), ('uptime', '59', '0d00h00m59s'),
('content', ' Application/JSON ; charset=utf-8', 'application/json'), ('content', 'text/plain', 'text/plain'), ('content', '', ''), ('elapsed', '1500000', '1500000'), ('version', 'v10 v9', '1'), ('version', 'cluster/v2 v2', '0'), ('version', 'x v2', '1'), ('version', ' v1', '-1')) AS t(what, given, found)""")
def scalar_functions(spark, sf_dir):
    rows = [("status", x) for x in ("DEAD", "Suspect", "nonsense")] + [("uptime", x) for x in ("93784", "-5", "59")] + [("content", x) for x in (" Application/JSON ; charset=utf-8", "text/plain", "")] + [("elapsed", "1500000")] + [("version", x) for x in ("v10 v9", "cluster/v2 v2", "x v2", " v1")]
    given = F.col("given")
    moment = F.expr("timestamp'2024-01-01 00:00:00'")
    pair = F.split(given, " ")
    found = (
        F.when(F.col("what") == "status", scalars.parse_status(given))
        .when(F.col("what") == "uptime", scalars.uptime_text(given.try_cast("long")))
        .when(F.col("what") == "content", scalars.content_type(given))
        .when(F.col("what") == "elapsed", scalars.since_micros(F.timestamp_micros(F.unix_micros(moment) + given.try_cast("long")), moment).cast("string"))
        .otherwise(scalars.compare_versions(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))).cast("string"))
    )
    return spark.createDataFrame(rows, "what string, given string").withColumn("found", found)


@query("q78_raw_get", _FOLD.format(", op = 'delete' AS deleted", " AND key = (SELECT min(key) FROM (SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) = 'error'))"))
def raw_get(spark, sf_dir):
    """A deleted key, tombstone and all."""
    view = KeyValueView(changelog.fold(feed(spark, sf_dir), tombstones=True))
    gone = view.df.where("deleted").agg(F.min("key").alias("key")).first()["key"]
    return _state(view.get_raw(gone) if gone else view.df.limit(0), "deleted")
