"""The query catalogue of the document, key-value and change-log operators, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a32
from ..functions.values import number_key
from ..operators import changelog, membership, replication
from ..operators.documents import DocumentCollection, latest, parse_documents
from ..operators.kv import KeyValueView
from ..operators.placement import Ring, moved_keys
from ..runtime import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import services  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import services  # noqa: F401

    return dict(_SQL)


# --- collections -----------------------------------------------------------------------------------------------------

FIELDS = ["event_type", "user_id", "value"]
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``_id``, their number as 12 digits."""
    return table(spark, sf_dir, "events").withColumn("_id", F.lpad(F.col("event_id").cast("string"), 12, "0"))


def event_documents(spark: SparkSession, sf_dir: str) -> DocumentCollection:
    return DocumentCollection(events(spark, sf_dir).select("_id", *FIELDS, "props"), FIELDS)


def variant_documents(spark: SparkSession, sf_dir: str) -> DocumentCollection:
    """The same documents without a schema; ``props`` is a nested object."""
    rows = events(spark, sf_dir)
    body = F.concat(F.regexp_replace(F.to_json(F.struct(*FIELDS)), r"\}$", ""), F.lit(',"props":'), F.col("props"), F.lit("}"))
    return DocumentCollection(rows.select("_id", F.try_parse_json(body).alias("doc")))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of users: an error deletes, any other event puts its props."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "ts", F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


def time_text(column: str) -> Column:
    return F.date_format(column, TIME)


_E = "e AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, event_type, user_id, value, props FROM events)"


def _found(collection: DocumentCollection, *args, **options) -> DataFrame:
    return collection.find(*args, **options).select("_id", *FIELDS)


def _ranked(df: DataFrame) -> DataFrame:
    """A rank for a page of sorted documents; pages are small."""
    rows = df.coalesce(1).select("*", F.monotonically_increasing_id().alias("n"))
    return rows.select("_id", *FIELDS, (F.col("n") + 1).cast("long").alias("rank"))


# --- find ------------------------------------------------------------------------------------------------------------


@query("q01_find", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE event_type = 'click'")
def find(spark, sf_dir):
    return _found(event_documents(spark, sf_dir), "event_type", "click")


@query("q02_find_number_by_text", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE user_id = 8")
def find_number_by_text(spark, sf_dir):
    return _found(event_documents(spark, sf_dir), "user_id", "8")


@query("q02v_find_number_in_variant", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE user_id = 8")
def find_number_in_variant(spark, sf_dir):
    found = variant_documents(spark, sf_dir).find("user_id", "8")
    return found.select("_id", F.try_variant_get("doc", "$.event_type", "string").alias("event_type"), F.try_variant_get("doc", "$.user_id", "bigint").alias("user_id"), F.try_variant_get("doc", "$.value", "double").alias("value"))


@query("q03_find_sorted_page", f"WITH {_E} SELECT _id, event_type, user_id, value, CAST(row_number() OVER (ORDER BY value NULLS LAST, _id) AS BIGINT) - 5 AS rank FROM e WHERE event_type = 'click' QUALIFY rank BETWEEN 1 AND 10")
def find_sorted_page(spark, sf_dir):
    return _ranked(event_documents(spark, sf_dir).find("event_type", "click", limit=10, offset=5, sort="value"))


@query("q04_find_sorted_descending", f"WITH {_E} SELECT _id, event_type, user_id, value, CAST(row_number() OVER (ORDER BY user_id DESC NULLS LAST, _id) AS BIGINT) AS rank FROM e WHERE event_type = 'purchase' QUALIFY rank <= 50")
def find_sorted_descending(spark, sf_dir):
    return _ranked(event_documents(spark, sf_dir).find("event_type", "purchase", limit=50, sort="-user_id"))


@query("q05_sort_missing_last", """WITH e AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, event_type, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events WHERE event_type = 'signup'),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, _id) - greatest((SELECT count(value) FROM e) - 10, 0) AS rank FROM e) SELECT _id, event_type, user_id, value, rank FROM r WHERE rank BETWEEN 1 AND 25""")
def sort_missing_last(spark, sf_dir):
    """The page on which the values end and the documents without one begin."""
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    documents = DocumentCollection(rows.select("_id", *FIELDS), FIELDS)
    present = documents.df.where(documents.matches("event_type", "signup")).agg(F.count("value")).first()[0]
    return _ranked(documents.find("event_type", "signup", sort="-value", offset=max(present - 10, 0), limit=25))


@query("q06_sort_unknown_field", f"WITH {_E} SELECT _id, event_type, user_id, value, CAST(row_number() OVER (ORDER BY _id) AS BIGINT) AS rank FROM e WHERE event_type = 'view' QUALIFY rank <= 20")
def sort_unknown_field(spark, sf_dir):
    return _ranked(event_documents(spark, sf_dir).find("event_type", "view", limit=20, sort="nope"))


@query("q07_empty_pages", "SELECT 'limit 0' AS page, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'offset beyond', 0")
def empty_pages(spark, sf_dir):
    documents = event_documents(spark, sf_dir)
    pages = [("limit 0", documents.find("event_type", "click", limit=0)), ("offset beyond", documents.find("event_type", "click", offset=100_000_000, limit=10))]
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("page"), "n") for name, rows in pages]
    return counts[0].unionByName(counts[1])


@query("q08_nested_never_matches", """SELECT 'nested' AS kind, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'scalar', count(*) FROM events WHERE event_type = 'click'""")
def nested_never_matches(spark, sf_dir):
    documents = variant_documents(spark, sf_dir)
    nested = documents.df.where(documents.matches("props", "map[k:87]") | documents.matches("props", '{"k":87}') | documents.matches("_id", "000000000001"))
    scalar = documents.df.where(documents.matches("event_type", "click"))
    return nested.agg(F.lit("nested").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(scalar.agg(F.lit("scalar").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("q09_find_null", "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, user_id FROM events WHERE event_id % 7 = 0")
def find_null(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return DocumentCollection(rows.select("_id", *FIELDS), FIELDS).find("value", None).select("_id", "user_id")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("q10_count", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase'")
def count(spark, sf_dir):
    return event_documents(spark, sf_dir).aggregate("event_type", "purchase", "count")


def _aggregate(name: str, spec: str, sql: str, column: str) -> None:
    @query(name, f"SELECT 'value' AS field, {sql} AS {column} FROM events WHERE event_type = 'purchase'")
    def run(spark, sf_dir):
        found = event_documents(spark, sf_dir).aggregate("event_type", "purchase", spec)
        return found.select("field", F.round(column, 4).alias(column))


_aggregate("q11_sum", "sum:value", "round(sum(value), 4)", "sum")
_aggregate("q12_average", "avg:value", "round(avg(value), 4)", "average")
_aggregate("q13_minimum", "min:value", "round(min(value), 4)", "minimum")
_aggregate("q14_maximum", "max:value", "round(max(value), 4)", "maximum")


@query("q15_numbers_only", "SELECT 'amount' AS field, CAST(sum(CASE WHEN event_id % 2 = 0 THEN user_id END) AS DOUBLE) AS sum FROM events")
def numbers_only(spark, sf_dir):
    amount = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"all":true,"amount":'), F.col("user_id").cast("string"), F.lit("}")))
    body = F.coalesce(amount, F.concat(F.lit('{"all":true,"amount":"'), F.col("user_id").cast("string"), F.lit('"}')))
    documents = DocumentCollection(events(spark, sf_dir).select("_id", F.try_parse_json(body).alias("doc")))
    return documents.aggregate("all", True, "sum:amount")


@query("q16_no_numbers", "SELECT 'event_type' AS field, CAST(NULL AS DOUBLE) AS sum")
def no_numbers(spark, sf_dir):
    return event_documents(spark, sf_dir).aggregate("event_type", "click", "sum:event_type")


# --- index -----------------------------------------------------------------------------------------------------------


@query("q17_index", "SELECT 'event_type' AS field, event_type AS value_key, count(*) AS n_ids FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id")
def index(spark, sf_dir):
    return DocumentCollection(events(spark, sf_dir).select("_id", "event_type", "user_id"), ["event_type", "user_id"]).index()


@query("q17v_index_of_variants", "SELECT 'event_type' AS field, event_type AS value_key, count(*) AS n_ids FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id")
def index_of_variants(spark, sf_dir):
    return variant_documents(spark, sf_dir).index().where(F.col("field") != "value")


@query("q18_indexed_fields", "SELECT unnest(['event_type', 'user_id', 'value']) AS field")
def indexed_fields(spark, sf_dir):
    return variant_documents(spark, sf_dir).indexed_fields()


@query("q39_number_text", """SELECT * FROM (VALUES (0, '0'), (1, '22'), (2, '-3.25'), (3, '100000'), (4, '1e+06'), (5, '1.23456789e+08'), (6, '0.5'), (7, '0.0001'), (8, '1e-05'), (9, '12345.678'), (10, '1e+21')) AS t(n, text)""")
def number_texts(spark, sf_dir):
    values = ", ".join(f"({k}, {x!r}D)" for k, x in enumerate([0.0, 22.0, -3.25, 100000.0, 1e6, 123456789.0, 0.5, 0.0001, 0.00001, 12345.678, 1e21]))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(n, x)").select("n", number_key(F.col("x")).alias("text"))


# --- keys and values -------------------------------------------------------------------------------------------------


def order_keys(spark: SparkSession, sf_dir: str) -> KeyValueView:
    rows = table(spark, sf_dir, "orders")
    return KeyValueView(rows.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value")), deleted=None)


_K = "k AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders)"


@query("q19a_scan_prefix", f"WITH {_K} SELECT * FROM k WHERE starts_with(key, '12')")
def scan_prefix(spark, sf_dir):
    return order_keys(spark, sf_dir).scan(prefix="12")


@query("q19b_scan_range", f"WITH {_K} SELECT * FROM k WHERE key >= '20' AND key < '31'")
def scan_range(spark, sf_dir):
    return order_keys(spark, sf_dir).scan(start="20", end="31")


@query("q19c_scan_reverse_limit", f"WITH {_K} SELECT * FROM k WHERE starts_with(key, '1') ORDER BY key DESC LIMIT 25")
def scan_reverse_limit(spark, sf_dir):
    return order_keys(spark, sf_dir).scan(prefix="1", reverse=True, limit=25)


@query("q19d_scan_limit", f"WITH {_K} SELECT * FROM k ORDER BY key LIMIT 40")
def scan_limit(spark, sf_dir):
    return order_keys(spark, sf_dir).scan(limit=40)


_FOLD = """WITH m AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, ts, CAST(user_id AS VARCHAR) AS key, props AS value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY key) AS version, min(ts) OVER (PARTITION BY key) AS first_ts FROM m)
SELECT key, CASE WHEN op = 'put' THEN value END AS value, version, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at{0} FROM r WHERE k = 1{1}"""


def _state(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "value", "version", time_text("created_at").alias("created_at"), time_text("updated_at").alias("updated_at"), *more)


@query("q20_fold", _FOLD.format("", " AND op = 'put'"))
def fold(spark, sf_dir):
    return _state(changelog.fold(feed(spark, sf_dir)))


@query("q20r_fold_replay", """WITH m AS (SELECT event_id AS seq, event_type = 'error' AS gone, ts, CAST(user_id AS VARCHAR) AS key, props AS value FROM events),
g AS (SELECT *, max(CASE WHEN gone THEN (ts, seq) END) OVER (PARTITION BY key) AS last_gone FROM m),
l AS (SELECT * FROM g WHERE last_gone IS NULL OR (ts, seq) > last_gone)
SELECT key, arg_max(value, (ts, seq)) AS value, count(*) AS version, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM l GROUP BY key""")
def fold_replay(spark, sf_dir):
    return _state(changelog.fold(feed(spark, sf_dir), semantics="replay"))


@query("q21_tombstones", _FOLD.format(", op = 'delete' AS deleted", ""))
def tombstones(spark, sf_dir):
    return _state(changelog.fold(feed(spark, sf_dir), tombstones=True), "deleted")


@query("q22_recover", _FOLD.format("", " AND op = 'put'"))
def recover(spark, sf_dir):
    log = feed(spark, sf_dir)
    middle = log.agg(F.expr("timestampadd(SECOND, CAST(timestampdiff(SECOND, min(ts), max(ts)) / 2 AS INT), min(ts))").alias("t")).first()["t"]
    snapshot = changelog.fold(log.where(F.col("ts") < F.lit(middle).cast("timestamp_ntz")), tombstones=True)
    return _state(changelog.recover(snapshot, log, F.lit(middle).cast("timestamp_ntz")))


@query("q23_stats", """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_id)) AS t, arg_max(props, (ts, event_id)) AS v FROM events GROUP BY user_id)
SELECT count(*) AS keys, count(*) FILTER (t <> 'error') AS live_keys, CAST(sum(strlen(key) + CASE WHEN t <> 'error' THEN strlen(v) ELSE 0 END) AS BIGINT) AS bytes FROM f""")
def stats(spark, sf_dir):
    return KeyValueView(changelog.fold(feed(spark, sf_dir), tombstones=True)).stats()


@query("q36_live_documents", """SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS _id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'""")
def live_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    changes = rows.select(F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("_id"), "event_type", "value")
    return latest(changes)


@query("q37_existing_and_absent", "WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents) SELECT 'existing' AS kind, count(*) AS n FROM k WHERE key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) UNION ALL SELECT 'absent', count(*) FROM k WHERE key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def existing_and_absent(spark, sf_dir):
    view = KeyValueView(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("toxic").alias("value")), deleted=None)
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))
    count_of = lambda kind, rows: rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count_of("existing", view.existing(keys)).unionByName(count_of("absent", view.absent(keys)))


@query("q38_find_one", f"WITH {_E} SELECT _id, event_type, user_id, value FROM e WHERE event_type = 'signup' ORDER BY _id LIMIT 1")
def find_one(spark, sf_dir):
    return event_documents(spark, sf_dir).find_one("event_type", "signup").select("_id", *FIELDS)


# --- placement -------------------------------------------------------------------------------------------------------

NODES = ["node-1", "node-2", "node-3"]
RING = Ring.build(NODES)


def _crc_sql(data: str) -> str:
    """CRC-32 of a list of bytes."""
    step = "list_reduce(list_prepend(xor(a, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda k, j: CASE WHEN (k & 1) = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, x: {step}), 4294967295::BIGINT)"


_ASCII = "list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, CAST(i AS BIGINT), 1))::BIGINT)"
#: Keys and their hashes.
_KEYS = f"k AS (SELECT key, {_crc_sql(_ASCII.format('key'))} AS h FROM (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents))"
#: The ring of three nodes: 100 places each, at the hash of the node's name, #, and the code point 48 + place, which from 128 on is two bytes.
_PLACES = f"""all_places AS (SELECT n, {_crc_sql("list_concat(" + _ASCII.format("n || '#'") + ", CASE WHEN 48 + i < 128 THEN [48 + i] ELSE [192 + ((48 + i) >> 6), 128 + ((48 + i) & 63)] END::BIGINT[])")} AS h
  FROM (SELECT unnest(['node-1', 'node-2', 'node-3']) AS n) CROSS JOIN range(100) AS t(i)),
ring AS (SELECT h, min(n) AS n FROM all_places GROUP BY h), less AS (SELECT h, min(n) AS n FROM all_places WHERE n <> 'node-2' GROUP BY h),
pairs AS (SELECT r.h, r.n, arg_min(s.n, (s.h - r.h + 4294967296) % 4294967296) AS second FROM ring r JOIN ring s ON s.n <> r.n GROUP BY ALL)"""
_CRC = f"{_KEYS}, {_PLACES}"


def _owned_sql(name: str, ring: str) -> str:
    """The first place from a key's hash on, the first of all after the last."""
    return f"{name} AS (SELECT k.key, coalesce(r.n, (SELECT arg_min(n, h) FROM {ring})) AS owner FROM k ASOF LEFT JOIN {ring} r ON r.h >= k.h)"


_OWNED = _owned_sql("o", "ring")


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))


@query("q24_owners", f"WITH {_CRC}, {_OWNED} SELECT owner, count(*) AS n FROM o GROUP BY owner")
def owners(spark, sf_dir):
    return document_keys(spark, sf_dir).groupBy(RING.owner(F.col("key")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


_LESS = RING.without("node-2")


@query("q25_moved_keys", f"WITH {_CRC}, {_OWNED}, {_owned_sql('p', 'less')} SELECT o.owner AS owner_before, p.owner AS owner_after, count(*) AS n FROM o JOIN p USING (key) WHERE o.owner <> p.owner GROUP BY ALL")
def moved(spark, sf_dir):
    return moved_keys(document_keys(spark, sf_dir), "key", RING, _LESS).groupBy("owner_before", "owner_after").agg(F.count(F.lit(1)).alias("n"))


_FANNED = f"""WITH {_CRC}, w AS (SELECT arg_min((n, second), h) AS first FROM pairs),
o AS (SELECT k.key, coalesce(r.n, w.first[1]) AS one, coalesce(r.second, w.first[2]) AS two FROM k ASOF LEFT JOIN pairs r ON r.h >= k.h CROSS JOIN w),
f AS (SELECT key, one AS owner, 'primary' AS role FROM o UNION ALL SELECT key, two, 'replica' FROM o)"""


@query("q26_fan_out", f"{_FANNED} SELECT owner, role, count(*) AS n FROM f GROUP BY ALL")
def fan_out(spark, sf_dir):
    return replication.fan_out(document_keys(spark, sf_dir), RING, 2).groupBy("owner", "role").agg(F.count(F.lit(1)).alias("n"))


def members(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('node-1', 'a:1', 'alive', 'v1'), ('node-2', 'a:2', 'dead', 'v1'), ('node-3', 'a:3', 'alive', 'v2') AS t(node_id, address, status, version)")


@query("q27_hints", f"{_FANNED} SELECT owner AS target_node, count(*) AS n FROM f WHERE owner = 'node-2' GROUP BY owner")
def parked_writes(spark, sf_dir):
    return replication.pending(replication.hints(replication.fan_out(document_keys(spark, sf_dir), RING, 2), members(spark)))


@query("q34_shards", """SELECT CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, CAST(i AS BIGINT), 1))::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 16 AS BIGINT) AS shard, count(*) AS n
FROM (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents) GROUP BY shard""")
def shards(spark, sf_dir):
    return document_keys(spark, sf_dir).groupBy((fnv1a32(F.col("key")) % 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


# --- replicas --------------------------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas answer for each user: the latest event type among those of their slot."""
    rows = table(spark, sf_dir, "events").withColumn("pos", (F.col("event_id") % 3).cast("int"))
    return rows.groupBy(F.col("user_id").alias("key"), "pos").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


_R = "r AS (SELECT user_id AS key, CAST(event_id % 3 AS INTEGER) AS pos, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY ALL)"
_M = "c AS (SELECT key, value, count(*) AS votes, min(pos) AS seen FROM r GROUP BY ALL), m AS (SELECT key, value AS canonical, votes FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY votes DESC, seen) = 1)"


@query("q28a_majority", f"WITH {_R}, {_M} SELECT * FROM m")
def majority(spark, sf_dir):
    return replication.majority(answers(spark, sf_dir))


@query("q28b_divergent", f"WITH {_R}, {_M} SELECT r.key, pos, value, canonical FROM r JOIN m USING (key) WHERE value <> canonical")
def divergent(spark, sf_dir):
    return replication.divergent(answers(spark, sf_dir)).select("key", "pos", "value", "canonical")


@query("q29_failover", f"WITH {_R} SELECT key, 'node-' || (arg_min(pos, pos) + 1) AS served_by, arg_min(value, pos) AS value FROM r WHERE pos <> 1 GROUP BY key")
def failover(spark, sf_dir):
    stored = answers(spark, sf_dir).withColumn("node_id", F.concat(F.lit("node-"), (F.col("pos") + 1).cast("string")))
    owned = stored.select("key", F.col("node_id").alias("owner"), F.col("pos").alias("place"))
    return replication.read_with_failover(owned, members(spark), stored.select("key", "node_id", "value")).where(F.col("served_by").isNotNull())


@query("q30_node_status", """WITH b AS (SELECT CAST(user_id % 8 AS VARCHAR) AS node_id, max(ts) AS last FROM events WHERE event_id % 50 < 42 - user_id % 8 * 5 GROUP BY ALL), n AS (SELECT max(ts) AS t FROM events)
SELECT node_id, CASE WHEN date_diff('microsecond', last, t) > 120000000 THEN 'dead' WHEN date_diff('microsecond', last, t) > 60000000 THEN 'suspect' ELSE 'alive' END AS status FROM b CROSS JOIN n""")
def node_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    beats = membership.heartbeats(rows.where(F.expr("event_id % 50 < 42 - user_id % 8 * 5")).select((F.col("user_id") % 8).cast("string").alias("node_id"), "ts"))
    now = rows.agg(F.max("ts").alias("now"))
    elapsed = F.expr("timestampdiff(MICROSECOND, last_heartbeat, now)")
    return beats.join(now).select("node_id", membership.settled_status(elapsed, 60_000_000).alias("status"))


_LOCAL = "('n1', 'a:1', 'alive', 100, 'v1'), ('n2', 'a:2', 'suspect', 100, 'v1'), ('n3', 'a:3', 'dead', 100, 'v2'), ('n4', 'a:4', 'alive', 100, 'cluster/v3'), ('n6', 'a:6', 'suspect', 100, 'v1')"
_REMOTE = "('n1', 'a:1', 'suspect', 200, 'v1'), ('n2', 'a:9', 'alive', 200, 'v1'), ('n3', 'a:3', 'alive', 50, 'v3'), ('n4', 'a:4', 'dead', 300, 'cluster/v2'), ('n5', 'a:5', 'alive', 10, 'v1'), ('n6', '', 'alive', 90, 'v1')"


@query("q31_merge_members", "SELECT * FROM (VALUES ('n1', 'a:1', 'alive', 200::BIGINT, 'v1'), ('n2', 'a:9', 'alive', 200, 'v1'), ('n3', 'a:3', 'alive', 50, 'v3'), ('n4', 'a:4', 'alive', 100, 'cluster/v3'), ('n5', 'a:5', 'alive', 10, 'v1'), ('n6', 'a:6', 'suspect', 100, 'v1')) AS t(node_id, address, status, last_heartbeat, version)")
def merge_members(spark, sf_dir):
    rows = lambda values: spark.sql(f"SELECT node_id, address, status, CAST(last_heartbeat AS BIGINT) AS last_heartbeat, version FROM VALUES {values} AS t(node_id, address, status, last_heartbeat, version)")
    return membership.merge_states(rows(_LOCAL), rows(_REMOTE))


@query("q32_leader", "SELECT min(CAST(user_id AS VARCHAR)) AS leader FROM events WHERE event_type = 'purchase'")
def leader(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("node_id"), F.when(F.col("event_type") == "purchase", "alive").otherwise("dead").alias("status"))
    return membership.leader(nodes)


@query("q33_quorum", """WITH a AS (SELECT user_id AS key, CAST(least(count(*) FILTER (event_type <> 'error'), 3) AS BIGINT) AS acks FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id),
l(level, required) AS (VALUES ('ONE', 1::BIGINT), ('QUORUM', 2), ('ALL', 3)) SELECT level, required, acks >= required AS satisfied, count(*) AS n FROM a CROSS JOIN l GROUP BY ALL""")
def quorum(spark, sf_dir):
    first = changelog_first(table(spark, sf_dir, "events"), 3)
    acks = first.select(F.col("user_id").alias("key"), (F.col("event_type") != "error").alias("acked"))
    found = [replication.quorum_reached(acks, level, 3).withColumn("level", F.lit(level)) for level in ("ONE", "QUORUM", "ALL")]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("level", "required", "satisfied").agg(F.count(F.lit(1)).alias("n"))


def changelog_first(rows: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where(F.col("k") <= n)


@query("q35_validation", """SELECT CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'empty document' WHEN 2 THEN 'invalid json' WHEN 3 THEN 'invalid json' ELSE 'empty document' END AS outcome, count(*) AS n FROM events GROUP BY outcome""")
def validation(spark, sf_dir):
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.col("props")).when(k == 1, "{}").when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(k == 3, F.concat(F.col("props"), F.lit("}"))).otherwise("null")
    parsed = parse_documents(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return parsed.groupBy(F.coalesce("problem", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("q40_streaming_fold", _FOLD.format("", " AND op = 'put'"))
def streaming_fold(spark, sf_dir):
    """The log as a stream of files into published snapshots; equal to the batch fold."""
    from ..streaming.changes import fold_stream, streaming_feed

    source = scratch_path(spark, "feed")
    feed(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(source)
    stream = streaming_feed(spark, source, spark.read.parquet(source).schema)
    folder = scratch_path(spark, "snapshots")
    fold_stream(spark, stream, folder, scratch_path(spark, "offsets")).awaitTermination()
    state, _ = changelog.load_snapshot(spark, folder)
    return _state(state.where(~F.col("deleted")))
