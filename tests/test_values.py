import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.values import number_key, number_of, number_text, value_text


@pytest.mark.parametrize(
    ("x", "text"),
    [(0.0, "0"), (22.0, "22"), (100000.0, "100000"), (1e6, "1e+06"), (123456789.0, "1.23456789e+08"), (0.5, "0.5"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-3.25, "-3.25"), (1e21, "1e+21"), (5e-324, "5e-324"), (12345.678, "12345.678")],
)
def test_number_text(x, text):
    assert number_text(x) == text
    assert number_of(text) == x


def test_texts_that_are_no_numbers():
    for text in ("22.0", "1000000", "nan", "inf", "1_0", " 1", "", "0x1", "+1", "1e6"):
        assert number_of(text) is None, text


def test_value_text():
    assert [value_text(v) for v in ("a", 22, 22.0, True, False, None, [1], {"a": 1})] == ["a", "22", "22", "true", "false", "<nil>", None, None]


def test_number_key_agrees_with_number_text(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1000, 1000) for _ in range(300)] + [round(rng.uniform(0, 1e5), 2) for _ in range(300)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)) if math.isfinite(x) and 1e-15 < abs(x) < 1e16]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", number_key(F.col("x")).alias("t")).collect()
    assert all(r["t"] == number_text(r["x"]) for r in rows)


def test_hashes(spark):
    rows = spark.createDataFrame([("",), ("a",), ("doc1",), ("doc2",), ("alpha",)], "k string")
    assert [r[0] for r in rows.select(scalars.fnv1a32(F.col("k"))).collect()] == [2166136261, 3826002220, 1726715500, 1777048357, 1569418667]
    keys = spark.createDataFrame([("alpha",), ("beta",), ("key-1",), ("0",)], "k string")
    assert [r[0] for r in keys.select(scalars.crc32_key(F.col("k"))).collect()] == [3504355690, 2408645731, 250396538, 4108050209]
    assert scalars.vnode_hash("node-1", 0) == 4035664660
    assert scalars.vnode_hash("node-1", 80) == 52080820
    assert scalars.vnode_hash("node-3", 80) == 2836625471


def test_versions_statuses_quorums(spark):
    pairs = [("v1", "v2", -1), ("cluster/v10", "v9", 1), ("", "v0", -1), ("v1", "v1", 0), ("abc", "abd", -1), ("v1", "", 1), ("v2", "x", -1)]
    rows = spark.createDataFrame(pairs, "a string, b string, c int").select("c", scalars.compare_versions(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["c"] == r["got"] for r in rows)
    statuses = spark.createDataFrame([("ALIVE",), ("Suspect",), ("dead",), ("other",)], "s string").select(scalars.parse_status(F.col("s"))).collect()
    assert [r[0] for r in statuses] == ["alive", "suspect", "dead", "alive"]
    levels = [("QUORUM", n, n // 2 + 1) for n in range(1, 7)] + [("ONE", 3, 1), ("ALL", 3, 3), ("ALL", 0, 1), ("QUORUM", 0, 1), ("other", 5, 1)]
    rows = spark.createDataFrame(levels, "l string, n int, want long").select("want", scalars.quorum_size(F.col("l"), F.col("n")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_uptime_and_ids(spark):
    rows = spark.createDataFrame([(93784,), (-5,), (59,)], "s long").select(scalars.uptime_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["1d02h03m04s", "0d00h00m00s", "0d00h00m59s"]
    first, second = scalars.new_id(1000), scalars.new_id(2000)
    assert len(first) == 26 and first < second
    kind = spark.createDataFrame([(" Application/JSON ; charset=x",), ("",)], "h string").select(scalars.content_type(F.col("h"))).collect()
    assert [r[0] for r in kind] == ["application/json", ""]
