"""Scalar functions of the engine as expressions: hashes, versions, statuses, quorums, durations."""

from __future__ import annotations

import os
import time
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Fixed value: Crockford's alphabet.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def crc32_key(key: Column) -> Column:
    """CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(F.encode(key, "utf-8"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a, 32 bits, of a text's UTF-8 bytes."""
    digits = F.hex(F.encode(text, "utf-8"))
    length = F.octet_length(text)
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)))


def vnode_hash(node: str, replica: int) -> int:
    """The position of a node's virtual node: the replica number is one code point from '0' on."""
    return zlib.crc32(f"{node}#{chr(48 + replica)}".encode())


def new_id(now_ms: int | None = None) -> str:
    """A sortable id: 48 bits of time, 80 random bits, in Crockford's base 32."""
    n = ((int(time.time() * 1000) if now_ms is None else now_ms) << 80) | int.from_bytes(os.urandom(10))
    return "".join(CROCKFORD[n >> 5 * k & 31] for k in reversed(range(26)))


def version_number(version: Column) -> Column:
    """The number of a version like ``cluster/v12`` or ``v3``; null if there is none."""
    return F.regexp_replace(version, r"^(cluster/)?v?", "").try_cast("long")


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: equal texts are equal, the empty one is lowest, numbers compare as numbers, all else as text."""
    x, y = version_number(a), version_number(b)
    numbers = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    texts = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(a == b, 0).when(a == "", -1).when(b == "", 1).when(x.isNotNull() & y.isNotNull(), numbers).otherwise(texts)


def parse_status(status: Column) -> Column:
    """alive, suspect or dead in any case; anything else is alive."""
    low = F.lower(status)
    return F.when(low.isin("suspect", "dead"), low).otherwise(F.lit("alive"))


def status_rank(status: Column) -> Column:
    return F.when(status == "alive", 3).when(status == "suspect", 2).when(status == "dead", 1).otherwise(0)


def quorum_size(level: Column, replicas: Column) -> Column:
    """Acknowledgements that a level needs of so many replicas (at least one)."""
    n = F.greatest(replicas, F.lit(1))
    return F.when(level == "QUORUM", F.floor(n / 2) + 1).when(level == "ALL", n).otherwise(1).cast("long")


def uptime_text(seconds: Column) -> Column:
    """``1d02h03m04s``; negative durations count as none."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    day, hour, minute = (F.floor(s / F.lit(n)) for n in (86400, 3600, 60))
    return F.format_string("%dd%02dh%02dm%02ds", day, hour % 24, minute % 60, s % 60)


def since_micros(now: Column, then: Column) -> Column:
    """Microseconds from ``then`` to ``now``."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))


def content_type(header: Column) -> Column:
    """The media type of a header: before the first ``;``, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(header, ";", 1)))
