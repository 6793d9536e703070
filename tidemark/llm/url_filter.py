"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every URL is expanded into the expressions that a rule could consist of (each
label-aligned suffix of its host, combined with each prefix of its path whose
length occurs among the rules), the first 32 bits of the expressions' SHA-256
are equi-joined with those of the rules, full digests confirm the matches, and
the longest rule wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; an empty host fits none either. Two rules of equal length are
ranked by longer host, then block before allow, then host and path. Repeated
rules count once. Repeated pages, null ids and extra columns pass through; an
extra column with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.coalesce(rest, F.lit(""))
    no_query = F.substring_index(rest, "?", 1)
    raw_host = F.substring_index(no_query, "/", 1)
    host = F.translate(raw_host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.substring(no_query, F.length(raw_host) + 1, F.length(no_query))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _suffixes(host: str, most: int) -> Column:
    """The last 1, 2, ... labels of the column ``host``, up to ``most``."""
    return F.expr(f"transform(sequence(1, least(length({host}) - length(replace({host}, '.', '')) + 1, {most})), k -> substring_index({host}, '.', -k))")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` has host, path and verdict (block or allow) and may be of any
    size: it is never broadcast by a hint, Spark's size estimate decides. The
    lengths of rule paths come to the driver; they are as many as the longest
    path has characters. So does the number of labels of the longest rule host: no longer suffix can match, so a host
    of any number of labels is expanded in time proportional to its length. Matching runs once for each distinct host and path, so
    that a URL on a third of all rows is expanded once.
    """
    host, path = split_url(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")
    ).where((F.col("_h") != "") & F.col("_v").isin("block", "allow")).distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("_p")).distinct().collect())
    labels = rules.agg(F.max(F.length("_h") - F.length(F.replace(F.col("_h"), F.lit("."), F.lit("")))) + 1).first()[0] or 1
    rules = rules.select("*", _digest(F.col("_h"), F.col("_p")).alias("_full")).withColumn("_short", F.substring("_full", 1, 8))
    urls = pages.select("host", "path").distinct().where(F.col("host") != "")
    expressions = (
        urls.select("host", "path", F.explode(_suffixes("host", labels)).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n"))
        .where((F.length("path") >= F.col("_n")) & (F.col("_suffix") != ""))
        .select("host", "path", _digest(F.col("_suffix"), F.expr("substring(path, 1, _n)")).alias("_digest"))
        .withColumn("_prefix", F.substring("_digest", 1, 8))
    )
    length = F.length("_h") + F.length("_p")
    rank = F.struct(length, F.length("_h"), (F.col("_v") == "block").cast("int"), "_h", "_p")
    best = (
        expressions.join(rules, F.col("_prefix") == F.col("_short"))
        .where(F.col("_digest") == F.col("_full"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict")), rank).alias("tidemark__best"))
    )
    joined = pages.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path")]
    return joined.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("tidemark__best.rule").alias("rule"), F.coalesce("tidemark__best.verdict", F.lit(default)).alias("verdict"))


#: The rules of op9: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the five fixed rules; without a rule a URL is allowed."""
    from ..runtime import table

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS rules(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, CASE WHEN rest IS NULL THEN '' ELSE split_part(rest, '/', 1) END AS raw, coalesce(rest, '') AS rest FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path FROM s),
r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
d AS (SELECT DISTINCT host, path FROM h),
m AS (SELECT host, path, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(rv, length(rh) + length(rp)) AS verdict
      FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, h.host AS host, h.path AS path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path
"""
