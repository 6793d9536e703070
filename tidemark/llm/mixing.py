"""Mixing sources to target weights: capped water-filling and seeded repetitions, DataFrame operations only.

Each source has a weight and a cap of ``max_epochs`` times its size. Sources whose share by weight is above their cap are clamped,
and the excess is shared among the others by weight, until none is above; each round is one aggregation over the
table of sources, which may have any number of rows.

Sampling takes whole documents: floor(target / size) times all of them, and for
the fraction those that come first in a seeded hash order of id and text. Where it ends is found digit by digit of the hash:
sizes are summed by the first ``DIGITS`` digits, then below the prefix in which the fraction ends by the next, and at last by the whole
hash. So no task orders more than 16 ** DIGITS sums a source, or the 16 ** -(DIGITS * LEVELS) part of it, and each document is
then decided by comparing its hash with its source's last one. Words are counted twice: once for the narrow table of (source, hash,
size), from which all of this is found, and once for the result.

Defined cases: a null text has size 0; a null source is one source, ranked
last; a source of size 0 has target 0 and nothing is taken from it; an empty
table gives an empty result; ids may be null or repeat. Rows of equal id and text are ordered by a hash of their other columns of
simple types; if the end falls among rows equal in all of these, as many of them as are wanted are taken. Should all sources together be
too small for the wanted total, every target is its cap. Weights must be above 0. An extra column with the name of a
result column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

#: What counts as a word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table of sources that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20
DIGITS, LEVELS = 3, 2
RESULTS = ("size", "source_size", "target", "repeats", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0, by source, null last: a distributed sort, numbered by the rows before each partition. Written."""
    from ..runtime import persist

    placed = persist(sources.sparkSession, sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mixing-sources")
    part = F.shiftright("_at", 33).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    return placed.withColumn("rank", F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), part + 1) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sources`` has one row per source: source and source_size. Adds ``target``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked(sources).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        now = weighed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_cap"))).alias("caps"), F.sum(F.when(~over, F.col("_w"))).alias("weights"), F.sum("source_size").alias("size")).first()
        total = float(share) * float(now["size"] or 0)
        if now["n"] <= clamped or not now["weights"]:  # none more; fewer, if a cap equals its share but for rounding
            level = level if now["weights"] else None
            break
        level, clamped = (total - (now["caps"] or 0.0)) / now["weights"], now["n"]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return weighed.select("source", "source_size", target.alias("target"))


def _small(rows: DataFrame, source: str) -> DataFrame:
    """A written table with a row for each source, marked for broadcast if it is small; else the join is left to Spark, which splits hot sources."""
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length(source)).alias("bytes")).first()
    return F.broadcast(rows) if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else rows


def _ends(sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``sums`` (source, at, in_all, copies) the row of each source at which ``wanted`` (of, wanted) is reached in order of ``at``, and what is wanted of it."""
    running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("upto", F.sum("in_all").over(running)).join(wanted.select("of", "wanted"), F.col("source").eqNullSafe(F.col("of")))
    met = upto.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("in_all") < F.col("wanted")))
    return met.select("of", "at", "in_all", "copies", (F.col("wanted") - (F.col("upto") - F.col("in_all"))).alias("wanted"))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Add size, source_size, target, repeats and taken to ``docs`` (doc_id, text, source and any others).

    ``share`` is the wanted total as a multiple of all sizes. ``taken`` is repeats times size.
    """
    from ..runtime import discard, persist

    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name in own and f.name.lower() not in ("doc_id", "text", "source") and isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    key = F.concat(key, F.lpad(F.hex(F.xxhash64(*others)), 16, "0")) if others else key
    summed = F.sum("size").alias("in_all"), F.count("*").alias("copies")

    narrow = persist(spark, docs.select("source", key.alias("key"), word_count(F.col("text")).alias("size")), "mixing-sizes")
    sums = persist(spark, narrow.groupBy("source", F.substring("key", 1, DIGITS).alias("at")).agg(*summed), "mixing-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("in_all").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = persist(spark, targets.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("wanted")), "mixing-plan")

    ends = persist(spark, _ends(sums, _small(plan, "of")), "mixing-ends")
    for level in range(2, LEVELS + 2):
        found = _small(ends.select("of", "wanted", F.col("at").alias("prefix")), "of")
        below = narrow.join(found, F.col("source").eqNullSafe(F.col("of")) & F.col("key").startswith(F.col("prefix")))
        at = F.substring("key", 1, DIGITS * level) if level <= LEVELS else F.col("key")
        before, ends = ends, persist(spark, _ends(below.groupBy("source", at.alias("at")).agg(*summed), found), "mixing-ends")
        discard(before)
    # The fraction ends at rows of one hash, nearly always one row: as many of them are taken as come nearest to what is wanted.
    last = ends.select(F.col("of").alias("at_of"), F.col("at").alias("end"), "copies", F.floor(F.col("wanted") / (F.col("in_all") / F.col("copies")) + 0.5).alias("some"))
    before, plan = plan, persist(spark, plan.join(last, F.col("of").eqNullSafe(F.col("at_of")), "left").drop("at_of", "wanted"), "mixing-plan")
    discard(narrow, sums, ends, before)

    names = ("of", "source_size", "target", "whole", "end", "copies", "some")
    dealt = docs.select(*[F.col(f"`{c}`") for c in own], word_count(F.col("text")).alias("size"), key.alias("tidemark__key"))
    dealt = dealt.join(_small(plan, "of").select(*[F.col(c).alias(f"tidemark__{c}") for c in names]), F.col("source").eqNullSafe(F.col("tidemark__of")), "left")
    at_end = F.col("tidemark__key") == F.col("tidemark__end")
    taken_whole = F.when(at_end, F.col("tidemark__some") >= F.col("tidemark__copies")).otherwise(F.col("tidemark__key") < F.col("tidemark__end"))
    rows = dealt.withColumn("tidemark__more", F.coalesce(taken_whole, F.lit(False)).cast("long"))
    if not plan.where("some > 0 AND some < copies").isEmpty():
        part = F.coalesce(at_end & F.col("tidemark__some").between(1, F.col("tidemark__copies") - 1), F.lit(False))
        rows = rows.where(~part).unionByName(_some_of(dealt.where(part)))
    return rows.withColumn("repeats", F.col("tidemark__whole") + F.col("tidemark__more")).select(
        *[F.col(f"`{c}`") for c in own], "size", F.col("tidemark__source_size").alias("source_size"), F.col("tidemark__target").alias("target"), "repeats", (F.col("repeats") * F.col("size")).alias("taken")
    )


def _some_of(equal: DataFrame) -> DataFrame:
    """Rows that are equal within their source, ``tidemark__some`` of each source's with tidemark__more 1, the others 0.

    They may be many, so they are not ordered in one task: written, numbered within the partition that wrote them, and counted before it.
    """
    from ..runtime import persist

    placed = persist(equal.sparkSession, equal.withColumn("tidemark__at", F.monotonically_increasing_id()), "mixing-equal").withColumn("tidemark__part", F.shiftright("tidemark__at", 33))
    by_part = placed.groupBy("tidemark__of", "tidemark__part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tidemark__of").orderBy("tidemark__part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select(F.col("tidemark__of").alias("_of"), F.col("tidemark__part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_place", F.row_number().over(Window.partitionBy("tidemark__of", "tidemark__part").orderBy("tidemark__at")))
    joined = numbered.join(before, F.col("tidemark__of").eqNullSafe(F.col("_of")) & (F.col("tidemark__part") == F.col("_part")))
    more = (F.col("_before") + F.col("_place") <= F.col("tidemark__some")).cast("long")
    return joined.withColumn("tidemark__more", more).drop("tidemark__at", "tidemark__part", "_of", "_part", "_before", "_place")


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it repeats, rows that it does not take left out; ``copy`` counts from 1."""
    return mixed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))


#: Weights of op8's sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to 150 % of their size, at most two epochs of any source."""
    from ..runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
          / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
l AS (SELECT arg_min(lev, cap / w) AS lev FROM s2 WHERE cap > lev * w),
s3 AS (SELECT source, source_size, coalesce(least(cap, l.lev * w), cap) AS target FROM s2 CROSS JOIN l),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s3),
p AS (SELECT d.*, s4.source_size, s4.target, s4.whole, target - whole * s4.source_size AS part,
        row_number() OVER (PARTITION BY d.source, h) AS copy,
        sum(size) OVER (PARTITION BY d.source ORDER BY h) - sum(size) OVER (PARTITION BY d.source, h) AS before
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND copy <= floor((part - before) / size + 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
