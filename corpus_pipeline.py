"""A training corpus from raw documents: toxic documents go, near copies collapse, benchmark leaks go, secrets are masked, sources are mixed.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``docs``; the last holds each document as often as the mix repeats it, and adds its size, its source's size and
target, repeats, taken (repeats times size) and copy (which of the repeats a row is). Columns named like these are replaced; column names beginning with ``tidemark__`` are the pipeline's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dup, secrets, toxicity
from tidemark.llm.language import held_out
from tidemark.runtime import discard, persist, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels that are not held out, drop documents that score as toxic."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs, model, to="tidemark__score", flag="tidemark__toxic")
    return scored.where("tidemark__toxic = 0").drop("tidemark__score", "tidemark__toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars, where present, follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources by weight to 150 % of the words left, two epochs of any source at most; each document is there as often as the mix repeats it."""
    return mixing.repeat(mixing.mix(docs, mixing.WEIGHTS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The first three stages learn models or sample, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, persist(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
