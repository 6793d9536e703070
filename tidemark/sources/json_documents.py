"""JSON documents: lines of text in, lines of text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import parse_documents, to_body


def read_documents(spark: SparkSession, path: str, key: str = "_id") -> DataFrame:
    """(``_id``, body, doc, problem) of JSON lines; ids come from the text's own ``_id`` or else a digest of the body."""
    parsed = parse_documents(spark.read.text(path).select(F.col("value").alias("body")))
    return parsed.withColumn(key, F.coalesce(F.try_variant_get("doc", f'$["{key}"]', "string"), F.md5("body")))


def write_documents(df: DataFrame, path: str, doc: str = "doc", key: str = "_id") -> None:
    to_body(df, doc, key).select("body").write.text(path)
