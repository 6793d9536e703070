"""Session helpers: table access, shared scratch space, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that setting is absent, a temporary one is set if all tasks run in this process; a cluster must name one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a URI for Python code on executors; schemes of Hadoop's connectors go to the stores they stand for."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else uri)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that any store works."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def persist(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``persist`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path is not None:
            drop_scratch(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, for functions that run in their Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(to, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, os.path.join(here.name, path.relative_to(here)))
    sc.addPyFile(str(to))
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    _SHIPPED.add(sc.applicationId)
