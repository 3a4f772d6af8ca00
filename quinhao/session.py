"""The session's shared folder, and written intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    folder = tempfile.mkdtemp(prefix="quinhao-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: dict[str, list[str]] = {}  # application -> folders that were named for it


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, there until ``remove`` or ``release``."""
    path = f"{shared_folder(spark)}/quinhao/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove everything this application stored, once no result is needed any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


@contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder that lasts as long as the ``with`` block."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
