"""The folder that all executors share, and tables that are replaced as a whole."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where none is named, in one of our own on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
        folder = "/tmp/checkpoints"
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once in the shared folder, for work that reads it many times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, amount: float, each: float) -> list[int]:
    """The number of partitions, as first argument of ``repartition``, that hold ``each`` of ``amount``; none where the session's own number is enough.

    The session's number is fixed, so with it the memory of a task that sorts
    its partition would grow with the input.
    """
    wanted = math.ceil(amount / each)
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``."""
    files, at = _files(spark, path)
    return files.getContentSummary(at(path)).getLength()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None; a swap that was cut off is undone first."""
    files, at = _files(spark, path)
    if not files.exists(at(path)) and files.exists(at(f"{path}.old")):
        files.rename(at(f"{path}.old"), at(path))
    return spark.read.parquet(path) if files.exists(at(path)) else None


def swap(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace the table at ``path`` by ``df``, which may be made from it: written beside it, then renamed.

    Readers see the old rows or the new ones.  Where renaming is cut off, the
    old table stays as ``path``.old, and :func:`stored` brings it back.
    """
    files, at = _files(df.sparkSession, path)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.new")
    files.delete(at(f"{path}.old"), True)
    if files.exists(at(path)):
        files.rename(at(path), at(f"{path}.old"))
    files.rename(at(f"{path}.new"), at(path))
    files.delete(at(f"{path}.old"), True)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at(path), True)
