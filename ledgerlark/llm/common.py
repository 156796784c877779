"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where all tasks share the machine.
OWN_SCRATCH = "/tmp/checkpoints"
#: Edges that one task joins, 16 bytes each.
FEW_EDGES = 1 << 14
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of unsigned numbers over 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where none is named, one of our own on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
        folder = OWN_SCRATCH
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs run inside hand Python ``n`` rows at a time at most: with the session's number, batches of long texts take hundreds of MB on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n if int(before) <= 0 else min(n, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, label: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: the rows survive lost executors and are computed once,
    however often they are read afterwards.  The path is added to ``written``,
    for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Delete settled tables that nothing reads any more, and forget them."""
    for path in written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    written.clear()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _joined_by_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to) by union-find over the edges of one task."""
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root.setdefault(up, up)
        return k

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(k) for k in ids], pa.int64())], ["id", "to"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (id, component = least id).

    Every round, each id joins the one of itself and its neighbours that comes
    first in an order drawn for that round, and the edges between the ids that
    were joined go on.  At most three quarters of the ids are expected to go
    on, whatever the shape of the graph and the order of its ids, so the
    number of rounds is logarithmic and has no bound to run into.  The first
    round goes by the ids themselves, which settles stars around their least
    id; once no more than ``few`` edges are left, one task joins them.  Every
    round is written to the shared folder; only the number of edges left
    reaches the driver.  No edges give an empty table.  Edges with a null end
    are ignored.
    """
    spark, written, rounds = edges.sparkSession, [], []
    edges = edges.filter("a is not null and b is not null and a <> b")
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", written)
    while (n := left.count()) > few:
        turn = lambda c: F.struct((F.xxhash64(c, F.lit(len(rounds))) if rounds else F.col(c)).alias("turn"), F.col(c).alias("id"))  # noqa: E731, B023
        both = left.select("a", "b").union(left.select("b", "a"))
        joined = both.groupBy("a").agg(F.min(turn("b")).alias("first")).select(F.col("a").alias("id"), F.least("first", turn("a"))["id"].alias("to"))
        rounds.append(settle(joined, "joined", written))
        end = lambda c: rounds[-1].select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(end("a"), "a").join(end("b"), "b").filter("a_to <> b_to")
        left = settle(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges", written)
    if n or not rounds:
        rounds.append(left.repartition(1).mapInArrow(_joined_by_edges, "id long, to long"))
    labels = rounds.pop()
    if rounds:
        while rounds:
            later = labels.select(F.col("id").alias("to"), F.col("to").alias("end"))
            labels = rounds.pop().join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
        labels = settle(labels, "labels", written)
        least = labels.groupBy("to").agg(F.least(F.min("id"), "to").alias("component"))
        labels = labels.join(least, "to").select("id", F.col("component").alias("to"))
    found = settle(labels.select("id", F.col("to").alias("component")), "components")
    discard(spark, written)
    return found
