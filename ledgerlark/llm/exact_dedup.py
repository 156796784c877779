"""Exact deduplication with mergeable counting quotient filters.

Each input partition turns the 64-bit fingerprints of its texts into counting
quotient filters, one for each range of quotients.  The filters of a range
meet in one group and merge by their sorted remainders, adding counters, so
nothing is lost.  Fingerprints whose merged counter is above one send their
documents to byte verification, which groups by the whole normalised text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Fingerprints that one quotient range holds on average after merging.
RANGE_SIZE = 20_000
REMAINDER_BITS = 40


class CountingQuotientFilter:
    """Counting quotient filter over 64-bit fingerprints, in run-length form.

    A fingerprint splits into a quotient (high bits) and a remainder (low
    ``REMAINDER_BITS``).  Occupied quotients are ascending, ``runs`` gives the
    number of remainders of each, remainders ascend inside a run and every
    remainder has its counter.
    """

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of_counts(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From any fingerprints (repeats add up) and their counters."""
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.ones(len(fingerprints), bool)
        first[1:] = fingerprints[1:] != fingerprints[:-1]
        at = np.flatnonzero(first)
        kept = fingerprints[at]
        total = np.add.reduceat(counts, at) if len(at) else counts[:0]
        quotients, runs = np.unique(kept >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients.astype("<u4"), runs.astype("<u4"), kept & np.uint64((1 << REMAINDER_BITS) - 1), total.astype("<i8"))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless union: sorted remainders interleave and equal ones add their counters."""
        return cls.of_counts(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients.astype("<u8"), self.runs) << np.uint64(REMAINDER_BITS)) | self.remainders

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints with a counter above one, and the counters."""
        many = self.counts > 1
        return self.fingerprints()[many], self.counts[many]

    def dumped(self) -> list[bytes]:
        """Remainders keep only their ``REMAINDER_BITS`` / 8 bytes."""
        packed = self.remainders.astype("<u8").view("u1").reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        return [self.quotients.tobytes(), self.runs.tobytes(), packed.tobytes(), self.counts.tobytes()]

    @classmethod
    def loaded(cls, quotients: bytes, runs: bytes, packed: bytes, counts: bytes) -> CountingQuotientFilter:
        width = REMAINDER_BITS // 8
        wide = np.zeros((len(packed) // width, 8), "u1")
        wide[:, :width] = np.frombuffer(packed, "u1").reshape(-1, width)
        return cls(np.frombuffer(quotients, "<u4"), np.frombuffer(runs, "<u4"), wide.view("<u8").ravel(), np.frombuffer(counts, "<i8"))


FILTER_SCHEMA = "block int, quotients binary, runs binary, remainders binary, counts binary"


def partition_filters(fingerprints: DataFrame, blocks: int) -> DataFrame:
    """One filter for each partition and range of quotients, from the one long column."""
    bits = int(math.log2(blocks))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column(0).to_numpy(zero_copy_only=False).astype("i8") for b in batches]
        fps = np.concatenate(own).view("u8") if own else np.zeros(0, "u8")
        values, counts = np.unique(fps, return_counts=True)
        block = (values >> np.uint64(64 - bits)).astype("i4") if bits else np.zeros(len(values), "i4")
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)), len(values)]
        rows = [
            [int(block[a]), *CountingQuotientFilter.of_counts(values[a:z], counts[a:z]).dumped()]
            for a, z in zip(edges[:-1], edges[1:], strict=True)
        ]
        names = [x.split()[0] for x in FILTER_SCHEMA.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return fingerprints.mapInArrow(build, FILTER_SCHEMA)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, copies) for every fingerprint that all partitions together hold more than once."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, rows) / RANGE_SIZE)))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged(
            [CountingQuotientFilter.loaded(*x) for x in parts[["quotients", "runs", "remainders", "counts"]].itertuples(index=False)]
        )
        fps, counts = whole.repeated()
        return pd.DataFrame({"fp": fps.view("i8"), "copies": counts})

    return partition_filters(fingerprints, blocks).groupBy("block").applyInPandas(merge, "fp long, copies long")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-verified groups of equal normalised texts: (text_sha256, keep_id, group_size).

    Only groups of two and more.  The routing join on the fingerprint may be
    split where one fingerprint is hot, and the grouping by text is aggregated
    before its shuffle, so a huge group of copies arrives as one row a task.
    """
    own = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.col(text_col)).alias("_norm")).withColumn("fp", F.xxhash64("_norm"))
    repeated = repeated_fingerprints(own.select("fp"), docs.count()).select("fp")
    routed = own.join(repeated, "fp", "left_semi")
    return (
        routed.groupBy("_norm")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2(F.col("_norm"), 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark exact copies: one row per input row.

    Returns ``id_col``, keep_id, group_size, kept and text_sha256.  Texts are
    equal when identical after lower-casing A-Z; a null text is empty.  The
    row with the largest id stays.  Defined cases: empty and null texts form
    one group; a null id is never the one that stays unless all ids of the
    group are null, and a group of only null ids keeps every row; rows that
    repeat an id and its text are one document and get the same mark; an empty
    table gives an empty table; other columns are not looked at, whatever
    their names.
    """
    hashed = docs.select(F.col(id_col), F.sha2(lower_ascii(F.col(text_col)), 256).alias("text_sha256"))
    marked = hashed.join(copy_groups(docs, id_col, text_col), "text_sha256", "left")
    return marked.select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col(id_col).eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Cases as in :func:`exact_copies`."""
    groups = copy_groups(docs, id_col, text_col).select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"))
    joined = docs.join(groups, F.sha2(lower_ascii(docs[text_col]), 256) == groups["_sha"], "left")
    stays = groups["_sha"].isNull() | docs[id_col].eqNullSafe(groups["_keep"])
    return joined.filter(stays).select(*[docs[c] for c in docs.columns])
