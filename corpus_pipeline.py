"""Documents to packed training sequences, in five stages.

Toxic documents go, exact and near copies go, sources are mixed to target
weights and the result is packed.  Each stage takes (spark, docs, sf_dir) and
works on all that its predecessor kept; all but the last return the columns of
``documents``.  A null text is empty everywhere; empty documents are clean,
are copies of each other for the exact stage, link with nothing in the near
stage and become one closing token when packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerlark.llm.common import settle
from ledgerlark.llm.queries import ENTROPY_SHARE, MAX_REPETITION, TOXIC_FROM, held_out, table, word_tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``, as op9 does, by a model of the labelled rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out())
    return toxicity.clean_documents(docs, model, TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z against a-z, the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles connect, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the target weights ask for."""
    return mixing.mixed_documents(docs, entropy_share=ENTROPY_SHARE, max_repetition=MAX_REPETITION)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a document that the mix repeats is packed each time."""
    return packing.pack(docs, word_tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained scores of the first stage; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
