"""A training corpus from documents: quality, exact copies, near copies, mixture of sources, packing.

run() gives one row for each piece of a document: doc_id, source, start, length, ids_crc32, doc_tokens, ids (unsigned
32-bit little-endian), sequence_id and offset. `sequences(run(...))` makes the training sequences of it.

Defined results, stage by stage: null texts are empty ones, which the quality stage may reject like any other text; all
empty texts are equal, so the exact stage keeps one; null ids and null sources are kept as such (a null source is a
source of its own); rows that repeat an id are documents of their own, equal ones among them copies; without labels of
both classes nothing is rejected; texts of any length are read whole; an empty table gives an empty result. Columns
beside those of documents go through the first four stages whatever their names, and end at the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import cotraining, exact_dedup, mixing, near_dedup, packing, shared
from sparkloom.llm.packing import sequences
from sparkloom.llm.queries import byte_level


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return cotraining.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, of five-word shingles and a similarity of 0.8 or more."""
    return near_dedup.near_dedup(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, the last of each source in part."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and source, and their place in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, byte_level(), with_ids=True, source_col="source")


__all__ = ["ORACLE_SQL", "STAGES", "run", "sequences"]

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: A co-trained classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.stored(docs, f"stage-{i + 1}")
    return docs
