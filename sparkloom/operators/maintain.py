"""Changing tables: upserts, deletions, moves, and what differs between a source and its index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and old rows whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new.select(*old.columns))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def deletion_preview(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """How many rows a deletion would take away and leave."""
    marked = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.agg(F.count_if("_gone").alias("deleted"), F.count_if(F.col("_gone").isNull()).alias("left"))


def ids_to_delete(entries: DataFrame, ids: Sequence[int] = (), tag: str | None = None, domain: str | None = None) -> DataFrame:
    """Distinct ids of entries that are named, have a tag, or are of a domain."""
    hit = F.col("entry_id").isin(*ids) if ids else F.lit(False)
    if tag is not None:
        hit = hit | F.array_contains("tags", tag)
    if domain is not None:
        hit = hit | (F.col("source_domain") == domain)
    return entries.filter(F.coalesce(hit, F.lit(False))).select("entry_id").distinct()


def update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Old rows with the non-null values of changes (one row a key) in place of theirs."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    rows = old.join(new, key, "left")
    return rows.select(*(F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in rows.columns else c for c in old.columns))


def difference(source: DataFrame, index: DataFrame, key: str, mark: str) -> DataFrame:
    """key and action: what makes the index equal to the source. mark: column that tells versions apart."""
    a = source.select(key, F.col(mark).alias("_a"), F.lit(1).alias("_s"))
    b = index.select(key, F.col(mark).alias("_b"), F.lit(1).alias("_i"))
    both = a.join(b, key, "full")
    action = F.when(F.col("_i").isNull(), "add").when(F.col("_s").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return both.select(key, action.alias("action")).filter("action is not null")


def shift(rows: DataFrame, where: Column, start: int, by: int) -> DataFrame:
    """Positions from start on moved by `by`, in the rows that fit."""
    return rows.withColumn("position", F.when(where & (F.col("position") >= start), F.col("position") + by).otherwise(F.col("position")))


def moved(position: Column, start: int, stop: int) -> Column:
    """Positions after the one at start went to stop: those between close up."""
    between = (position > start) & (position <= stop) if stop > start else (position >= stop) & (position < start)
    return F.when(position == start, F.lit(stop)).when(between, position + (-1 if stop > start else 1)).otherwise(position).cast("long")


def expired(jobs: DataFrame, states: Sequence[str], before: Column) -> DataFrame:
    """Jobs in one of the states that ended before a time."""
    return jobs.filter(F.col("state").isin(*states) & (F.col("ts") < before))
