"""Counts and sums over entries, chunks, jobs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_counts(entries: DataFrame) -> DataFrame:
    """tag, count, and the type of the newest entry that has it."""
    rows = entries.select("entry_id", "entry_type", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("count"), F.max_by("entry_type", "entry_id").alias("entry_type"))


def breakdown(rows: DataFrame, **by: str) -> DataFrame:
    """Counts by several columns in one table: kind, name, count. Nulls are left out."""
    out = None
    for kind, column in by.items():
        part = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("count"))
        part = part.select(F.lit(kind).alias("kind"), "name", "count")
        out = part if out is None else out.unionByName(part)
    return out


def health(entries: Column, chunks: Column) -> Column:
    return F.when(entries == 0, "empty").when(chunks == 0, "degraded").otherwise("healthy")


def job_totals(jobs: DataFrame) -> DataFrame:
    """One row of counts by state; in_progress counts as running."""
    n = lambda c: F.count_if(c)
    state = F.col("state")
    return jobs.agg(
        F.count("*").alias("total"),
        n(state == "purchase").alias("completed"),
        n(state == "error").alias("failed"),
        n(state.isin("view", "click")).alias("running"),
        F.count_distinct("job_id").alias("jobs"),
    )


def text_sizes(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Rows, characters and mean characters of a text by group."""
    size = F.length(text)
    return rows.groupBy(by).agg(F.count("*").alias("count"), F.sum(size).alias("chars"), F.round(F.avg(size), 6).alias("mean_chars"))


def merged_code_stats(pages: DataFrame) -> DataFrame:
    """Statistics of pages (blocks, language array) merged: sums, pages with code, union of languages."""
    return pages.agg(
        F.sum("blocks").alias("blocks"),
        F.count_if(F.col("blocks") > 0).alias("pages_with_code"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))), ",").alias("languages"),
    )
