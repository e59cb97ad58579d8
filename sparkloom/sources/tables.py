"""The library's tables as views over a folder of Parquet tables.

entries: documents; chunks: embeddings (five chunks an entry); pages: pages; jobs: users of events; work items: turns
of conversations, each under the turn before; board cards: orders; links between projects and entries: order lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host

CHUNKS_PER_ENTRY = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """entry_id, title (first line), content, entry_type, source_domain, tags, newest first by entry_id."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("entry_id"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("lang").alias("entry_type"),
        F.col("source").alias("source_domain"),
        F.array("lang", "source").alias("tags"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, entry_id, chunk_index, chunk_type, vector."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.expr(f"vec_id div {CHUNKS_PER_ENTRY}").alias("entry_id"),
        (F.col("vec_id") % CHUNKS_PER_ENTRY).cast("int").alias("chunk_index"),
        F.col("label").alias("chunk_type"),
        F.col("embedding").alias("vector"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html, domain."""
    return table(spark, folder, "pages").select("page_id", "url", "html", host(F.col("url")).alias("domain"))


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, job_id, state, ts, value."""
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), "ts", "value", "props")


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, parent_id (null at the root), project_id, position, role, title."""
    t = table(spark, folder, "conversations")
    item = F.concat_ws("/", "conv_id", "turn")
    return t.select(
        item.alias("item_id"),
        F.when(F.col("turn") > 0, F.concat_ws("/", "conv_id", F.col("turn") - 1)).alias("parent_id"),
        F.col("conv_id").alias("project_id"),
        F.col("turn").alias("position"),
        "role",
        F.col("text").alias("title"),
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """number, lane, column, project_id, points, created."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("number"),
        F.col("o_orderpriority").alias("lane"),
        F.col("o_orderstatus").alias("column"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_totalprice").alias("points"),
        F.col("o_orderdate").alias("created"),
    )


def project_links(spark: SparkSession, folder: str) -> DataFrame:
    """project_id, entry_id, line, relevance, linked_at."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.col("l_partkey").alias("entry_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_discount").alias("relevance"),
        F.col("l_shipdate").alias("linked_at"),
    )


def in_parts(rows: DataFrame, key: str, by: str, size: int = 500) -> DataFrame:
    """Add `part`: rows of a key dealt by the hash of a column into parts of about `size`, so that no key is gathered whole."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64(by), F.ceil(F.col("_n") / size))).drop("_n")


def loc(url: Column) -> Column:
    """An address as sitemaps have it."""
    return F.concat(F.lit("<loc>"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
