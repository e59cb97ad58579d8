"""Queries that count and sum: dashboards, categories, domains, jobs, code statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import sketches, stats
from ..sources import tables
from ..sources.storage import shared_dir
from .catalog import query

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"


@query("SELECT (SELECT count(*) FROM documents) AS entries, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT source) FROM documents) AS domains")
def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.entries(spark, folder).agg(F.count("*").alias("entries"), F.count_distinct("source_domain").alias("domains"))
    c = tables.chunks(spark, folder).agg(F.count("*").alias("chunks"))
    p = tables.pages(spark, folder).agg(F.count("*").alias("pages"))
    return e.crossJoin(c).crossJoin(p).select("entries", "chunks", "pages", "domains")  # one row each


@query("""
    WITH t AS (SELECT doc_id, lang, unnest(list_filter([lang, source], lambda x: x IS NOT NULL)) AS tag FROM documents)
    SELECT tag, count(*) AS count, arg_max(lang, doc_id) AS entry_type FROM t GROUP BY tag""")
def categories(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tag_counts(tables.entries(spark, folder)).filter("tag is not null")


@query("""
    WITH t AS (SELECT unnest(list_filter([lang, source], lambda x: x IS NOT NULL)) AS tag FROM documents)
    SELECT tag, count(*) AS count FROM t GROUP BY tag ORDER BY count DESC, tag LIMIT 10""")
def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tag_counts(tables.entries(spark, folder)).filter("tag is not null").select("tag", "count").orderBy(F.desc("count"), "tag").limit(10)


@query("SELECT label AS chunk_type, count(*) AS count, count(DISTINCT vec_id // 5) AS entries FROM embeddings GROUP BY 1")
def chunk_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.chunks(spark, folder).groupBy("chunk_type").agg(F.count("*").alias("count"), F.count_distinct("entry_id").alias("entries"))


@query("SELECT vec_id // 5 AS entry_id, count(*) AS chunks FROM embeddings GROUP BY 1")
def chunk_counts_by_entry(spark: SparkSession, folder: str) -> DataFrame:
    return tables.chunks(spark, folder).groupBy("entry_id").agg(F.count("*").alias("chunks"))


@query("""
    SELECT 'type' AS kind, lang AS name, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'domain', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'health', CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'empty' WHEN (SELECT count(*) FROM embeddings) = 0 THEN 'degraded' ELSE 'healthy' END, (SELECT count(*) FROM documents)""")
def index_status(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.entries(spark, folder)
    parts = stats.breakdown(e, type="entry_type", domain="source_domain")
    totals = e.agg(F.count("*").alias("e")).crossJoin(tables.chunks(spark, folder).agg(F.count("*").alias("c")))
    return parts.unionByName(totals.select(F.lit("health").alias("kind"), stats.health(F.col("e"), F.col("c")).alias("name"), F.col("e").alias("count")))


@query(f"SELECT {_HOST} AS domain, count(*) AS count, sum(length(html))::BIGINT AS chars, round(avg(length(html)), 6) AS mean_chars FROM pages GROUP BY 1")
def storage_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return stats.text_sizes(tables.pages(spark, folder), "domain", "html")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('view', 'click')) AS running, count(DISTINCT user_id) AS jobs FROM events")
def job_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return stats.job_totals(tables.job_events(spark, folder))


@query(f"SELECT {_HOST} AS domain, count(DISTINCT url) AS urls FROM pages GROUP BY 1 ORDER BY urls DESC, domain LIMIT 25")
def urls_per_domain(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.pages(spark, folder).groupBy("domain").agg(F.count_distinct("url").alias("urls"))
    return rows.orderBy(F.desc("urls"), "domain").limit(25)


@query(f"SELECT count(*) AS discovered, count(*) FILTER (page_id % 3 = 0) AS pending, count(*) FILTER (page_id % 3 = 1) AS in_progress, count(DISTINCT {_HOST}) AS domains FROM pages")
def frontier_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a frontier whose state follows from the page's id."""
    state = F.col("page_id") % 3
    return tables.pages(spark, folder).agg(F.count("*").alias("discovered"), F.count_if(state == 0).alias("pending"), F.count_if(state == 1).alias("in_progress"), F.count_distinct("domain").alias("domains"))


@query("SELECT sum(strlen(html))::BIGINT AS bytes, max(strlen(html)) AS largest, sum(CASE WHEN strlen(html) > 4096 THEN 1 ELSE 0 END)::BIGINT AS over_limit FROM pages")
def upload_sizes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length("html")
    return tables.pages(spark, folder).agg(F.sum(size).alias("bytes"), F.max(size).cast("long").alias("largest"), F.count_if(size > 4096).alias("over_limit"))


@query("SELECT doc_id AS entry_id, CASE WHEN strlen(text) >= 1048576 THEN printf('%.1f MB', strlen(text) / 1048576) WHEN strlen(text) >= 1024 THEN printf('%.1f KB', strlen(text) / 1024) ELSE strlen(text) || ' bytes' END AS size FROM documents WHERE text IS NOT NULL")
def formatted_sizes(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import size_text

    rows = tables.table(spark, folder, "documents").filter("text is not null")
    return rows.select(F.col("doc_id").alias("entry_id"), size_text(F.octet_length("text")).alias("size"))


@query("""
    WITH b AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS blocks, regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1) AS lang FROM pages)
    SELECT sum(blocks)::BIGINT AS blocks, count(*) FILTER (blocks > 0) AS pages_with_code, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM b""")
def merged_block_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all pages merged: the sum, pages with any, and the union of their languages."""
    blocks = F.regexp_count("html", F.lit("(?i)<p[ >]"))
    lang = F.regexp_extract("html", '(?i)<html[^>]*lang="([a-z]+)"', 1)
    return stats.merged_code_stats(tables.pages(spark, folder).select(blocks.cast("long").alias("blocks"), F.array(lang).alias("languages")))


@query("SELECT event_type AS state, count(DISTINCT user_id) AS jobs, true AS approx_ok FROM events GROUP BY 1")
def approximate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many jobs ever had each state, and whether the approximate number is within a tenth of that."""
    # Pairs first: with both counts in one aggregate, each pair of state and job would carry a sketch of its own.
    pairs = tables.job_events(spark, folder).select("state", "job_id").distinct()
    both = pairs.groupBy("state").agg(F.approx_count_distinct("job_id", 0.02).alias("near"), F.count("job_id").alias("jobs"))
    return both.select("state", "jobs", (F.abs(F.col("near") - F.col("jobs")) <= 0.1 * F.col("jobs")).alias("approx_ok"))


@query("""
    WITH e AS (SELECT DISTINCT event_type AS state, ts::DATE AS of, user_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    d AS (SELECT DISTINCT state, of AS day FROM e)
    SELECT d.state, d.day, count(DISTINCT e.user_id) AS jobs, true AS approx_ok
    FROM d JOIN e ON e.state IS NOT DISTINCT FROM d.state AND e.of BETWEEN d.day - 6 AND d.day GROUP BY 1, 2""")
def sketched_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of each state in the seven days up to each day, and whether the sketches stored by day say so within a tenth.

    The sketches are written by two batches, of which the second also brings late rows for the days of the first.
    """
    e = tables.job_events(spark, folder)
    kept = sketches.DistinctByDay(spark, f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}", ["state"])
    late = F.pmod("event_id", F.lit(3)) == 0
    kept.add(e.filter(~late), "ts", "job_id")
    kept.add(e.filter(late), "ts", "job_id")
    once = e.filter("ts is not null and job_id is not null").select("state", "job_id", F.to_date("ts").alias("of")).distinct()
    exact = once.select("state", "job_id", "of", F.explode(F.sequence("of", F.date_add("of", 6))).alias("day"))
    exact = exact.groupBy("state", "day").agg(F.count_distinct("job_id").alias("jobs"), F.max("of").alias("newest")).filter("newest = day")
    near = kept.trailing(7).select(F.col("state").alias("s"), F.col("day").alias("d"), "estimate")
    both = exact.join(near, F.col("state").eqNullSafe(F.col("s")) & (F.col("day") == F.col("d")))
    return both.select("state", "day", "jobs", (F.abs(F.col("estimate") - F.col("jobs")) <= 0.1 * F.col("jobs")).alias("approx_ok"))


@query(f"SELECT page_id, {_HOST} AS domain, CASE WHEN {_HOST} LIKE '%.org' THEN false ELSE {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net' END AS allowed FROM pages")
def allowed_domains(spark: SparkSession, folder: str) -> DataFrame:
    ok = urls.allowed(F.col("domain"), ("example.com", "example.net"), ("org",))
    return tables.pages(spark, folder).select("page_id", "domain", ok.alias("allowed"))
