"""Queries that apply changes: upserts, deletions, synchronisation, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain
from ..operators.hashtree import HashTree
from ..sources import tables
from ..sources.storage import shared_dir
from .catalog import query


@query("SELECT vec_id AS chunk_id, vec_id // 5 AS entry_id, CASE WHEN vec_id % 7 = 0 THEN 99 ELSE label END AS chunk_type FROM embeddings UNION ALL SELECT vec_id + 10000000, vec_id // 5, 99 FROM embeddings WHERE vec_id % 7 = 0")
def upsert_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh chunk gets a new type, and a new chunk beside it."""
    old = tables.chunks(spark, folder).select("chunk_id", "entry_id", F.col("chunk_type").cast("int").alias("chunk_type"))
    some = old.filter("chunk_id % 7 = 0").withColumn("chunk_type", F.lit(99))
    return maintain.upsert(old, some.unionByName(some.withColumn("chunk_id", F.col("chunk_id") + 10_000_000)), ["chunk_id"])


_GONE = "SELECT doc_id FROM documents WHERE doc_id IN (3, 5, 8, 13) OR lang = 'fr' OR source = 'src4'"


@query(f"SELECT doc_id AS entry_id FROM documents WHERE doc_id NOT IN ({_GONE})")
def delete_by_filter(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.entries(spark, folder)
    return maintain.delete(e, maintain.ids_to_delete(e, (3, 5, 8, 13), "fr", "src4"), "entry_id").select("entry_id")


@query(f"WITH m AS (SELECT vec_id // 5 IN ({_GONE}) AS gone FROM embeddings) SELECT count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS \"left\" FROM m")
def delete_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that would go with their entries."""
    gone = maintain.ids_to_delete(tables.entries(spark, folder), (3, 5, 8, 13), "fr", "src4")
    return maintain.deletion_preview(tables.chunks(spark, folder), gone, "entry_id")


@query("""
    WITH s AS (SELECT doc_id AS entry_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 10 <> 0),
    i AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 9 <> 0)
    SELECT coalesce(s.entry_id, i.entry_id) AS entry_id, CASE WHEN i.entry_id IS NULL THEN 'add' WHEN s.entry_id IS NULL THEN 'delete' ELSE 'update' END AS action
    FROM s FULL JOIN i ON s.entry_id = i.entry_id WHERE i.entry_id IS NULL OR s.entry_id IS NULL OR s.hash <> i.hash""")
def sync_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What an index with missing, stale and surplus entries needs."""
    e = tables.entries(spark, folder).select("entry_id", F.md5("content").alias("hash"))
    index = e.filter("entry_id % 9 <> 0").withColumn("hash", F.when(F.col("entry_id") % 7 == 0, "old").otherwise(F.col("hash")))
    return maintain.difference(e.filter("entry_id % 10 <> 0"), index, "entry_id", "hash")


_VERSIONS = """
    WITH s AS (SELECT doc_id AS entry_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 301 <> 0),
    i AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 211 = 0 THEN 'old' ELSE md5(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 251 <> 0)"""


def _trees(spark: SparkSession, folder: str) -> tuple[HashTree, HashTree]:
    """Entries, and an index of them that lacks some, has some that went, and some in an old form."""
    e = tables.entries(spark, folder).select("entry_id", F.md5("content").alias("hash"))
    index = e.filter("entry_id % 251 <> 0").withColumn("hash", F.when(F.col("entry_id") % 211 == 0, "old").otherwise(F.col("hash")))
    at = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    return HashTree.build(e.filter("entry_id % 301 <> 0"), f"{at}/source", "entry_id", "hash"), HashTree.build(index, f"{at}/index", "entry_id", "hash")


@query(f"""{_VERSIONS}
    SELECT coalesce(s.entry_id, i.entry_id) AS entry_id, CASE WHEN i.entry_id IS NULL THEN 'add' WHEN s.entry_id IS NULL THEN 'delete' ELSE 'update' END AS action
    FROM s FULL JOIN i ON s.entry_id = i.entry_id WHERE i.entry_id IS NULL OR s.entry_id IS NULL OR s.hash <> i.hash""")
def sync_by_tree(spark: SparkSession, folder: str) -> DataFrame:
    """What the index needs, from the buckets whose digests differ."""
    source, index = _trees(spark, folder)
    return source.difference(index)


@query(f"""{_VERSIONS},
    d AS (SELECT DISTINCT md5(CAST(coalesce(s.entry_id, i.entry_id) AS VARCHAR))[:3] AS leaf
          FROM s FULL JOIN i ON s.entry_id = i.entry_id WHERE i.entry_id IS NULL OR s.entry_id IS NULL OR s.hash <> i.hash),
    a AS (SELECT 'source' AS side, entry_id FROM s UNION ALL SELECT 'index', entry_id FROM i)
    SELECT side, count(*) FILTER (md5(CAST(entry_id AS VARCHAR))[:3] IN (SELECT leaf FROM d)) AS rows_read, count(*) AS rows_all FROM a GROUP BY side""")
def sync_by_tree_reads(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each side lie in buckets that differ, of how many."""
    source, index = _trees(spark, folder)
    leaves = source.differing(index).withColumn("differs", F.lit(True))

    def side(tree: HashTree, name: str) -> DataFrame:
        leaf = tree.level(tree.depth).withColumnRenamed("node", "leaf").join(leaves, "leaf", "left")
        return leaf.agg(F.coalesce(F.sum(F.when(F.col("differs"), F.col("rows"))), F.lit(0)).alias("rows_read"), F.sum("rows").alias("rows_all")).withColumn("side", F.lit(name))

    return side(source, "source").unionByName(side(index, "index"))


@query("SELECT project_id, entry_id, relevance, line FROM (SELECT l_orderkey AS project_id, l_partkey AS entry_id, l_discount AS relevance, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def latest_links(spark: SparkSession, folder: str) -> DataFrame:
    """One link for each project and entry: the last one."""
    rows = tables.project_links(spark, folder)
    return maintain.latest(rows, ["project_id", "entry_id"], [F.desc("linked_at"), F.desc("line")]).select("project_id", "entry_id", "relevance", "line")


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS \"column\", o_totalprice AS points FROM orders")
def update_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Every eleventh card moves to another column; its points stay."""
    old = tables.cards(spark, folder).select("number", "column", "points")
    changes = old.filter("number % 11 = 0").select("number", F.lit("X").alias("column"), F.lit(None).cast("double").alias("points"))
    return maintain.update(old, changes, "number")


@query("SELECT doc_id AS entry_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copies FROM documents) WHERE copies > 1")
def dup_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose content's hash others have too."""
    e = tables.entries(spark, folder).select("entry_id", F.sha2("content", 256).alias("hash"))
    many = e.groupBy("hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    return e.join(many, "hash").select("entry_id", "copies")


@query("SELECT page_id, EXISTS (SELECT 1 FROM pages q WHERE q.page_id < p.page_id AND md5(q.html) = md5(p.html)) AS known FROM pages p")
def known_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a page with the same content came before."""
    p = tables.pages(spark, folder).select("page_id", F.md5("html").alias("hash"))
    first = p.groupBy("hash").agg(F.min("page_id").alias("first"))
    return p.join(first, "hash").select("page_id", (F.col("page_id") > F.col("first")).alias("known"))


@query("""
    WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1),
    x AS (SELECT user_id FROM l WHERE state IN ('error', 'purchase') AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
    SELECT user_id AS job_id FROM l WHERE user_id NOT IN (SELECT user_id FROM x)""")
def retained_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs left once those that ended a day before the last event are removed."""
    from ..streaming.jobs import last_state

    jobs = last_state(tables.job_events(spark, folder))
    end = tables.job_events(spark, folder).agg(F.max("ts").alias("end"))  # one row
    gone = maintain.expired(jobs.crossJoin(end), ("error", "purchase"), F.col("end") - F.expr("INTERVAL 1 DAY"))
    return maintain.delete(jobs, gone, "job_id").select("job_id")


@query("SELECT doc_id AS entry_id, n FROM (SELECT doc_id, 1 AS n FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 4 = 0)")
def replaced_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth document replaced by a second version, the others kept."""
    old = tables.entries(spark, folder).select("entry_id", F.lit(1).alias("n"))
    return maintain.upsert(old, old.filter("entry_id % 4 = 0").withColumn("n", F.lit(2)), ["entry_id"])
