"""Queries that list, look up and join entries, pages and chunks, and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import ranking, sqlgate
from ..operators.sqlgate import TEMPLATES, run_safely
from ..sources import tables
from .catalog import query

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"


@query("SELECT doc_id AS entry_id, lang AS entry_type, source AS source_domain FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def list_entries_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.entries(spark, folder).filter("entry_type = 'de'")
    return ranking.page(rows, [F.desc("entry_id")], 20, 20).select("entry_id", "entry_type", "source_domain")


@query("SELECT doc_id AS entry_id, source AS source_domain FROM documents WHERE source = 'src3' OR source LIKE '%.src3'")
def entries_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Exact domain or one below it."""
    return tables.entries(spark, folder).filter(urls.on_domain(F.col("source_domain"), ["src3"])).select("entry_id", "source_domain")


@query("SELECT doc_id AS entry_id FROM documents WHERE doc_id IN (SELECT vec_id // 5 FROM embeddings WHERE label = 2)")
def entries_with_chunk_type(spark: SparkSession, folder: str) -> DataFrame:
    having = tables.chunks(spark, folder).filter("chunk_type = 2").select("entry_id")
    return tables.entries(spark, folder).join(having, "entry_id", "left_semi").select("entry_id")


@query("SELECT doc_id AS entry_id, length(text) AS chars FROM documents WHERE doc_id = 42")
def entry_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).filter("entry_id = 42").select("entry_id", F.length("content").alias("chars"))


@query("SELECT vec_id AS chunk_id, (vec_id % 5)::INT AS chunk_index, label AS chunk_type, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id // 5 = 7")
def chunks_of_entry(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.chunks(spark, folder).filter("entry_id = 7").orderBy("chunk_index")
    return rows.select("chunk_id", "chunk_index", "chunk_type", F.lit(0.0).alias("distance"), F.lit(1.0).alias("score"))


@query("SELECT doc_id AS entry_id, list(vec_id ORDER BY vec_id) FILTER (WHERE vec_id IS NOT NULL) AS chunks FROM documents LEFT JOIN embeddings ON vec_id // 5 = doc_id GROUP BY doc_id")
def document_with_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with the ids of its chunks in order; null without any."""
    nested = tables.chunks(spark, folder).groupBy("entry_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    return tables.entries(spark, folder).select("entry_id").join(nested, "entry_id", "left")


@query("SELECT page_id, url, length(html) AS chars FROM pages WHERE page_id = 7")
def page_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).filter("page_id = 7").select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query(f"SELECT page_id, url FROM pages WHERE {_HOST} = (SELECT {_HOST} FROM pages WHERE page_id = 7) ORDER BY page_id")
def pages_of_domain(spark: SparkSession, folder: str) -> DataFrame:
    """The pages from the domain of page 7, oldest first."""
    p = tables.pages(spark, folder)
    return p.join(F.broadcast(p.filter("page_id = 7").select("domain").limit(1)), "domain").select("page_id", "url").orderBy("page_id")


@query("SELECT vec_id AS chunk_id, vec_id // 5 AS entry_id, (vec_id % 5)::INT AS chunk_index, label AS chunk_type, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id = 7")
def chunk_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk, given like a hit at distance 0."""
    hit = tables.chunks(spark, folder).filter("chunk_id = 7").drop("vector")
    return hit.withColumns({"distance": F.lit(0.0), "score": F.lit(1.0)})


@query("""
    WITH s AS (SELECT p_partkey AS entry_id, regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part)
    SELECT * FROM s WHERE slug = (SELECT slug FROM s WHERE entry_id = 7)""")
def entries_by_slug(spark: SparkSession, folder: str) -> DataFrame:
    """The entries whose title gives the slug of entry 7's."""
    named = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("entry_id"), text.slug(F.col("p_name")).alias("slug"))
    asked = named.filter("entry_id = 7").select("slug").limit(1)
    return named.join(F.broadcast(asked), "slug").select("entry_id", "slug")


@query("""
    SELECT substr(sha256(coalesce(source, '') || '/' || doc_id || '.txt'), 1, 32) AS id, doc_id::VARCHAR AS title, substr(coalesce(text, ''), 1, 200) AS description, 'indexed-content' AS tag
    FROM documents""")
def text_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of plain texts: ids from their paths, stems of the files as titles, the first 200 characters as descriptions."""
    path = F.concat(F.coalesce("source_domain", F.lit("")), F.lit("/"), F.col("entry_id").cast("string"), F.lit(".txt"))
    return tables.entries(spark, folder).select(
        F.substring(F.sha2(path.cast("binary"), 256), 1, 32).alias("id"),
        F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).alias("title"),
        F.substring("content", 1, 200).alias("description"),
        F.lit("indexed-content").alias("tag"),
    )


@query("""
    SELECT s_suppkey AS id, array_to_string(list_filter([
        's_suppkey: ' || s_suppkey, CASE WHEN s_name <> '' THEN 's_name: ' || s_name END, 's_nationkey: ' || s_nationkey], lambda x: x IS NOT NULL), ', ') AS line
    FROM supplier""")
def row_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as lines of names and values, as tables are indexed; values that are empty are left out."""
    rows = tables.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return rows.select(F.col("s_suppkey").alias("id"), text.named_values(rows).alias("line"))


@query("""
    SELECT table_name AS "table", ordinal_position::INT AS position, column_name AS "column",
        CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int'
            WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type,
        CASE table_name WHEN 'documents' THEN (SELECT count(*) FROM documents) WHEN 'embeddings' THEN (SELECT count(*) FROM embeddings)
            WHEN 'pages' THEN (SELECT count(*) FROM pages) WHEN 'events' THEN (SELECT count(*) FROM events) WHEN 'orders' THEN (SELECT count(*) FROM orders) END AS rows
    FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'pages', 'events', 'orders')""")
def schema_report(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each column of the library's main tables: place, name, type, and how many rows its table has."""
    names = ("documents", "embeddings", "pages", "events", "orders")
    return sqlgate.schema_report({n: tables.table(spark, folder, n) for n in names})


@query("SELECT vec_id AS chunk_id, page_id, url FROM embeddings JOIN pages ON page_id = vec_id // 5")
def page_context(spark: SparkSession, folder: str) -> DataFrame:
    """The page each chunk comes from."""
    return tables.chunks(spark, folder).join(tables.pages(spark, folder), F.col("entry_id") == F.col("page_id")).select("chunk_id", "page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE {_HOST} NOT IN (SELECT {_HOST} FROM pages GROUP BY 1 HAVING count(*) > 1)")
def pages_alone_on_domain(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.pages(spark, folder)
    many = p.groupBy("domain").count().filter("count > 1").select("domain")
    return p.join(many, "domain", "left_anti").select("page_id", "url")


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def orphaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without a labelled entry; a null-aware anti join."""
    tables.table(spark, folder, "pages").createOrReplaceTempView("t_pages")
    tables.table(spark, folder, "labels").createOrReplaceTempView("t_labels")
    return run_safely(spark, "SELECT page_id FROM t_pages WHERE page_id NOT IN (SELECT doc_id FROM t_labels)", limit=None)


@query("SELECT doc_id AS entry_id, length(text) AS chars FROM documents WHERE length(text) > 5000 ORDER BY chars DESC, entry_id LIMIT 50")
def large_documents(spark: SparkSession, folder: str) -> DataFrame:
    tables.entries(spark, folder).createOrReplaceTempView("entries")
    return run_safely(spark, TEMPLATES["large_documents"], {"least": 5000}, limit=50)


@query("SELECT l_orderkey AS project_id, p_partkey AS entry_id, p_name AS title, l_discount AS relevance FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'")
def linked_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Three tables: links of closed projects with what they point to."""
    links = tables.project_links(spark, folder)
    closed = tables.cards(spark, folder).filter("column = 'F'").select("number")
    names = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"))
    return links.join(closed, F.col("number") == F.col("project_id")).join(names, "entry_id").select("project_id", "entry_id", "title", "relevance")


@query("SELECT o_orderkey AS number, o_custkey AS project_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_cards(spark: SparkSession, folder: str) -> DataFrame:
    tables.cards(spark, folder).createOrReplaceTempView("cards")
    return run_safely(spark, TEMPLATES["recent_cards"], {"column": "O"}, limit=50)


@query("SELECT user_id AS job_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def failed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    tables.job_events(spark, folder).createOrReplaceTempView("job_events")
    return run_safely(spark, TEMPLATES["failed_jobs"], {"state": "error"}, limit=None)


@query(f"SELECT {_HOST} AS domain, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def domain_stats(spark: SparkSession, folder: str) -> DataFrame:
    tables.pages(spark, folder).createOrReplaceTempView("pages_by_domain")
    return run_safely(spark, TEMPLATES["domain_stats"], limit=None)


@query("SELECT DISTINCT l_partkey AS entry_id FROM lineitem WHERE l_discount > 0.08 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    links = tables.table(spark, folder, "lineitem")
    a = links.filter("l_discount > 0.08").select(F.col("l_partkey").alias("entry_id"))
    b = tables.table(spark, folder, "part").filter("p_size > 25").select("p_partkey")
    return a.intersect(b).subtract(links.filter("l_quantity > 49").select("l_partkey"))


@query("SELECT coalesce(c_custkey, o_custkey) AS project_id, count(o_orderkey) AS cards, c_custkey IS NULL AS unknown FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1, 3")
def projects_full(spark: SparkSession, folder: str) -> DataFrame:
    """Full outer join: projects without cards and cards without a known project stay."""
    projects = tables.table(spark, folder, "customer").select("c_custkey")
    cards = tables.cards(spark, folder).groupBy("project_id").agg(F.count("number").alias("n"))
    both = projects.join(cards, F.col("c_custkey") == F.col("project_id"), "full")
    return both.select(F.coalesce("c_custkey", "project_id").alias("project_id"), F.coalesce("n", F.lit(0)).alias("cards"), F.col("c_custkey").isNull().alias("unknown"))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS suppliers, grouping_id(r_name, n_name) AS level FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: tables.table(spark, folder, n)
    rows = t("supplier").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))
    grouped = rows.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.grouping_id().cast("long").alias("level"))
    return grouped.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "suppliers", "level")


@query("SELECT doc_id AS entry_id, list_sort(list_filter([lang, source], lambda x: x IS NOT NULL)) AS tags, lang = 'en' OR source = 'src1' AS tagged FROM documents")
def tag_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Tags in order, and whether any of two is among them."""
    rows = tables.entries(spark, folder)
    tags = F.array_sort(F.filter("tags", lambda x: x.isNotNull()))
    return rows.select("entry_id", tags.alias("tags"), F.arrays_overlap(F.array(F.lit("en"), F.lit("src1")), "tags").alias("tagged"))


_NAMES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{n}')::INT AS columns, (SELECT count(*) FROM {n}) AS rows" for n in _NAMES))
def table_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every table with its numbers of columns and rows."""
    return sqlgate.table_report({n: tables.table(spark, folder, n) for n in _NAMES})
