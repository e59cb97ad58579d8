"""Queries over what crawls read: robots rules, sitemaps, discovery, frontier; texts are written by Spark from pages."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crawl, frontier
from ..sources import tables
from ..sources.storage import shared_dir
from .catalog import query
from .pages import _CLEAN, _normal

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_HOST = f"lower(regexp_extract(url, {_U}, 2))"
_SEGMENT = "regexp_extract(url, '^[^:]+://[^/]+(/[a-z]+/)', 1)"


def _segment() -> F.Column:
    return F.regexp_extract("url", "^[^:]+://[^/]+(/[a-z]+/)", 1)


@query(f"SELECT {_HOST} AS domain, list_sort(list(DISTINCT {_SEGMENT}) FILTER ({_SEGMENT} <> '' AND page_id % 2 = 0)) AS disallow, 2.5::DOUBLE AS delay, ['https://' || {_HOST} || '/sitemap.xml'] AS sitemaps FROM pages GROUP BY 1")
def robots_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Rules read back from a robots text for each domain, with groups for others around those for us."""
    p = tables.pages(spark, folder).withColumn("segment", _segment())
    rules = F.array_sort(F.collect_set(F.when((F.col("segment") != "") & (F.col("page_id") % 2 == 0), F.concat(F.lit("Disallow: "), F.col("segment")))))
    head, tail = "User-agent: other\nDisallow: /\n# comment\nUser-Agent: *\nCrawl-delay: 2.5\n", "\nUser-agent: other\nAllow: /x\n"
    found = p.groupBy("domain").agg(rules.alias("r")).withColumn("text", F.concat(F.lit(head), F.array_join("r", "\n"), F.lit(tail), F.lit("Sitemap: https://"), F.col("domain"), F.lit("/sitemap.xml")))
    parsed = found.select("domain", crawl.robots_rules(F.col("text"), "loom/1.0").alias("r"))
    empty = F.when(F.size("r.disallow") > 0, F.col("r.disallow"))
    return parsed.select("domain", empty.alias("disallow"), F.col("r.delay").alias("delay"), F.col("r.sitemaps").alias("sitemaps"))


@query(f"SELECT {_HOST} AS domain, url, CASE page_id % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 ELSE 0.9 END::DOUBLE AS priority FROM pages")
def sitemap_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses and priorities of each domain's sitemaps; every fifth has none and counts as 0.5."""
    n = F.col("page_id") % 5
    value = F.element_at(F.array(*(F.lit(x) for x in ("0.1", "0.3", "", "0.7", "0.9"))), (n + 1).cast("int"))
    block = F.concat(F.lit("<url>"), tables.loc(F.col("url")), F.when(value != "", F.concat(F.lit("<priority>"), value, F.lit("</priority>"))).otherwise(""), F.lit("</url>"))
    maps = tables.in_parts(tables.pages(spark, folder), "domain", "url").groupBy("domain", "part").agg(F.array_join(F.collect_list(block), "").alias("xml"))
    rows = maps.select("domain", F.explode(crawl.sitemap_entries(F.col("xml"))).alias("e"))
    return rows.select("domain", "e.url", "e.priority")


@query(f"SELECT DISTINCT url FROM pages WHERE {_HOST} LIKE '%.org'")
def nested_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pages found from an index for each top domain, over sitemaps of a bounded number of addresses."""
    p = tables.in_parts(tables.pages(spark, folder), "domain", "url")
    inner = p.groupBy("domain", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_set(tables.loc(F.col("url"))), ""), F.lit("</urlset>")).alias("xml"))
    inner = inner.select(F.concat_ws("#", "domain", "part").alias("url"), F.substring_index("domain", ".", -1).alias("top"), "xml")
    outer = tables.in_parts(inner, "top", "url").groupBy("top", "part").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_set(tables.loc(F.col("url"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    outer = outer.select(F.concat_ws("#", "top", "part").alias("url"), "top", "xml")
    seeds = outer.filter("top = 'org'").select("url")
    return crawl.expand_sitemaps(inner.select("url", "xml").unionByName(outer.select("url", "xml")), seeds)


@query(f"""
    WITH f AS (SELECT {_HOST} AS site, url, CASE page_id % 4 WHEN 0 THEN 'robots' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'base' ELSE 'llms' END AS way, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END AS place FROM pages)
    SELECT DISTINCT site, way, url FROM f JOIN (SELECT site, min(place) AS first FROM f GROUP BY 1) USING (site) WHERE place = first""")
def discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Of each domain the addresses of the first way that gave any; a page's id stands for the way it was found."""
    way = F.element_at(F.array(*map(F.lit, ("robots", "sitemap", "base", "llms"))), (F.col("page_id") % 4 + 1).cast("int"))
    return crawl.discovered(tables.pages(spark, folder).select(F.col("domain").alias("site"), way.alias("way"), "url"))


@query(f"SELECT normal, arg_min(depth, (batch, depth)) AS depth, min(batch) AS batch FROM (SELECT {_normal(_CLEAN)} AS normal, page_id % 3 AS depth, (page_id // 3) % 4 AS batch FROM pages) GROUP BY 1")
def frontier_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's address offered to a frontier that remembers in bitmaps, in four batches: the batch that admitted it."""
    p = tables.pages(spark, folder).select("url", (F.col("page_id") % 3).alias("depth"), (F.floor(F.col("page_id") / 3) % 4).alias("batch"))
    known = frontier.Frontier(spark, f"{shared_dir(spark)}/frontier-{uuid.uuid4().hex}")
    new = [known.admit(p.filter(F.col("batch") == b)).select("normal", "depth", F.lit(b).cast("long").alias("batch")) for b in range(4)]
    return functools.reduce(DataFrame.unionByName, new)


@query(f"SELECT page_id, {_HOST} AS domain, round((row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id % 3, url, page_id) - 1) * CASE WHEN {_HOST} LIKE '%.org' THEN 2.0 ELSE 0.1 END, 6)::DOUBLE AS after FROM pages")
def crawl_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """When each page may be fetched: ten a second for a domain, or as its delay says."""
    rows = tables.pages(spark, folder).withColumn("depth", F.col("page_id") % 3).withColumn("delay", F.when(F.col("domain").endswith(".org"), 2.0))
    nth = F.row_number().over(Window.partitionBy("domain", "depth", "url").orderBy("page_id"))
    rows = rows.withColumn("url", F.concat("url", F.lit("\u0001"), F.format_string("%09d", nth)))
    return crawl.schedule(rows).select("page_id", "domain", "after")


@query("""
    WITH d AS (SELECT doc_id AS entry_id, lower(coalesce(text, '')) AS low FROM documents),
    t AS (SELECT entry_id, CASE WHEN regexp_matches(low, 'bug|fix|broken') THEN 'bug_fix' WHEN regexp_matches(low, 'research|explore|investigate') THEN 'research' WHEN regexp_matches(low, 'refactor|reorganize|restructure') THEN 'refactor' ELSE 'feature' END AS template FROM d)
    SELECT entry_id, template, CASE template WHEN 'bug_fix' THEN 'Investigate,Fix,Test,Verify' WHEN 'research' THEN 'Explore,Prototype,Evaluate,Document' WHEN 'refactor' THEN 'Analyze,Plan,Execute,Verify' ELSE 'Design,Implement,Test,Document' END AS phases FROM t""")
def plan_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The plan that each entry's keywords call for, and its phases."""
    rows = tables.entries(spark, folder).select("entry_id", crawl.plan_template(F.col("content")).alias("template"))
    return rows.select("entry_id", "template", F.array_join(crawl.phases(F.col("template")), ",").alias("phases"))


@query("SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS items FROM events WHERE event_type = 'error'")
def job_with_items(spark: SparkSession, folder: str) -> DataFrame:
    """Failed items of each job in order of time, with their number; a row for each, as a job may have any number."""
    e = tables.job_events(spark, folder).filter("state = 'error'")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    counts = e.groupBy("job_id").agg(F.count("*").alias("items"))
    return e.withColumn("place", place).join(counts, "job_id").select("job_id", "event_id", "place", "items")


@query("SELECT user_id AS job_id, max(ts) AS ended FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY ended DESC, job_id LIMIT 20 OFFSET 10")
def list_jobs(spark: SparkSession, folder: str) -> DataFrame:
    done = tables.job_events(spark, folder).filter("state = 'purchase'").groupBy("job_id").agg(F.max("ts").alias("ended"))
    return done.orderBy(F.desc("ended"), "job_id").offset(10).limit(20)


@query("SELECT l_partkey AS entry_id, count(DISTINCT l_orderkey) AS projects, max(l_discount) AS best FROM lineitem GROUP BY 1")
def entry_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge the other way: how many projects each entry is linked to."""
    links = tables.project_links(spark, folder)
    return links.groupBy("entry_id").agg(F.count_distinct("project_id").alias("projects"), F.max("relevance").alias("best"))


@query("""
    WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|a|div)[ >]', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, tag) AS rank FROM b GROUP BY page_id, tag""")
def element_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of elements of each page by number; stands for languages of code blocks, which the pages lack."""
    tags = F.regexp_extract_all("html", F.lit("<(h1|p|li|a|div)[ >]"), F.lit(1))
    counts = tables.pages(spark, folder).select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "tag")))
