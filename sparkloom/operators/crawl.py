"""What a crawl needs to decide: robots rules, sitemaps, discovery, admission to the frontier, delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.storage import stored


def robots_rules(text: Column, agent: str) -> Column:
    """struct<allow, disallow, delay, sitemaps> of the groups that are meant for an agent (or for all).

    A fold over the lines: a user-agent line says whether what follows counts; sitemap lines always do.
    """
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    pairs = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & F.contains(x, F.lit(":")))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("on"), empty.alias("allow"), empty.alias("disallow"), F.lit(None).cast("double").alias("delay"), empty.alias("sitemaps"))

    def step(a: Column, line: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        add = lambda name, when: F.when(when & (value != ""), F.concat(a[name], F.array(value))).otherwise(a[name]).alias(name)
        mine = (value == "*") | ((value != "") & F.contains(F.lit(agent), value))
        return F.struct(
            F.when(key == "user-agent", mine).otherwise(a["on"]).alias("on"),
            add("allow", a["on"] & (key == "allow")),
            add("disallow", a["on"] & (key == "disallow")),
            F.when(a["on"] & (key == "crawl-delay"), F.coalesce(value.try_cast("double"), a["delay"])).otherwise(a["delay"]).alias("delay"),
            add("sitemaps", key == "sitemap"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.struct(a["allow"].alias("allow"), a["disallow"].alias("disallow"), a["delay"].alias("delay"), a["sitemaps"].alias("sitemaps")))


def sitemap_entries(xml: Column) -> Column:
    """array<struct<url, priority, changed>> of a sitemap, highest priority first (0.5 where none is given), then by address."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    take = lambda b, tag: F.trim(F.regexp_extract(b, f"(?is)<{tag}>(.*?)</{tag}>", 1))

    def entry(b: Column) -> Column:
        priority = F.coalesce(F.nullif(take(b, "priority"), F.lit("")).try_cast("double"), F.lit(0.5))
        return F.struct((-priority).alias("order"), F.replace(take(b, "loc"), F.lit("&amp;"), F.lit("&")).alias("url"), F.nullif(take(b, "lastmod"), F.lit("")).alias("changed"))

    ranked = F.array_sort(F.filter(F.transform(blocks, entry), lambda e: e["url"] != ""))
    return F.transform(ranked, lambda e: F.struct(e["url"].alias("url"), (-e["order"]).alias("priority"), e["changed"].alias("changed")))


def expand_sitemaps(maps: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Page addresses under seed sitemaps (url), following indexes in maps (url, xml) for `depth` levels at most."""
    seen = stored(seeds.select("url").distinct(), "maps")
    edge, pages = seen, None
    for _ in range(depth):
        found = edge.join(maps, "url").select(urls.is_sitemap_index(F.col("xml")).alias("index"), F.explode(urls.sitemap_urls(F.col("xml"))).alias("to"))
        found = stored(found.distinct(), "maps")
        part = found.filter("not index").select(F.col("to").alias("url"))
        pages = part if pages is None else pages.unionByName(part)
        edge = stored(found.filter("index").select(F.col("to").alias("url")).join(seen, "url", "left_anti"), "maps")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return pages.distinct()


#: Ways to learn a site's addresses, the best first: fixed values.
WAYS = ("llms", "sitemap", "robots", "base")


def discovered(found: DataFrame) -> DataFrame:
    """found: site, way, url. Of each site the addresses of the first way that gave any."""
    place = F.array_position(F.array(*map(F.lit, WAYS)), F.col("way"))
    rows = found.filter("url is not null and url <> ''").withColumn("place", place).filter("place > 0")
    first = rows.groupBy("site").agg(F.min("place").alias("first"))
    return rows.join(first, "site").filter("place = first").select("site", "way", "url").distinct()


def admitted(tasks: DataFrame, seen: DataFrame, most: int | None = None) -> DataFrame:
    """tasks: url, depth. New addresses in their normal form, with the smallest depth; in order of depth if cut to `most`."""
    rows = tasks.withColumn("normal", urls.untracked(F.col("url"))).groupBy("normal").agg(F.min("depth").alias("depth"), F.min("url").alias("url"))
    rows = rows.join(seen.select(urls.untracked(F.col("url")).alias("normal")).distinct(), "normal", "left_anti")
    return rows if most is None else rows.orderBy("depth", "normal").limit(most)


def schedule(tasks: DataFrame, per_second: float = 10.0) -> DataFrame:
    """tasks: domain, url, depth, delay (seconds or null). When each may be fetched: seconds from the start of its domain."""
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("depth", "url")) - 1
    step = F.greatest(F.coalesce("delay", F.lit(0.0)), F.lit(1 / per_second))
    return tasks.withColumn("after", F.round(nth * step, 6))


#: Keywords of descriptions, and the phases of work they call for: fixed values.
TEMPLATES = {
    "bug_fix": (("bug", "fix", "broken"), ("Investigate", "Fix", "Test", "Verify")),
    "research": (("research", "explore", "investigate"), ("Explore", "Prototype", "Evaluate", "Document")),
    "refactor": (("refactor", "reorganize", "restructure"), ("Analyze", "Plan", "Execute", "Verify")),
    "feature": ((), ("Design", "Implement", "Test", "Document")),
}


def plan_template(description: Column) -> Column:
    low = F.lower(description)
    out = F.lit("feature")
    for name, (words, _) in reversed(TEMPLATES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def phases(template: Column) -> Column:
    out = F.array(*map(F.lit, TEMPLATES["feature"][1]))
    for name, (_, steps) in TEMPLATES.items():
        out = F.when(template == name, F.array(*map(F.lit, steps))).otherwise(out)
    return out


def fetched(pages: DataFrame) -> DataFrame:
    """Pages (url, status, html) that were answered, with title and hash; statuses of 400 and above are errors."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return pages.filter("status < 400").select("*", F.nullif(title, F.lit("")).alias("title"), F.sha2("html", 256).alias("content_hash"))
