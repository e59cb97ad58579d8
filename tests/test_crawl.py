from pyspark.sql import functions as F

from sparkloom.operators import crawl

ROBOTS = """# all
User-agent: LoomBot
Disallow: /private
Allow: /private/open
Crawl-delay: 1.5
Disallow:
no colon here

User-agent: *
Disallow: /tmp
Crawl-delay: soon
Sitemap: https://e.org/s.xml
User-agent: other
Disallow: /
"""


def test_robots_groups(spark):
    one = lambda agent: spark.range(1).select(crawl.robots_rules(F.lit(ROBOTS), agent)).first()[0]
    mine = one("LoomBot/1.0")
    assert (mine.allow, mine.disallow, mine.delay, mine.sitemaps) == (["/private/open"], ["/private", "/tmp"], 1.5, ["https://e.org/s.xml"])
    assert (one("else").disallow, one("else").delay) == (["/tmp"], None)
    assert spark.range(1).select(crawl.robots_rules(F.lit(""), "x")).first()[0].disallow == []


def test_sitemap_entries_by_priority(spark):
    xml = "<url><loc>/b</loc></url><url><loc>/a</loc><priority>0.9</priority><lastmod>2024-01-01</lastmod></url><url><loc>/c</loc><priority>bad</priority></url><url></url>"
    found = spark.range(1).select(crawl.sitemap_entries(F.lit(xml))).first()[0]
    assert [(e.url, e.priority, e.changed) for e in found] == [("/a", 0.9, "2024-01-01"), ("/b", 0.5, None), ("/c", 0.5, None)]


def test_nested_sitemaps_and_circles(spark):
    maps = spark.createDataFrame(
        [("i", "<sitemapindex><loc>a</loc><loc>i</loc><loc>missing</loc></sitemapindex>"), ("a", "<urlset><loc>p1</loc><loc>p2</loc></urlset>"), ("z", "<urlset><loc>no</loc></urlset>")], "url string, xml string"
    )
    seeds = spark.createDataFrame([("i",)], "url string")
    assert sorted(r.url for r in crawl.expand_sitemaps(maps, seeds).collect()) == ["p1", "p2"]


def test_discovery_takes_the_first_way(spark):
    rows = [("s", "base", "s/"), ("s", "robots", "s/r"), ("s", "sitemap", None), ("t", "base", "t/"), ("u", "llms", "u/1"), ("u", "llms", "u/1"), ("u", "odd", "x")]
    found = crawl.discovered(spark.createDataFrame(rows, "site string, way string, url string")).collect()
    assert sorted(tuple(r) for r in found) == [("s", "robots", "s/r"), ("t", "base", "t/"), ("u", "llms", "u/1")]


def test_frontier_and_schedule(spark):
    tasks = spark.createDataFrame([("https://e.org/a/", 2), ("https://E.org/a?utm_x=1", 1), ("https://e.org/b", 0), ("https://e.org/c", 3)], "url string, depth int")
    seen = spark.createDataFrame([("https://e.org/b#x",)], "url string")
    assert sorted((r.normal, r.depth) for r in crawl.admitted(tasks, seen).collect()) == [("https://e.org/a", 1), ("https://e.org/c", 3)]
    assert [r.normal for r in crawl.admitted(tasks, seen, 1).collect()] == ["https://e.org/a"]
    plan = tasks.withColumn("domain", F.lit("e.org")).withColumn("delay", F.lit(None).cast("double"))
    assert [r.after for r in crawl.schedule(plan).orderBy("after").collect()] == [0.0, 0.1, 0.2, 0.3]


def test_plan_templates(spark):
    texts = ["Fix it", "explore this", "Restructure", "new thing", "investigate a bug"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", crawl.plan_template(F.col("t")).alias("p")).orderBy("i")
    assert [r.p for r in df.collect()] == ["bug_fix", "research", "refactor", "feature", "bug_fix"]
    assert spark.range(1).select(crawl.phases(F.lit("research"))).first()[0] == ["Explore", "Prototype", "Evaluate", "Document"]
