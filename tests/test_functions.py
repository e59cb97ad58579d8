import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code, text, urls
from sparkloom.functions.embed import embed, hashed_vector


@pytest.fixture
def each(spark):
    """Values of a column function over strings."""

    def run(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]

    return run


def test_normal_forms(each):
    assert each(urls.normalized, "HTTP://Ex.org:80/A/b/?b=2&a=1#f", "https://ex.org", "https://u:p@ex.org/?", "nonsense", None) == [
        "http://ex.org/A/b?a=1&b=2", "https://ex.org/", "https://ex.org/", ":///", ":///"]
    assert each(urls.untracked, "https://e.org/x?utm_source=a&q=1&ref=b&UTM_x=2") == ["https://e.org/x?q=1"]
    assert each(urls.slug, "https://ex.org/Docs/First_Page.html?x=1") == ["ex-org-docs-first-page"]


def test_domains_and_private_addresses(each):
    assert each(lambda d: urls.allowed(d, ("a.org",), ("x.a.org",)), "a.org", "b.a.org", "x.a.org", "y.x.a.org", "ba.org") == [True, True, False, False, False]
    bad = ["10.1.2.3", "127.0.0.1", "172.16.0.1", "192.168.1.1", "169.254.169.254", "localhost", "metadata.google.internal"]
    assert each(urls.private_address, *bad) == [True] * len(bad)
    assert each(urls.private_address, "172.32.0.1", "8.8.8.8", "example.org") == [False] * 3
    assert each(urls.fetchable, "ftp://a.org/", "https://a.org/", "http://10.0.0.1/") == [False, True, False]


@pytest.mark.parametrize(
    ("path", "allow", "disallow", "want"),
    [
        ("/private/x", [], ["/private"], False),
        ("/private/ok", ["/private/ok"], ["/private"], True),
        ("/a/b.pdf", [], ["/*.pdf$"], False),
        ("/a/b.pdf?x", [], ["/*.pdf$"], True),
        ("/a+b", [], ["/a+b"], False),
        ("/any", [], [""], True),
    ],
)
def test_robots_rules(spark, path, allow, disallow, want):
    a, d = (F.array(*map(F.lit, x)).cast("array<string>") for x in (allow, disallow))
    assert spark.range(1).select(urls.path_allowed(F.lit(path), a, d)).first()[0] is want


def test_sitemaps_and_lists(each):
    xml = "<urlset><url><loc> https://a.org/?x=1&amp;y=2 </loc></url><url><LOC>https://a.org/b</LOC></url></urlset>"
    assert each(urls.sitemap_urls, xml, "") == [["https://a.org/?x=1&y=2", "https://a.org/b"], []]
    assert each(urls.is_sitemap_index, "<sitemapindex>", xml) == [True, False]
    assert each(urls.listed_urls, "# c\n\n https://a.org \r\n/b") == [["https://a.org", "/b"]]
    assert each(urls.robots_sitemaps, "User-agent: *\nSitemap: https://a.org/s.xml\nsitemap:/t.xml") == [["https://a.org/s.xml", "/t.xml"]]
    seed = F.lit("https://a.org/docs/guide/one")
    assert each(lambda u: urls.same_section(u, seed), "https://a.org/docs/guide/two", "https://a.org/docs/x", "https://b.org/docs/guide/two") == [True, False, False]


def test_text_flags(each):
    assert each(text.is_placeholder, " Loading... ", "", "real text") == [True, True, False]
    assert each(text.has_code_structure, "x = f(y);", "plain words only", "import os") == [True, False, True]
    assert each(text.prose_ratio, "the cat", "", "Is THE it") == [0.5, 0.0, 1.0]
    assert each(text.is_boilerplate, "Log in Sign up Menu", "words", "[a](b) [c](d)") == [True, False, True]
    assert each(text.language_vote, "this is the best and", "und der ist die da", "nothing") == ["en", "de", None]
    assert each(text.heading_lines, "First Title Here\nplain\nAB") == [["First Title Here", "AB"]]


@pytest.mark.parametrize(("size", "want"), [(500, "500 bytes"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (234881024, "224.0 MB"), (1073741824, "1.0 GB")])
def test_sizes(spark, size, want):
    assert spark.range(1).select(text.size_text(F.lit(size))).first()[0] == want


def test_names(each):
    assert each(text.title_of_name, "my-first_file.csv") == ["My First File"]
    assert each(text.slug, "Ärger & Söhne, 2nd!") == ["ärger-söhne-2nd"]
    assert each(text.source_type, "https://a.org/x.pdf", "a/B.PDF", "main.rs", "README", "t.xls") == ["url", "pdf", "source_code", "plain_text", "excel"]
    assert each(lambda x: text.entry_type(text.source_type(x)), "a.pdf", "a.py", "a.md", "a.csv") == ["pdf", "code", "document", "other"]
    assert each(code.canonical_language, "PY3", "c++", "fish", "klingon") == ["python", "cpp", "shell", "other"]
    assert each(code.alias, "JS", "Go") == ["javascript", "go"]


RUST = "pub fn add(a: i32, b: i32) -> i32 {\n    let c = a + b;\n    return c;\n}\n"


@pytest.mark.parametrize(
    ("source", "language", "want"),
    [
        (RUST, "rust", "valid"),
        ("x", None, "too short"),
        ("y" * 150 + " z" * 30_000, None, "too long"),
        ("graph TD; A --> B; B --> C; C --> D", "mermaid", "diagram"),
        ("defmain(x):\n  return classy = importos\n", None, "bad extraction"),
        ("some words that say nothing here", None, "few indicators"),
        ("# a = f(x)\n# if b: import c\n# return d\nx = [1]\n", None, "comments"),
        ("a = [1, 2]; if x: print(y.z)", None, "few lines"),
        ("x = [1]\ny = f(x)\nz = {2}\n", "python", "wrong language"),
        ("if (x) { the = y.z; }\nthis is what was there.\nThese are those that should have had it. The end. That is it.\n", None, "prose"),
    ],
)
def test_code_verdicts(spark, source, language, want):
    assert spark.range(1).select(code.verdict(F.lit(source), F.lit(language) if language else None)).first()[0] == want


def test_embedding(each):
    a, b, blank = each(lambda x: embed(x, 32), "One two", "one two", " ")
    assert a == b == [float(x) for x in hashed_vector("one two", 32)]
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and set(blank) == {0.0}
