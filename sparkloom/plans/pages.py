"""Queries over pages: structure, links, addresses, tests of text."""

from __future__ import annotations

from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code, markup, selectors, text, urls
from ..operators import ingest, rules
from ..sources import tables
from ..sources.storage import small_batches
from .catalog import query

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_HOST = f"lower(regexp_extract(url, {_U}, 2))"
_PATH = f"regexp_extract(url, {_U}, 4)"
_QUERY = f"list_filter(string_split(regexp_extract(url, {_U}, 5), '&'), lambda p: p <> '')"


def _normal(parameters: str) -> str:
    cut = f"regexp_replace({_PATH}, '/+$', '')"
    joined = f"array_to_string(list_sort({parameters}), '&')"
    return f"lower(regexp_extract(url, {_U}, 1)) || '://' || {_HOST} || CASE WHEN {cut} = '' THEN '/' ELSE {cut} END || CASE WHEN {joined} <> '' THEN '?' || {joined} ELSE '' END"


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", markup.simple_title(F.col("html")).alias("title"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS headings FROM pages")
def page_headings(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", markup.headings(F.col("html")).alias("headings"))


@query("SELECT href, count(*) AS uses, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages) GROUP BY href")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = tables.pages(spark, folder).select("page_id", F.explode(markup.hrefs(F.col("html"))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("uses"), F.count_distinct("page_id").alias("pages"))


@query("SELECT page_id, regexp_extract(html, '(?is)<html[^>]*lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) AS n_links, len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS n_headings FROM pages")
def page_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a page's parts by the HTML parser."""
    small_batches(spark)
    p = tables.pages(spark, folder).select("page_id", markup.page_structure(F.col("html"), F.col("url")).alias("p"))
    return p.select("page_id", F.col("p.lang").alias("lang"), F.size("p.links").cast("long").alias("n_links"), F.size("p.headings").cast("long").alias("n_headings"))


@query()
def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Title, text density and Markdown of each page, by the HTML parser."""
    small_batches(spark)
    p = tables.pages(spark, folder).select("page_id", markup.page_structure(F.col("html"), F.col("url")).alias("p"))
    return p.select("page_id", "p.title", "p.description", F.round("p.density", 6).alias("density"), markup.clean_markdown(F.col("p.markdown")).alias("markdown"))


@query("SELECT page_id, md5(html) AS hash, sha256(html) AS sha, substr(sha256(url), 1, 32) AS id, strlen(html) AS bytes FROM pages")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.pages(spark, folder)
    return p.select("page_id", F.md5("html").alias("hash"), F.sha2("html", 256).alias("sha"), text.id_of_path(F.col("url")).alias("id"), F.octet_length("html").cast("long").alias("bytes"))


@query(f"SELECT page_id, {_normal(_QUERY)} AS normal FROM pages")
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", urls.normalized(F.col("url")).alias("normal"))


_CLEAN = f"list_filter({_QUERY}, lambda p: NOT (lower(split_part(p, '=', 1)) IN ('ref', 'source') OR starts_with(lower(split_part(p, '=', 1)), 'utm_')))"


@query(f"SELECT page_id, {_normal(_CLEAN)} AS normal FROM pages")
def url_untracked(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", urls.untracked(F.col("url")).alias("normal"))


@query(f"SELECT min(page_id) AS page_id, normal, count(*) AS seen FROM (SELECT page_id, {_normal(_CLEAN)} AS normal FROM pages) GROUP BY normal")
def url_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses admitted to a frontier: the first of each normal form."""
    p = tables.pages(spark, folder).select("page_id", urls.untracked(F.col("url")).alias("normal"))
    return p.groupBy("normal").agg(F.min("page_id").alias("page_id"), F.count("*").alias("seen")).select("page_id", "normal", "seen")


@query(f"SELECT page_id, regexp_replace(regexp_replace(lower({_HOST} || regexp_replace({_PATH}, '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", urls.slug(F.col("url")).alias("slug"))


@query(f"SELECT page_id, regexp_extract(url, {_U}, 1) IN ('http', 'https') AS fetchable FROM pages WHERE {_HOST} <> ''")
def fetchable_urls(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.pages(spark, folder)
    return p.filter("domain <> ''").select("page_id", urls.fetchable(F.col("url")).alias("fetchable"))


@query(f"SELECT DISTINCT {_HOST} AS domain, url FROM pages")
def sitemap_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemaps of each domain, written from its pages in parts of bounded size and read back."""
    p = tables.in_parts(tables.pages(spark, folder), "domain", "url")
    maps = p.groupBy("domain", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_set(F.concat(F.lit("<url>"), tables.loc(F.col("url")), F.lit("</url>"))), "\n"), F.lit("</urlset>")).alias("xml"))
    return maps.select("domain", F.explode(urls.sitemap_urls(F.col("xml"))).alias("url")).distinct()


@query(f"SELECT page_id, NOT (starts_with({_PATH}, '/de/') AND NOT regexp_matches({_PATH}, '\\.html$')) AS allowed FROM pages")
def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Paths tested by rules: German pages are closed but for those ending in .html."""
    allow, disallow = F.array(F.lit("/*.html$")), F.array(F.lit("/de/"), F.lit(""))
    return tables.pages(spark, folder).select("page_id", urls.path_allowed(urls.path(F.col("url")), allow, disallow).alias("allowed"))


_PAGES = f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, regexp_extract({_PATH}, '^/[a-z]+/', 0) AS section FROM pages"


@query(f"""
    WITH p AS ({_PAGES}),
    r AS (
        SELECT DISTINCT host, 'disallow' AS kind, section AS rule FROM p WHERE section <> '' AND page_id % 2 = 0
        UNION SELECT host, 'allow', section || '*.html$' FROM p WHERE section <> ''
        UNION SELECT host, 'allow', path FROM p WHERE page_id % 5 = 0 AND NOT contains(path, '*') AND path <> ''
        UNION SELECT host, 'disallow', '/*7' FROM p WHERE page_id % 3 = 0),
    m AS (
        SELECT page_id, kind = 'allow' AS allows, rule FROM p JOIN r USING (host)
        WHERE CASE WHEN rule = '/*7' THEN regexp_matches(path, '^/.*7') WHEN contains(rule, '*') THEN starts_with(path, section) AND section || '*.html$' = rule AND ends_with(path, '.html') ELSE starts_with(path, rule) END),
    b AS (SELECT page_id, arg_max(allows, (strlen(rule), allows::INT, rule)) AS allowed, arg_max(rule, (strlen(rule), allows::INT, rule)) AS rule FROM m GROUP BY 1)
    SELECT page_id, coalesce(allowed, true) AS allowed, rule FROM p LEFT JOIN b USING (page_id)""")
def robots_of_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages judged by a table of rules of all hosts: closed sections, open files, addresses and patterns taken from the pages."""
    path = urls.path(F.col("url"))
    p = tables.pages(spark, folder).select("page_id", F.col("domain").alias("host"), path.alias("path"), F.regexp_extract(path, "^/[a-z]+/", 0).alias("section"))
    kind = lambda k, rule: F.struct(F.lit(k).alias("kind"), rule.alias("rule"))
    sections = F.col("section") != ""
    found = F.array(
        F.when(sections & (F.col("page_id") % 2 == 0), kind("disallow", F.col("section"))),
        F.when(sections, kind("allow", F.concat("section", F.lit("*.html$")))),
        F.when((F.col("page_id") % 5 == 0) & ~F.contains("path", F.lit("*")), kind("allow", F.col("path"))),
        F.when(F.col("page_id") % 3 == 0, kind("disallow", F.lit("/*7"))),
    )
    table = p.select("host", F.explode(F.array_compact(found)).alias("r")).select("host", "r.kind", "r.rule")
    return rules.judged(p.select(F.col("page_id").alias("id"), "host", "path"), table).withColumnRenamed("id", "page_id")


@query(f"SELECT p.page_id FROM pages p, (SELECT {_HOST} AS h, regexp_replace({_PATH}, '[^/]+/*$', '') AS s FROM pages WHERE page_id = 0) z WHERE {_HOST.replace('url', 'p.url')} = z.h AND starts_with({_PATH.replace('url', 'p.url')}, z.s)")
def same_section(spark: SparkSession, folder: str) -> DataFrame:
    """Pages under the section of page 0."""
    p = tables.pages(spark, folder)
    seed = p.filter("page_id = 0").select(F.col("url").alias("seed"))  # one row
    return p.crossJoin(F.broadcast(seed)).filter(urls.same_section(F.col("url"), F.col("seed"))).select("page_id")


@query(f"SELECT page_id, regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1) AS ext, CASE WHEN lower({_PATH}) LIKE '%.html' THEN 'html' ELSE 'plain_text' END AS kind, CASE WHEN lower({_PATH}) LIKE '%.html' THEN 'document' ELSE 'other' END AS entry_type FROM pages")
def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    path = urls.path(F.col("url"))
    kind = text.source_type(path)
    return tables.pages(spark, folder).select("page_id", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).alias("ext"), kind.alias("kind"), text.entry_type(kind).alias("entry_type"))


_D = "FROM documents"
_BODY = "coalesce(text, '')"


@query(f"SELECT doc_id AS entry_id, regexp_replace(lower({_BODY}), '^\\s+|\\s+$', '', 'g') IN ('', {', '.join(repr(p) for p in text.PLACEHOLDERS)}) AS placeholder {_D}")
def placeholder_flags(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.is_placeholder(F.col("content")).alias("placeholder"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CODE = " OR ".join(f"contains({_BODY}, {_quoted(p)})" for p in text.CODE_WORDS)


@query(f"SELECT doc_id AS entry_id, ({_BODY} <> '' AND length({_BODY}) - length(translate({_BODY}, {_quoted(text.CODE_CHARACTERS)}, '')) > strlen({_BODY}) // 50) OR {_CODE} AS structured {_D}")
def code_structure_flags(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.has_code_structure(F.col("content")).alias("structured"))


_WORDS = f"list_filter(regexp_split_to_array(lower({_BODY}), '\\s+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w {_D}) SELECT doc_id AS entry_id, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ({', '.join(map(_quoted, text.PROSE_WORDS))}))) / len(w), 6) ELSE 0.0 END AS ratio FROM w")
def prose_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.prose_ratio(F.col("content")).alias("ratio"))


_NAV = " + ".join(f"contains(lower({_BODY}), {_quoted(p)})::INT" for p in text.NAVIGATION)


@query(f"WITH w AS (SELECT doc_id, len({_WORDS}) AS n, {_NAV} AS p, len(regexp_extract_all({_BODY}, '\\]\\(')) AS l {_D}) SELECT doc_id AS entry_id, (n < 100 AND p >= 3) OR l / greatest(n, 1) > 0.3 AS boilerplate FROM w")
def boilerplate_flags(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.is_boilerplate(F.col("content")).alias("boilerplate"))


_VOTES = ", ".join(f"({' + '.join(f'contains({_BODY}, {_quoted(p)})::INT' for p in ps)}) AS {k}" for k, ps in sorted(text.INDICATORS.items()))


@query(f"WITH v AS (SELECT doc_id, {_VOTES} {_D}), m AS (SELECT *, greatest(de, en, es, fr) AS top FROM v) SELECT doc_id AS entry_id, CASE WHEN top < 2 THEN NULL WHEN de = top THEN 'de' WHEN en = top THEN 'en' WHEN es = top THEN 'es' ELSE 'fr' END AS lang FROM m")
def language_vote(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.language_vote(F.col("content")).alias("lang"))


_SIGNS = ", ".join(f"({' + '.join(f'contains({_BODY}, {_quoted(p)})::INT' for p in ps)}) AS \"{k}\"" for k, ps in sorted(code.LANGUAGE_WORDS.items()))
_KNOWN = sorted(code.LANGUAGE_WORDS)
_CODE_VOTE = f"SELECT doc_id, source, CASE WHEN top >= 2 THEN CASE {' '.join(f'WHEN "{k}" = top THEN {_quoted(k)}' for k in _KNOWN)} END END AS language FROM (SELECT *, greatest({', '.join(f'"{k}"' for k in _KNOWN)}) AS top FROM (SELECT doc_id, source, {_SIGNS} FROM documents))"


@query(f"SELECT doc_id AS entry_id, language FROM ({_CODE_VOTE})")
def code_language_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The programming language of which a text has most words, two at least; ties go to the first name."""
    return tables.entries(spark, folder).select("entry_id", code.language_vote(F.col("content")).alias("language"))


@query(f"SELECT source, coalesce(language, 'unknown') AS language, count(*) AS blocks, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, coalesce(language, 'unknown')) AS rank FROM ({_CODE_VOTE}) GROUP BY 1, 2")
def code_language_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each source by programming language, commonest first; `unknown` where no language wins the vote."""
    language = F.coalesce(code.language_vote(F.col("content")), F.lit("unknown"))
    rows = tables.entries(spark, folder).select(F.col("source_domain").alias("source"), language.alias("language"))
    counts = rows.groupBy("source", "language").agg(F.count("*").alias("blocks"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("blocks"), "language")))


@query(f"SELECT doc_id AS entry_id, list_slice(list_filter(list_transform(regexp_split_to_array({_BODY}, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND strlen(x) < 80 AND len(regexp_extract_all(x, '\\p{{Lu}}')) > 1), 1, 10) AS lines {_D}")
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entries(spark, folder).select("entry_id", text.heading_lines(F.col("content")).alias("lines"))


@query("SELECT p_partkey AS entry_id, regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def title_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "part").select(F.col("p_partkey").alias("entry_id"), text.slug(F.col("p_name")).alias("slug"))


@query("SELECT page_id, list_filter([CASE WHEN contains(html, '__NEXT_DATA__') OR contains(html, '_next') THEN 'div#__next' END, CASE WHEN contains(html, 'docusaurus') THEN 'div#__docusaurus' END], lambda x: x IS NOT NULL) AS selectors FROM pages")
def framework_selectors(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).select("page_id", markup.framework_selectors(F.col("html")).alias("selectors"))


def _any(patterns: tuple[str, ...]) -> list[str]:
    return [f"regexp_matches({_BODY}, {_quoted(p)})" for p in patterns]


_INDICATED = " + ".join(f"{x}::INT" for x in _any(code.INDICATORS))
_BAD = " OR ".join(_any(code.BAD))
_LINES = f"regexp_split_to_array(regexp_replace({_BODY}, '\\n$', ''), '\\n')"
_PROSE = " + ".join(f"len(regexp_extract_all({_BODY}, {_quoted(p)}))" for p in code.PROSE)


@query(f"""
    WITH x AS (
        SELECT doc_id, strlen(regexp_replace({_BODY}, '^\\s+|\\s+$', '', 'g')) AS size, {_BAD} AS bad, {_INDICATED} AS n, {_LINES} AS lines, {_PROSE} AS prose, len(list_filter(regexp_split_to_array({_BODY}, '\\s+'), lambda w: w <> '')) AS words
        FROM documents),
    y AS (SELECT *, len(list_filter(lines, lambda l: regexp_matches(l, '\\S'))) AS filled, len(list_filter(lines, lambda l: {' OR '.join(f'regexp_matches(l, {_quoted(p)})' for p in code.COMMENT)})) AS comments, len(list_filter(lines, lambda l: strlen(l) > 300)) AS long_lines FROM x)
    SELECT doc_id AS entry_id, CASE
        WHEN size < 20 THEN 'too short' WHEN size > 50000 THEN 'too long' WHEN bad THEN 'bad extraction' WHEN n < 3 THEN 'few indicators' WHEN filled = 0 THEN 'no lines'
        WHEN comments / filled > 0.7 THEN 'comments' WHEN filled < 3 THEN 'few lines' WHEN long_lines > len(lines) // 2 THEN 'long lines' WHEN prose / greatest(words, 1) > 0.15 THEN 'prose' ELSE 'valid' END AS verdict
    FROM y""")
def code_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Why each text is no code, or that it may be."""
    return tables.entries(spark, folder).select("entry_id", code.verdict(F.col("content")).alias("verdict"))


# The text of an element in SQL: character references as html.unescape reads them, whose tables these are.
_NAMES = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in sorted(html5.items())) + "}"
_REMAPPED = "MAP {" + ", ".join(f"{k}: {_quoted(v) if v != chr(0) else 'chr(0)'}" for k, v in sorted(_invalid_charrefs.items())) + "}"
_NUMBER = """CASE WHEN lower(r[2]) = 'x' THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(ltrim(regexp_extract(lower(r), '^#x([0-9a-f]+)', 1), '0'), '')[1:7], lambda d: coalesce(nullif(strpos('0123456789abcdef', d), 0) - 1, 0)::HUGEINT)), lambda a, d: CASE WHEN a > 1114111 THEN a ELSE a * 16 + d END)
    ELSE coalesce(nullif(ltrim(regexp_extract(r, '^#([0-9]+)', 1), '0')[1:8], '')::HUGEINT, 0) END"""
_CHARACTER = f"CASE WHEN map_contains({_REMAPPED}, n::BIGINT) THEN ({_REMAPPED})[n::BIGINT] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n IN ({', '.join(map(str, sorted(_invalid_codepoints)))}) THEN '' ELSE chr(n::INT) END"
_HEAD_TEXTS = f"""
    h AS (SELECT page_id, row_number() OVER () AS head, string_split(regexp_replace(c, '<[^>]*>', '', 'g'), '&') AS parts FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) AS c FROM pages)),
    p AS (SELECT page_id, head, i, parts[i] AS part, CASE WHEN i > 1 THEN regexp_extract(parts[i], '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)') ELSE '' END AS r FROM (SELECT page_id, head, parts, unnest(range(1, len(parts) + 1)) AS i FROM h)),
    q AS (SELECT *, CASE WHEN r[1] = '#' THEN length(r) ELSE coalesce(list_max(list_filter(range(2, length(r) + 1), lambda k: map_contains({_NAMES}, r[1:k]))), 0) END AS used, CASE WHEN r[1] = '#' THEN {_NUMBER} END AS n FROM p),
    t AS (SELECT *, CASE WHEN i = 1 THEN part WHEN used = 0 THEN '&' || part WHEN n IS NULL THEN ({_NAMES})[r[1:used]] || part[used + 1:] ELSE {_CHARACTER} || part[used + 1:] END AS said FROM q),
    b AS (SELECT DISTINCT page_id, trim(c, chr(10)) AS content FROM (SELECT page_id, head, string_agg(said, '' ORDER BY i) AS c FROM t GROUP BY ALL))"""


@query(f"WITH {_HEAD_TEXTS} SELECT page_id, 'pre_only' AS pattern, 'text' AS language, content FROM b WHERE regexp_matches(content, '[^\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}]')")
def code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Code blocks by selectors, their text with character references read and each content once a page; first headings stand in for code, which the pages lack."""
    small_batches(spark)
    heads = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<h1>(.*?)</h1>"), F.lit(0)), "")
    marked = F.replace(F.replace(heads, F.lit("<h1>"), F.lit('<pre class="language-text">')), F.lit("</h1>"), F.lit("</pre>"))
    rows = tables.pages(spark, folder).select("page_id", F.explode(selectors.page_code(F.replace(marked, F.lit("language-text"), F.lit("brush-text")))).alias("c"))
    return rows.select("page_id", "c.pattern", "c.language", "c.content")


@query()
def ingested_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages parsed, cut under their headings, and embedded."""
    built = ingest.build(tables.pages(spark, folder), 64)
    return built.chunks.select("chunk_id", "chunk_type", F.md5("text").alias("digest"), F.size("vector").alias("dim"))
