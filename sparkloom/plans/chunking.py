"""Queries that cut entries into chunks, and that tag and embed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import embed
from ..operators import chunkers, tags
from ..sources import tables
from ..sources.storage import small_batches
from .catalog import query

_BODY = "coalesce(text, '')"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CUT = _TRIM.format("substr(t, i * 462 + 1, 512)")
_WINDOWS = f"""
    w AS (SELECT doc_id, {_BODY} AS t, unnest(CASE WHEN length({_BODY}) > 0 THEN range(0, greatest(ceil((length({_BODY}) - 512) / 462)::BIGINT, 0) + 1) ELSE [] END) AS i FROM documents),
    c AS (SELECT doc_id, i, {_CUT} AS text FROM w)"""
_SUMMARY = f"""(SELECT doc_id, array_to_string(list_filter([split_part({_BODY}, chr(10), 1), 'Tags: ' || array_to_string(list_filter([lang, source], lambda x: x IS NOT NULL), ', ')], lambda x: x IS NOT NULL), '. ') AS s FROM documents)"""
_CUT_SUMMARY = "CASE WHEN strlen(s) > 1024 THEN substr(s, 1, 1024) ELSE s END"


@query(f"WITH {_WINDOWS} SELECT doc_id AS entry_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, md5(text) AS digest, length(text) AS chars FROM c WHERE text <> ''")
def sliding_window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.entries(spark, folder).select("entry_id", F.posexplode(chunkers.windows(F.col("content"))).alias("part", "text"))
    return rows.select("entry_id", "part", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query(f"SELECT doc_id AS entry_id, {_CUT_SUMMARY} AS summary FROM {_SUMMARY}")
def summary_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.entries(spark, folder)
    return rows.select("entry_id", chunkers.summary(F.col("title"), F.lit(""), F.col("tags")).alias("summary"))


@query(f"""
    WITH {_WINDOWS},
    a AS (SELECT doc_id, -1 AS i, 'summary' AS chunk_type, {_CUT_SUMMARY} AS text FROM {_SUMMARY} UNION ALL SELECT doc_id, i, 'content', text FROM c WHERE text <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM a WHERE strlen(text) >= 50)
    SELECT doc_id || '#' || n AS chunk_id, chunk_type, md5(text) AS digest FROM b""")
def basic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunkers.basic_chunks(tables.entries(spark, folder)).select("chunk_id", "chunk_type", F.md5("text").alias("digest"))


@query("WITH p AS (SELECT page_id, string_split(html, '</p>') AS s FROM pages) SELECT page_id, i - 1 AS part, i % 2 = 0 AS code, md5(s[i]) AS digest FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM p)")
def fence_split(spark: SparkSession, folder: str) -> DataFrame:
    """Parts between fences, in turn text and code; paragraph ends stand in for fences, which the pages lack."""
    text = F.replace("html", F.lit("</p>"), F.lit("```"))
    rows = tables.pages(spark, folder).select("page_id", F.explode(chunkers.fence_parts(text)).alias("p"))
    return rows.select("page_id", "p.part", "p.code", F.md5("p.text").alias("digest"))


_MARKED = "regexp_replace(regexp_replace(coalesce(html, ''), '<h([1-6])[^>]*>', chr(10) || '## ', 'g'), '<[^>]*>', chr(10), 'g')"


@query(f"""
    WITH l AS (SELECT page_id, string_split({_MARKED}, chr(10)) AS x FROM pages),
    n AS (SELECT page_id, i, x[i] AS line FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM l)),
    h AS (SELECT *, regexp_matches(line, '^\\s*#{{1,6}}([^#]|$)') AS head, sum(strlen(line) + 1) OVER (PARTITION BY page_id ORDER BY i) - strlen(line) - 1 AS pos FROM n),
    s AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM h),
    g AS (SELECT page_id, sec, max(CASE WHEN head THEN '## ' || regexp_replace(line, '^\\s*#{{1,6}}\\s*', '') END) AS header, min(pos)::BIGINT AS start,
                 regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY page_id, sec)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS section, header, start, md5(body) AS digest FROM g WHERE header IS NOT NULL OR body <> ''""")
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of pages whose headings are written as Markdown headers."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<h([1-6])[^>]*>", "\n## "), "<[^>]*>", "\n")
    rows = chunkers.sections(tables.pages(spark, folder).select("page_id", marked.alias("text")), "page_id", "text")
    return rows.select("page_id", "section", "header", "start", F.md5("body").alias("digest"))


def _packed(spark: SparkSession, folder: str, how: str) -> DataFrame:
    rows = chunkers.packed_chunks(tables.entries(spark, folder), how)
    return rows.select("entry_id", "chunk_index", "chunk_type", F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"))


@query()
def smart_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, "smart")


@query()
def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, "paragraphs")


@query()
def markdown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, "markdown")


_STOPS = ", ".join(f"'{w}'" for w in tags.STOP_WORDS)
_PHRASES = f"""
    m AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower({_BODY}), '[^\\p{{L}}\\p{{N}}\\s''-]+', ' | ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM documents),
    r AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN x = '|' OR x IN ({_STOPS}) THEN '|' ELSE x END), ' '), '|'), lambda p: trim(p)), lambda p: p <> '')) AS phrase FROM m),
    p AS (SELECT doc_id, phrase, count(*) AS uses, len(string_split(phrase, ' ')) AS n FROM r WHERE len(string_split(phrase, ' ')) <= 4 GROUP BY ALL),
    x AS (SELECT doc_id, phrase, uses, n, unnest(string_split(phrase, ' ')) AS word FROM p),
    g AS (SELECT doc_id, word, sum(uses * n) / sum(uses) AS weight FROM x GROUP BY ALL),
    k AS (SELECT doc_id, phrase AS tag, round(sum(weight), 6) AS score FROM x JOIN g USING (doc_id, word) GROUP BY ALL),
    rake AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM k WHERE score >= 1) WHERE rank <= 20)"""
_TERMS = f"""
    ss AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({_BODY}), '[.!?]+'), lambda s: regexp_matches(s, '\\p{{L}}')) AS s FROM documents),
    sw AS (SELECT doc_id, len(s) AS sentences, i, unnest(list_filter(regexp_extract_all(s[i], '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOPS}))) AS word FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM ss)),
    sc AS (SELECT doc_id, sentences, word, count(*) AS tf, count(DISTINCT i) AS df FROM sw GROUP BY ALL),
    sr AS (SELECT doc_id, word AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((1 + sentences) / (1 + df)), 6) DESC, word) AS rank FROM sc WHERE strlen(word) >= 3),
    tfidf AS (SELECT doc_id, tag, round((6 - rank) / 5.0, 6)::DOUBLE AS score, rank FROM sr WHERE rank <= 5)"""


@query(f"WITH {_PHRASES} SELECT doc_id AS entry_id, tag, score, rank FROM rake")
def rake_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tags.rake(tables.entries(spark, folder), "entry_id", "content")


@query(f"WITH {_TERMS} SELECT doc_id AS entry_id, tag, score, rank FROM tfidf")
def tfidf_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tags.tfidf(tables.entries(spark, folder), "entry_id", "content")


@query(f"""
    WITH {_PHRASES}, {_TERMS},
    o AS (SELECT doc_id, unnest(list_filter([lang, source], lambda x: x IS NOT NULL)) AS tag, 1000.0::DOUBLE AS score FROM documents),
    u AS (SELECT doc_id, lower(tag) AS tag, max(score) AS score FROM (SELECT * FROM o UNION ALL SELECT doc_id, tag, score FROM rake UNION ALL SELECT doc_id, tag, score FROM tfidf) GROUP BY ALL)
    SELECT doc_id AS entry_id, tag, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM u) WHERE rank <= 10""")
def merged_tags(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.entries(spark, folder)
    own = e.select("entry_id", F.explode(F.filter("tags", lambda x: x.isNotNull())).alias("tag"))
    return tags.merged("entry_id", [tags.rake(e, "entry_id", "content"), tags.tfidf(e, "entry_id", "content")], own)


@query()
def text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry's hashed embedding: its length, and its largest number."""
    small_batches(spark)
    rows = tables.entries(spark, folder).select("entry_id", embed(F.col("content"), 256).alias("v"))
    return rows.select("entry_id", F.size("v").alias("dim"), F.round(F.array_max("v").cast("double"), 5).alias("largest"))
