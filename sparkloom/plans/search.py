"""Queries of the search core: vectors, text, fusion, links between entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings, ranking, vectors
from ..sources import tables
from ..sources.storage import shared_dir
from .catalog import ORACLE_SQL, query

TERMS = ("with", "that", "para", "nicht", "dans")
_CHUNKS = "SELECT vec_id AS chunk_id, vec_id // 5 AS entry_id, (vec_id % 5)::INT AS chunk_index, label AS chunk_type, embedding::DOUBLE[] AS v FROM embeddings"
_NEAR = f"""
    c AS ({_CHUNKS}),
    d AS (SELECT chunk_id, entry_id, chunk_index, chunk_type, round(list_distance(v, (SELECT v FROM c WHERE chunk_id = 0)), 6) AS distance FROM c)"""


def _bm25_sql(docs: str, where: str = "true", limit: int = 150) -> str:
    """BM25 over docs(id, text); where filters hits by columns of docs."""
    asked = ", ".join(f"'{t}'" for t in sorted(TERMS))
    return f"""
    x AS (SELECT *, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) <= 40) AS words FROM ({docs})),
    s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM x),
    p AS (SELECT id, len(words) AS len, unnest(list_filter(words, lambda t: list_contains([{asked}], t))) AS term FROM x),
    tf AS (SELECT id, len, term, count(*) AS tf FROM p GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    b AS (
        SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
        FROM tf JOIN df USING (term) CROSS JOIN s GROUP BY id),
    t AS (SELECT id, score FROM b WHERE id IN (SELECT id FROM x WHERE {where}) ORDER BY score DESC, id LIMIT {limit})"""


_ENTRIES = "SELECT doc_id AS id, text, lang FROM documents"
_PAGES = "SELECT page_id AS id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages"


def _near(spark: SparkSession, folder: str, k: int, where: F.Column | None = None) -> DataFrame:
    c = tables.chunks(spark, folder)
    return vectors.top_k(c, vectors.vector_of(c, 0), k, where)


def _index(spark: SparkSession, folder: str) -> postings.Index:
    """The stored index of the entries, built by the first query that asks for it."""
    return postings.index_of(spark, folder, "documents", tables.entries(spark, folder).select("entry_id", "content", "entry_type"), "content")


def _texts(spark: SparkSession, folder: str, limit: int, where: F.Column | None = None) -> DataFrame:
    return ranking.bm25(tables.entries(spark, folder), "entry_id", "content", TERMS, limit, where)


@query(f"WITH {_NEAR} SELECT chunk_id, distance, round(1 / (1 + distance), 6) AS score FROM d ORDER BY distance, chunk_id LIMIT 10")
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder, 10).select("chunk_id", "distance", "score")


@query(f"WITH {_NEAR} SELECT chunk_id, distance FROM d WHERE chunk_type = 3 ORDER BY distance, chunk_id LIMIT 10")
def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filter acts before the cut."""
    return _near(spark, folder, 10, F.col("chunk_type") == 3).select("chunk_id", "distance")


@query(f"WITH {_NEAR}, k AS (SELECT * FROM d ORDER BY distance, chunk_id LIMIT 50) SELECT chunk_id, distance FROM k WHERE chunk_type = 3")
def knn_post_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The filter acts on the 50 nearest, and may leave fewer."""
    return _near(spark, folder, 50).filter("chunk_type = 3").select("chunk_id", "distance")


@query(f"""
    WITH c AS ({_CHUNKS}),
    d AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(list_distance(q.v, c.v), 6) AS distance FROM c q, c WHERE q.chunk_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
    SELECT query_id, chunk_id, distance, rank FROM r WHERE rank <= 10""")
def knn_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    c = tables.chunks(spark, folder)
    asked = c.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return vectors.batch_top_k(c, asked, 10)


@query(f"""
    WITH c AS ({_CHUNKS}),
    q AS (SELECT * FROM c WHERE chunk_index = 0 AND entry_id % 50 = 0),
    d AS (SELECT q.chunk_id AS query_id, q.entry_id AS x, c.entry_id AS y, c.chunk_id, round(list_distance(q.v, c.v), 6) AS distance
          FROM q, c WHERE q.chunk_id <> c.chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
    SELECT least(x, y) AS a, greatest(x, y) AS b, max(round(1 / (1 + distance), 6)) AS weight FROM r WHERE rank <= 5 AND x <> y GROUP BY ALL""")
def entry_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from every fiftieth entry to the entries of its five nearest chunks."""
    c = tables.chunks(spark, folder)
    return vectors.entry_edges(c, vectors.first_vectors(c).filter("entry_id % 50 = 0"))


@query(f"""
    WITH {_NEAR}, k AS (SELECT * FROM d ORDER BY distance, chunk_id LIMIT 50),
    n AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY distance, chunk_id) AS nth, round(1 / (1 + distance), 6) AS s FROM k WHERE entry_id <> 0)
    SELECT entry_id, chunk_id, s AS score, CASE WHEN s >= 0.6 THEN 'strong' WHEN s >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength
    FROM n WHERE nth = 1 AND s >= 0.1 ORDER BY s DESC, chunk_id LIMIT 10""")
def link_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    c = tables.chunks(spark, folder)
    return vectors.related_entries(c, vectors.vector_of(c, 0), 0, 10, 50, 0.1, 0.6)


@query(f"""
    WITH {_NEAR}, k AS (SELECT * FROM d WHERE chunk_type = (SELECT chunk_type FROM c WHERE chunk_id = 0) ORDER BY distance, chunk_id LIMIT 30),
    n AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY distance, chunk_id) AS nth, round(1 / (1 + distance), 6) AS s FROM k WHERE entry_id <> 0)
    SELECT entry_id, chunk_id, s AS score FROM n WHERE nth = 1 ORDER BY s DESC, chunk_id LIMIT 5""")
def related_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the same type near entry 0, itself left out."""
    c = tables.chunks(spark, folder)
    kind = c.filter("chunk_id = 0").select("chunk_type").first()[0]
    return vectors.related_entries(c, vectors.vector_of(c, 0), 0, 5, 30, 0.0, where=F.col("chunk_type") == kind).drop("strength")


@query(f"WITH c AS ({_CHUNKS}) SELECT entry_id, chunk_id, round(v[1], 6) AS first_number FROM c WHERE chunk_index = 0")
def entry_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors.first_vectors(tables.chunks(spark, folder))
    return rows.select("entry_id", "chunk_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first_number"))


@query(f"WITH {_bm25_sql(_ENTRIES)} SELECT id AS entry_id, score FROM t")
def bm25_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, 150)


@query("WITH " + _bm25_sql(_ENTRIES, "lang = 'en'") + " SELECT id AS entry_id, score FROM t")
def bm25_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, 150, F.col("entry_type") == "en")


_ITEMS = "SELECT conv_id || '/' || turn AS id, role, text FROM conversations"


@query("WITH " + _bm25_sql(_ITEMS, "role = 'user'", 60) + " SELECT id AS item_id, score FROM t")
def bm25_items(spark: SparkSession, folder: str) -> DataFrame:
    """Text search over work items of one kind."""
    return ranking.bm25(tables.work_items(spark, folder), "item_id", "title", TERMS, 60, F.col("role") == "user")


@query("WITH " + _bm25_sql(_PAGES, limit=50) + " SELECT id AS page_id, score, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), url) AS title FROM t JOIN pages ON page_id = id")
def bm25_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.pages(spark, folder).withColumn("text", F.regexp_replace("html", "<[^>]*>", " "))
    hits = ranking.bm25(p, "page_id", "text", TERMS, 50)
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)), F.lit("")), F.col("url"))
    return hits.join(p.select("page_id", title.alias("title")), "page_id")


@query("""
    WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: length(t) <= 40) AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term FROM x), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL)
    SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses, max(tf) AS most FROM tf GROUP BY term""")
def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted index, summed by term."""
    index, _ = ranking.postings(tables.entries(spark, folder), "entry_id", "content")
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"), F.max("tf").alias("most"))


_FUSED = f"""
    {_NEAR}, {_bm25_sql(_ENTRIES)},
    vr AS (SELECT chunk_id, entry_id, row_number() OVER (ORDER BY distance, chunk_id) - 1 AS r FROM (SELECT * FROM d ORDER BY distance, chunk_id LIMIT 150)),
    tr AS (SELECT id AS entry_id, row_number() OVER (ORDER BY score DESC, id) - 1 AS q FROM t),
    f AS (SELECT chunk_id, entry_id, round(1 / (60 + r) + coalesce(1 / (60 + q), 0), 9) AS score FROM vr LEFT JOIN tr USING (entry_id))"""


@query(f"""WITH {_FUSED},
    g AS (SELECT * FROM f UNION ALL
          SELECT chunk_id, c.entry_id, round(1 / (60 + q), 9) FROM tr JOIN c ON c.entry_id = tr.entry_id AND chunk_index = 0 WHERE tr.entry_id NOT IN (SELECT entry_id FROM vr))
    SELECT chunk_id, entry_id, score FROM g ORDER BY score DESC, chunk_id LIMIT 20""")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Vector and text hits fused; entries that only the text side found are given by their first chunk."""
    first = tables.chunks(spark, folder).filter("chunk_index = 0").select("entry_id", "chunk_id")
    return ranking.fuse(_near(spark, folder, 150), _index(spark, folder).search(TERMS, 150), 20, first)


@query(f"WITH {_FUSED} SELECT chunk_id, entry_id, score FROM f ORDER BY score DESC, chunk_id LIMIT 20")
def hybrid_vector_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion in which text hits only lift chunks that the vector side found."""
    return ranking.fuse(_near(spark, folder, 150), _index(spark, folder).search(TERMS, 150), 20)


@query(f"WITH {_FUSED} SELECT chunk_id, entry_id, score FROM f ORDER BY score DESC, chunk_id LIMIT 10 OFFSET 10")
def hybrid_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of hybrid results."""
    fused = ranking.fuse(_near(spark, folder, 150), _index(spark, folder).search(TERMS, 150), 150)
    return ranking.page(fused, [F.desc("score"), F.col("chunk_id")], 10, 10)


def _score_sql(title: str, body: str) -> str:
    q = "the of"
    words = q.split()
    share = lambda x: "(" + " + ".join(f"list_contains(regexp_split_to_array({x}, '\\s+'), '{w}')::INT" for w in words) + f") / {float(len(words))}"
    return f"""round(least(
        CASE WHEN lower({title}) = '{q}' THEN 1.0 WHEN contains(lower({title}), '{q}') THEN 0.5 + {float(len(q))} / strlen(lower({title})) * 0.3 ELSE 0 END
        + {share(f'lower({title})')} * 0.3 + CASE WHEN contains(lower({body}), '{q}') THEN 0.2 ELSE 0 END + {share(f'lower({body})')} * 0.1, 1.0), 6)"""


@query(f"""
    WITH e AS (SELECT doc_id AS entry_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body FROM documents),
    s AS (SELECT entry_id, {_score_sql('title', 'body')}::DOUBLE AS score FROM e)
    SELECT entry_id, score FROM s WHERE score > 0 ORDER BY score DESC, entry_id LIMIT 100""")
def text_score_search(spark: SparkSession, folder: str) -> DataFrame:
    score = ranking.text_score("the of", F.col("title"), F.col("content"))
    rows = tables.entries(spark, folder).select("entry_id", score.alias("score")).filter("score > 0")
    return rows.orderBy(F.desc("score"), "entry_id").limit(100)


_KINDS = f"""
    e AS (SELECT doc_id AS id, {_score_sql("split_part(coalesce(text, ''), chr(10), 1)", "coalesce(text, '')")}::DOUBLE AS score FROM documents),
    p AS (SELECT page_id AS id, {_score_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)", "html")}::DOUBLE AS score FROM pages),
    b AS (SELECT id, score, 'entry' AS kind FROM e UNION ALL SELECT id, score, 'page' FROM p)"""


@query(f"WITH {_KINDS} SELECT id, score, kind FROM b ORDER BY score DESC, kind, id LIMIT 50")
def merged_results(spark: SparkSession, folder: str) -> DataFrame:
    """The best of entries and pages in one list, each marked with where it is from."""
    e = tables.entries(spark, folder).select(F.col("entry_id").alias("id"), ranking.text_score("the of", F.col("title"), F.col("content")).alias("score"))
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    p = tables.pages(spark, folder).select(F.col("page_id").alias("id"), ranking.text_score("the of", title, F.col("html")).alias("score"))
    return ranking.merge_scored({"entry": e, "page": p}, 50)


@query("""
    WITH i AS (SELECT conv_id || '/' || turn AS id, CASE WHEN contains(lower(role), 'user') THEN 1.0 WHEN contains(lower(text), 'the') THEN 0.7 END AS s, conv_id, turn FROM conversations),
    k AS (SELECT id, s::DOUBLE AS score, 'item' AS kind FROM i WHERE s IS NOT NULL ORDER BY conv_id DESC, turn DESC LIMIT 40),
    l AS (SELECT l_orderkey || '/' || l_linenumber AS id, coalesce(l_discount, 0.5) AS score, 'link' AS kind FROM lineitem ORDER BY l_discount DESC, l_orderkey, l_linenumber LIMIT 40)
    SELECT * FROM k UNION ALL SELECT * FROM l""")
def project_search(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose head (1.0) or text (0.7) matches, of the newest; and the most relevant links."""
    items = tables.work_items(spark, folder)
    s = F.when(F.contains(F.lower("role"), F.lit("user")), 1.0).when(F.contains(F.lower("title"), F.lit("the")), 0.7)
    found = items.withColumn("score", s).filter("score is not null").orderBy(F.desc("project_id"), F.desc("position")).limit(40)
    links = tables.project_links(spark, folder).orderBy(F.desc("relevance"), "project_id", "line").limit(40)
    links = links.select(F.concat_ws("/", "project_id", "line").alias("id"), F.coalesce("relevance", F.lit(0.5)).alias("score"), F.lit("link").alias("kind"))
    return found.select(F.col("item_id").alias("id"), "score", F.lit("item").alias("kind")).unionByName(links)


@query("""
    WITH e AS (SELECT doc_id AS entry_id, text, strpos(lower(text), 'that') AS p FROM documents WHERE text IS NOT NULL)
    SELECT entry_id, CASE WHEN p > 0 THEN
            (CASE WHEN p > 51 THEN '...' ELSE '' END) || substr(text, greatest(p - 50, 1), least(p + 54, length(text) + 1) - greatest(p - 50, 1)) || (CASE WHEN p + 54 <= length(text) THEN '...' ELSE '' END)
        WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS excerpt
    FROM e""")
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").alias("entry_id"), ranking.excerpt(F.col("text"), "that").alias("excerpt"))


@query("""
    WITH x AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: length(t) <= 40), ' ') || ' ' AS w FROM documents)
    SELECT doc_id AS entry_id FROM x WHERE contains(w, ' of the ')""")
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.phrase(tables.entries(spark, folder), "entry_id", "content", ["of", "the"])


def _phrase_sql(words: str) -> str:
    return f"""
    WITH x AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) <= 40), ' ') || ' ' AS w FROM documents)
    SELECT doc_id AS entry_id FROM x WHERE contains(w, ' {words} ')"""


@query(ORACLE_SQL["index_terms"])
def stored_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index by term; as the first query of the index it builds it."""
    index = _index(spark, folder)
    rows = index.of(index.layers(), "postings").select("term", "n", "most", F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("uses"))
    return rows.groupBy("term").agg(F.sum("n").alias("docs"), F.sum("uses").alias("uses"), F.max("most").alias("most"))


@query(ORACLE_SQL["bm25_entries"])
def bm25_stored(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search(TERMS, 150)


@query("WITH " + _bm25_sql(_ENTRIES, "lang = 'en' AND list_contains(words, 'that') AND NOT list_contains(words, 'with')") + " SELECT id AS entry_id, score FROM t")
def bm25_stored_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """A filter by type, a word that must occur and one that must not."""
    return _index(spark, folder).search(TERMS, 150, F.col("entry_type") == "en", must=["that"], never=["with"])


@query(ORACLE_SQL["phrase_search"])
def phrase_stored(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).phrase(["of", "the"])


@query(_phrase_sql("of and of"))
def phrase_stored_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """A phrase of several words, one of them twice."""
    return _index(spark, folder).phrase("of and of".split())


def _changed(spark: SparkSession, rows: DataFrame, text: str) -> postings.Index:
    """An index of rows (key, text, ...) after two changes: every third key with the text of its first 200 characters, every seventh gone."""
    key = rows.columns[0]
    index = postings.Index(spark, f"{shared_dir(spark)}/changed-{uuid.uuid4().hex}", key)
    index.build(rows, text)
    third, seventh = (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)) == 0 for n in (3, 7))
    short = rows.filter(third).withColumn(text, F.substring(text, 1, 200))
    index.change(short.select(rows.columns), text, rows.select(key).limit(0))
    index.delete(rows.filter(seventh).select(key))
    return index


def _changed_sql(rows: str, key: str, where: str = "true", limit: int = 150) -> str:
    """BM25 over rows (id, text, ...) after the changes of _changed; crc32 of the key as text, bit by bit."""
    codes = f"list_transform(string_split({key}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"
    changed = f"SELECT * REPLACE (CASE WHEN crc % 3 = 0 THEN substr(text, 1, 200) ELSE text END AS text) FROM (SELECT *, {crc} AS crc FROM ({rows})) WHERE crc % 7 <> 0"
    return _bm25_sql(changed, where, limit)


@query("WITH " + _changed_sql(_ENTRIES, "id", "lang = 'en'") + " SELECT id AS entry_id, score FROM t")
def entry_index_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Search after entries were replaced and deleted in the index."""
    rows = tables.entries(spark, folder).select("entry_id", "content", "entry_type")
    return _changed(spark, rows, "content").search(TERMS, 150, F.col("entry_type") == "en")


@query("WITH " + _changed_sql(_PAGES, "id", limit=50) + " SELECT id AS page_id, score FROM t")
def page_index_changed(spark: SparkSession, folder: str) -> DataFrame:
    """The same over pages."""
    rows = tables.pages(spark, folder).select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return _changed(spark, rows, "text").search(TERMS, 50)


@query("WITH " + _changed_sql(_ITEMS, "id", "role = 'user'", 60) + " SELECT id AS item_id, score FROM t")
def item_index_changed(spark: SparkSession, folder: str) -> DataFrame:
    """The same over work items, whose keys are text, of one kind."""
    rows = tables.work_items(spark, folder).select("item_id", "title", "role")
    return _changed(spark, rows, "title").search(TERMS, 60, F.col("role") == "user")
