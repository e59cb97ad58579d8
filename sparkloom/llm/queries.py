"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, exact_dedup, language, lm, merkle, mixing, near_dedup, neighbours, packing, sharding, token_counts, toxicity, tries


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> str:
    """The byte-level tokenizer that packing uses."""
    return tokenizer("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), byte_level())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), _documents(spark, sf_dir))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_lm_scores": op11_lm_scores,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII text: the polynomial bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
            FROM d GROUP BY source),
        o AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS v
            FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, (3 * source_size)::DOUBLE * v <= w::DOUBLE * l AS is_full FROM o),
        x AS (SELECT l, v FROM f WHERE NOT is_full ORDER BY source_size / w, l DESC, v DESC LIMIT 1),
        t AS (
            SELECT source, source_size,
                   CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE (w * (SELECT l FROM x))::DOUBLE / (SELECT v FROM x) END AS target
            FROM f),
        p AS (
            SELECT doc_id, size, source_size, target,
                   CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken
        FROM p""",
    "op4_near_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT r, doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
            FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, any_value(a.doc_id) AS u, any_value(b.doc_id) AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
        l AS (SELECT DISTINCT u, v FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        g AS (SELECT DISTINCT doc_id, doc_id AS c FROM t UNION SELECT g.doc_id, e.v FROM g JOIN e ON e.u = g.c),
        m AS (SELECT doc_id, min(c) AS component_id FROM g GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
        FROM t JOIN m USING (doc_id) LEFT JOIN n USING (r)""",
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS i, digest, chars
            FROM (
                SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars,
                       sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
                FROM conversations WHERE conv_id IS NOT NULL)),
        v AS (SELECT c, {_crc32("c::VARCHAR")} % 6 AS h, c - c % 100 AS b, own FROM (SELECT c, max(i) AS own FROM t GROUP BY c)),
        e AS (
            SELECT v.c, t.i AS d, digest, chars FROM v JOIN t ON t.c = v.b AND t.i <= v.h
            UNION ALL
            SELECT v.c, least(v.h, coalesce(base.own, 0)) + t.i - v.h, digest, chars
            FROM t JOIN v ON t.c = v.c AND t.i > v.h LEFT JOIN v AS base ON base.c = v.b
            UNION ALL SELECT c, 0, '', 0 FROM v),
        p AS (
            SELECT c, d, chars, max(d) OVER (PARTITION BY c) AS l,
                   sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k
            FROM e),
        n AS (
            SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = l), '')) AS ends_sha256
            FROM p GROUP BY d, k),
        a AS (SELECT n.*, y.k AS above FROM n LEFT JOIN p AS y ON y.c = n.conv_id AND y.d = n.d - 1),
        f AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM a WHERE d > 0 GROUP BY ALL),
        g AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN f ON f.d = a.d AND f.k = a.k),
        s AS (
            SELECT y.d, y.k, sum((g.n_convs - 1) * g.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves
            FROM g JOIN p AS y ON y.c = g.conv_id AND y.d <= g.d GROUP BY y.d, y.k)
        SELECT g.conv_id, g.d AS depth, up.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens, g.ends_sha256
        FROM g JOIN s ON s.d = g.d AND s.k = g.k LEFT JOIN n AS up ON up.d = g.d - 1 AND up.k = g.above""",
    "op13_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS start
            FROM (SELECT *, {_leaf("text")} AS leaf FROM documents)),
        n AS (
            SELECT lang, 0 AS level, place, leaf AS h FROM d
            UNION ALL
            SELECT lang, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS nodes FROM n) WHERE nodes > 1 GROUP BY lang, level, place // 8),
        s AS (SELECT lang, arg_max(h, level) AS subroot, max(level) AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM n GROUP BY lang),
        u AS (
            SELECT 0 AS level, tree AS place, subroot AS h FROM s
            UNION ALL
            SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER () AS nodes FROM u) WHERE nodes > 1 GROUP BY level, place // 8),
        x AS (
            SELECT tree, level, place, h FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang WHERE level < levels
            UNION ALL SELECT -1, level, place, h FROM u WHERE level < (SELECT max(level) FROM u)),
        y AS (
            SELECT tree, level, place,
                   coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM x WINDOW w AS (PARTITION BY tree, level, place // 8 ORDER BY place)),
        f AS (
            SELECT doc_id, leaf, s.tree, s.tree AS own, s.subroot, 0 AS level, place, start AS h, '' AS proof
            FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang
            UNION ALL
            SELECT doc_id, leaf,
                   CASE WHEN y.tree IS NULL THEN -1 ELSE f.tree END, own, subroot,
                   CASE WHEN y.tree IS NULL THEN 0 ELSE f.level + 1 END,
                   CASE WHEN y.tree IS NULL THEN own ELSE f.place // 8 END,
                   CASE WHEN y.tree IS NULL THEN h ELSE sha256(l || h || r) END, proof || coalesce(l || r, '')
            FROM f LEFT JOIN y ON y.tree = f.tree AND y.level = f.level AND y.place = f.place
            WHERE f.tree >= 0 OR y.tree IS NOT NULL),
        z AS (SELECT h AS root FROM u ORDER BY level DESC LIMIT 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM f, z WHERE tree = -1 AND level = (SELECT max(level) FROM u)""",
}
