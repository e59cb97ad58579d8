"""Text ranking (BM25), rank fusion, and scores of title and body matches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small_batches

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
FUSION = 60


def tokens(text: Column, longest: int = 40) -> Column:
    """Lower-case runs of letters and digits, none longer than `longest`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) <= longest)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, term, tf) for each distinct word of a row (key, words)."""
    for batch in batches:
        key, words = batch.column(0), batch.column(1)
        flat = words.flatten().dictionary_encode()
        terms = max(1, len(flat.dictionary))
        use, tf = np.unique(pc.list_parent_indices(words).to_numpy().astype(np.int64) * terms + flat.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(use, terms)
        yield pa.RecordBatch.from_arrays([key.take(pa.array(row)), flat.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64))], [batch.schema.names[0], "term", "tf"])


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The inverted index of a text column: (key, term, tf) and (key, len).

    A row's words are counted where it lies; only the counts of keys that several rows have are summed by a shuffle.
    """
    small_batches(docs.sparkSession)
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    kind = docs.schema[key].dataType.simpleString()
    counted = lambda rows: rows.mapInArrow(count_words, f"`{key}` {kind}, term string, tf long")
    stats = words.select(key, F.size("words").alias("len"))
    repeated = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    if repeated.isEmpty():
        return counted(words), stats
    same = F.col(key).eqNullSafe(F.col("_key"))
    several = counted(words.join(repeated, same, "left_semi")).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counted(words.join(repeated, same, "left_anti")).unionByName(several), stats


def _uses(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], limit: int, where: Column | None = None, must: Sequence[str] = (), never: Sequence[str] = ()) -> DataFrame:
    """The `limit` best rows for terms joined by OR: key, score. Statistics are those of all rows; `where` filters hits.

    A row keeps its length and its uses of the asked terms; one aggregate gives the statistics as a single row, and each
    row is scored where it lies. Nothing but that row and the best rows of each task leaves a task.
    """
    asked = sorted({t.lower() for t in terms})
    passes = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    held = docs.select(key, passes.alias("_passes"), tokens(F.col(text)).alias("_words"))
    has = lambda w: F.array_contains("_words", w.lower())
    for word in must:
        held = held.withColumn("_passes", F.col("_passes") & has(word))
    for word in never:
        held = held.withColumn("_passes", F.col("_passes") & ~has(word))
    held = held.select(key, "_passes", F.size("_words").alias("_len"), F.filter("_words", lambda w: w.isin(*asked)).alias("_found"))
    using = [F.count_if(F.array_contains("_found", t)).alias(f"_df{i}") for i, t in enumerate(asked)]
    whole = held.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *using)  # one row
    score = F.lit(0.0)
    for i, t in enumerate(asked):
        tf = _uses("_found", t)
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    # The score needs the statistics, so this filter stays above the join and no text is cut into words twice for it.
    rows = held.filter("_passes").crossJoin(F.broadcast(whole)).select(key, score.alias("score")).filter("score > 0")
    return rows.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(limit)


def phrase(docs: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """Rows in which the words follow each other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    return docs.filter(F.contains(joined, F.lit(" " + " ".join(w.lower() for w in words) + " "))).select(key)


def ranked(hits: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Zero-based ranks of a bounded hit list."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, limit: int, first_chunks: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of chunk hits (chunk_id, entry_id, distance) and entry hits (entry_id, score).

    A text hit lifts every chunk of its entry that the vector side found. With first_chunks (entry_id, chunk_id), text
    hits without any such chunk are given by their first chunk; without it they are dropped.
    """
    v = ranked(vector_hits.select("chunk_id", "entry_id", "distance"), [F.col("distance"), F.col("chunk_id")], "v_rank")
    t = ranked(text_hits.select("entry_id", "score"), [F.desc("score"), F.col("entry_id")], "t_rank").select("entry_id", "t_rank")
    part = lambda rank: F.coalesce(1.0 / (FUSION + F.col(rank)), F.lit(0.0))
    both = v.join(t, "entry_id", "left").select("chunk_id", "entry_id", (part("v_rank") + part("t_rank")).alias("score"))
    if first_chunks is not None:
        alone = t.join(v, "entry_id", "left_anti").join(first_chunks, "entry_id")
        both = both.unionByName(alone.select("chunk_id", "entry_id", part("t_rank").alias("score")))
    return both.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "chunk_id").limit(limit)


def page(rows: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None, most: int = 100) -> DataFrame:
    """A window of ordered rows; limit is 10 if not given and `most` at most."""
    size = min(10 if limit is None else max(0, limit), most)
    return rows.orderBy(*order).offset(max(0, offset or 0)).limit(size)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def text_score(query: str, title: Column, body: Column) -> Column:
    """0 to 1: whole and partial title matches, title words, body matches, body words. Lengths are in bytes."""
    q = query.lower()
    words = q.split()
    low, text = F.lower(F.coalesce(title, F.lit(""))), F.lower(body)
    share = lambda has: sum((F.when(F.array_contains(has, w), 1).otherwise(0) for w in words), F.lit(0)) / F.lit(float(max(1, len(words))))
    partial = 0.5 + F.lit(float(len(q.encode()))) / F.octet_length(low) * 0.3
    score = F.when(low == q, 1.0).when(F.contains(low, F.lit(q)), partial).otherwise(0.0) + share(_split(low)) * 0.3
    in_body = F.when(F.contains(text, F.lit(q)), 0.2).otherwise(0.0) + share(_split(text)) * 0.1
    return F.round(F.least(score + F.coalesce(in_body, F.lit(0.0)), F.lit(1.0)), 6)


def excerpt(text: Column, query: str, around: int = 50) -> Column:
    """The first match with `around` characters on both sides, dots where text is left out; the beginning if none."""
    at = F.locate(query.lower(), F.lower(text))
    start, stop = F.greatest(at - around, F.lit(1)), F.least(at + len(query) + around, F.length(text) + 1)
    found = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, stop - start), F.when(stop <= F.length(text), "...").otherwise(""))
    head = F.when(F.length(text) > 2 * around, F.concat(F.substring(text, 1, 2 * around), F.lit("..."))).otherwise(text)
    return F.when(at > 0, found).otherwise(head)


def merge_scored(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """The best rows of several lists (id, score), each marked with its list's name."""
    out = None
    for kind, rows in lists.items():
        part = rows.select("id", "score", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)
