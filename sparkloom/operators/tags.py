"""Tags of entries: phrases between stop words (RAKE), words that stand out among sentences (TF-IDF), and their merger."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small_batches

#: Stop words of four languages, own list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "als", "auf", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "como", "con", "de", "del", "el", "en", "la", "las", "lo", "los", "para", "por", "que", "se", "un", "una",
    "au", "aux", "avec", "ce", "dans", "du", "est", "et", "le", "les", "ou", "par", "pas", "pour", "qui", "sur", "une",
)


_STOPS = frozenset(STOP_WORDS)


def _phrase_marks(text: Column) -> Column:
    """Lower-case words, with a bar where other signs stand between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s'-]+", " | ")


def _sentence_marks(text: Column) -> Column:
    """Lower-case words and the signs that end sentences."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.!?]+", " ")


def _of_key(docs: DataFrame, key: str, parts: Column) -> DataFrame:
    """key and the parts of its rows as an array; this needs a shuffle only for keys that several rows have."""
    small_batches(docs.sparkSession)
    rows = docs.select(key, parts.alias("parts"))
    repeated = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    one = rows.select(key, F.array("parts").alias("parts"))
    if repeated.isEmpty():
        return one
    same = F.col(key).eqNullSafe(F.col("_key"))
    several = rows.join(repeated, same, "left_semi").groupBy(key).agg(F.collect_list("parts").alias("parts"))
    return one.join(repeated, same, "left_anti").unionByName(several)


def phrases(marked: str, most_words: int) -> Iterator[str]:
    """Runs of words between stop words and bars, of most_words at most."""
    run: list[str] = []
    for w in [*marked.split(), "|"]:
        if w != "|" and w not in _STOPS:
            run.append(w)
        elif run:
            if len(run) <= most_words:
                yield " ".join(run)
            run = []


def near_best(rows: list[tuple], most: int, score: Callable[[tuple], float]) -> list[tuple]:
    """The rows that can be among the `most` best, all that may tie at six digits included."""
    if len(rows) <= most:
        return rows
    scores = [score(r) for r in rows]
    least = heapq.nlargest(most, scores)[-1] - 1e-5
    return [r for r, x in zip(rows, scores, strict=True) if x >= least]


def phrase_weights(texts: Sequence[str | None], most_words: int) -> list[tuple[str, float]]:
    """Each phrase of the texts with the sum of degree over frequency of its words."""
    uses = Counter(p for t in texts for p in phrases(t or "", most_words))
    words = {p: p.split(" ") for p in uses}
    degree, frequency = Counter(), Counter()
    for p, n in uses.items():
        for w in words[p]:
            degree[w] += n * len(words[p])
            frequency[w] += n
    return [(p, math.fsum(degree[w] / frequency[w] for w in of)) for p, of in words.items()]


def word_counts(texts: Sequence[str | None]) -> list[tuple[str, int, int, int]]:
    """Each word with its uses, the number of sentences that have it, and the number of all; by texts of as many sentences."""
    uses, places = Counter(), defaultdict(set)
    for text in texts:
        cut = [s.split() for s in re.split("[.!?]+", text or "") if any(map(str.isalpha, s))]
        for i, words in enumerate(cut):
            for w in words:
                if w not in _STOPS:
                    uses[w, len(cut)] += 1
                    places[w, len(cut)].add(i)
    return [(w, n, len(places[w, of]), of) for (w, of), n in uses.items()]


def _by_row(rows: DataFrame, key: str, count: Callable[[list], list[tuple]], kind: str) -> DataFrame:
    """key and `found`, what count makes of a row's parts."""

    names, kinds = zip(*(f.split(" ") for f in kind.split(", ")), strict=True)
    of = pa.list_(pa.struct(list(zip(names, ({"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[k] for k in kinds), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in count(parts.as_py())] for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, of)], [key, "found"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, found array<struct<{kind.replace(' ', ': ').replace(',:', ',')}>>")


def rake(docs: DataFrame, key: str, text: str, most: int = 20, most_words: int = 4, least: float = 1.0) -> DataFrame:
    """key, tag, score, rank: phrases by the sum of degree over frequency of their words. All is counted and ranked in a text's own row."""
    rows = _by_row(_of_key(docs, key, _phrase_marks(F.col(text))), key, lambda texts: near_best(phrase_weights(texts, most_words), most, lambda r: r[1]), "tag string, score double")
    scored = F.transform("found", lambda x: F.struct(x["tag"].alias("tag"), F.round(x["score"], 6).alias("score")))
    return _ranked(rows, key, F.filter(scored, lambda x: x["score"] >= least), most)


def tfidf(docs: DataFrame, key: str, text: str, most: int = 5, least_bytes: int = 3) -> DataFrame:
    """key, tag, score, rank: words by frequency times the log of sentences over sentences with the word, in a text's own row."""
    rows = _of_key(docs, key, _sentence_marks(F.col(text)))
    found = lambda texts: near_best([r for r in word_counts(texts) if len(r[0].encode()) >= least_bytes], most, lambda r: r[1] * math.log((1 + r[3]) / (1 + r[2])))
    rows = _by_row(rows, key, found, "tag string, tf bigint, df bigint, sentences bigint")
    scored = F.transform("found", lambda x: F.struct(x["tag"].alias("tag"), F.round(x["tf"] * F.log((1 + x["sentences"]) / (1 + x["df"])), 6).alias("score")))
    return _ranked(rows, key, scored, most).withColumn("score", F.round((most + 1 - F.col("rank")) / F.lit(float(most)), 6))


def _ranked(rows: DataFrame, key: str, scored: Column, most: int) -> DataFrame:
    """The best of an array (tag, score) of each row: sorted by score downwards, then tag."""
    best = F.slice(F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("less"), x["tag"].alias("tag"), x["score"].alias("score")))), 1, most)
    out = rows.select(key, F.posexplode(best).alias("rank", "t"))
    return out.select(key, "t.tag", "t.score", (F.col("rank") + 1).alias("rank"))


def _best(scored: DataFrame, key: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "tag"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def merged(key: str, lists: Sequence[DataFrame], own: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The best tags of several lists (key, tag, score), one a text whatever its case; own tags (key, tag) come first."""
    rows = own.select(key, "tag", F.lit(1000.0).alias("score")) if own is not None else None
    for part in lists:
        rows = part.select(key, "tag", "score") if rows is None else rows.unionByName(part.select(key, "tag", "score"))
    best = rows.groupBy(key, F.lower("tag").alias("tag")).agg(F.max("score").alias("score"))
    return _best(best, key, most)
