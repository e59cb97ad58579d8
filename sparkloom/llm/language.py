"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from character n-gram counts of all documents whose language is known, in all languages there are.
For each page Spark combines them with
- the language its markup declares (the whole tag), the suffix of its address (its host's last label, whatever its script)
  and the language-like first segment of its path, each by the share of pages of a language that have that value, and
- a prior of its host, smoothed by the prior of its site (the last two labels of the host), which is smoothed by the
  languages of all pages.
Shares and priors are sums of text posteriors over groups of pages, so they need no labels; a page's own posterior is
taken out of its host's and its site's sums. Groups may have any number of values and of pages: sums are combined before
the shuffle, and the pages of a hot host or value are joined where they are (`shared.spread_join`).

Bounds: 128 KB for each language in the driver and in a worker.

Defined results: null or empty markup gives a text without n-grams, whose likelihoods are equal; a null or broken
address gives the empty host, suffix and segment; markup without a language counts as declaring the empty one; markup is
read in one pass (see visible_text), whatever its length and however broken; without any document of known language the
result's language is null. Repeated pages and null ids each get their result; columns other than those named are unused.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import characters, hashed
from .shared import small_batches, spread_join, stored

ORDERS, BITS = (1, 2, 3), 14
#: Elements whose content is no text.
HIDDEN = ("script", "style", "noscript", "template")
_OPEN = re.compile(r"[A-Za-z!/?]")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_CLOSE = {name: re.compile(f"</{name}", re.IGNORECASE) for name in HIDDEN}
_HTML = re.compile(r"<html(?=[\s/>])", re.IGNORECASE)
_LANG = re.compile(r"(?:^|[\s/\"'])(?:xml:)?lang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)


def visible_text(markup: str) -> str:
    """The text of markup, without scripts, styles, comments and tags; every character is looked at once or twice.

    A tag begins with < and a letter, a slash, ! or ?; other < are text. What is opened and never closed hides the rest.
    """
    out, at = [], 0
    while True:
        lt = markup.find("<", at)
        if lt < 0:
            out.append(markup[at:])
            break
        if not _OPEN.match(markup, lt + 1):
            out.append(markup[at : lt + 1])
            at = lt + 1
            continue
        out.append(markup[at:lt])
        out.append(" ")
        if markup.startswith("<!--", lt):
            end = markup.find("-->", lt + 4)
            at = end + 3
        else:
            end = markup.find(">", lt)
            at = end + 1
            name = _NAME.match(markup, lt + 1)
            close = _CLOSE.get(name.group().lower()) if name and end >= 0 else None
            if close and markup[end - 1] != "/":
                found = close.search(markup, at)
                end = at = markup.find(">", found.end()) if found else -1
                at += 1
        if end < 0:
            break
    return html.unescape("".join(out))


def declared_language(markup: str) -> str:
    """The language tag of the first html element, in lower case; empty if there is none."""
    start = _HTML.search(markup)
    if not start:
        return ""
    end = markup.find(">", start.end())
    found = _LANG.search(markup[start.end() : end if end >= 0 else len(markup)])
    return found.group(1).lower() if found else ""


def count_ngrams(docs: DataFrame, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """All languages, in order of name, and the counts of each n-gram bucket in each: 128 KB a language."""
    known = docs.filter(F.col(lang_col).isNotNull())
    langs = sorted(r["lang"] for r in known.select(F.col(lang_col).alias("lang")).distinct().collect())
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << BITS, np.int64)
                counts[lang] += np.bincount(hashed(characters(text or ""), ORDERS, BITS), minlength=1 << BITS)
        for lang, held in counts.items():
            bucket = np.flatnonzero(held)
            row = np.full(len(bucket), place[lang], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(bucket.astype(np.int32)), pa.array(held[bucket])], ["row", "bucket", "n"])

    parts = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "row int, bucket int, n long")
    total = parts.groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets rows at most
    table = np.zeros((len(langs), 1 << BITS))
    table[total["row"].to_numpy(int), total["bucket"].to_numpy(int)] = total["n"].to_numpy(float)
    return langs, table


def _vector(sums: str, n: int) -> Column:
    return F.array(*(F.sum(F.element_at(sums, i + 1)) for i in range(n)))


def identify(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text",
    temper: float = 0.05, trust: float = 8.0,
) -> DataFrame:
    """One row for each row of pages: page_id, lang, score, text_lang, declared, host, n_ngrams.

    temper: weight of an n-gram, as neighbouring n-grams aren't independent; trust: pages that a smoothed prior counts as.
    """
    small_batches(pages.sparkSession)
    langs, counts = count_ngrams(docs, lang_col, text_col)
    n = len(langs)
    empty = F.lit(None).cast("string")
    if not n:
        return pages.select(F.col(id_col).alias("page_id"), empty.alias("lang"), F.lit(None).cast("double").alias("score"), empty.alias("text_lang"), empty.alias("declared"), empty.alias("host"), F.lit(0).cast("long").alias("n_ngrams"))
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1]))
    logs = np.ascontiguousarray((logs - logs.mean(0)).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes, tags = [], [], []
            for markup in batch.column(1).to_pylist():
                found = hashed(characters(visible_text(markup or "")), ORDERS, BITS)
                sizes.append(len(found))
                tags.append(declared_language(markup or ""))
                sums.append((np.bincount(found, minlength=1 << BITS) @ logs).tolist())
            arrays = [batch.column(0), pa.array(sums, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(tags, pa.string()), *(batch.column(i) for i in range(2, 5))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "likelihood", "n_ngrams", "declared", "host", "segment", "row"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(html_col).alias("html"),
        host.alias("host"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})*)(?:[/?#]|$)", 1)).alias("segment"),
        F.monotonically_increasing_id().alias("row"),
    )
    seen = rows.mapInArrow(run, "page_id long, likelihood array<double>, n_ngrams long, declared string, host string, segment string, row long")
    seen = seen.withColumn("suffix", F.regexp_extract("host", r"\.([^.]*[^.0-9][^.]*)\.?$", 1)).withColumn("site", F.substring_index("host", ".", -2))
    weighed = F.transform("likelihood", lambda x: x * temper)
    seen = seen.withColumn("likelihood", weighed).withColumn("peak", F.array_max("likelihood"))
    raised = F.transform("likelihood", lambda x: F.exp(x - F.col("peak")))
    seen = seen.withColumn("raised", raised).withColumn("total", F.aggregate("raised", F.lit(0.0), lambda a, x: a + x))
    seen = stored(seen.withColumn("posterior", F.transform("raised", lambda x: x / F.col("total"))).drop("raised", "total", "peak"), "pages")

    everywhere = seen.agg(_vector("posterior", n).alias("all"), F.count("*").alias("pages")).first()
    whole = [(x or 0.0) + 0.5 for x in (everywhere["all"] or [0.0] * n)]
    base = F.array(*(F.lit(x / sum(whole)) for x in whole))
    out = seen
    # Evidence: share of a language's pages with this value, smoothed by the share of all pages with it.
    for name in ("declared", "suffix", "segment"):
        groups = seen.groupBy(name).agg(_vector("posterior", n).alias("held"), F.count("*").alias("size"))
        share = F.col("size") / F.lit(max(1, everywhere["pages"]))
        evidence = F.transform(F.arrays_zip("held", F.array(*map(F.lit, whole)).alias("of")), lambda x: F.log((x["held"] + share) / (x["of"] + 1)))
        out = spread_join(out, groups.select(name, "size", evidence.alias(f"by_{name}")), [name], "size", everywhere["pages"], ["row"]).drop("size")
    # Priors: site smoothed by all pages, host smoothed by site, without the page itself.
    for name in ("site", "host"):
        groups = seen.groupBy(name).agg(_vector("posterior", n).alias(f"of_{name}"), F.count("*").alias("size"))
        out = spread_join(out, groups, [name], "size", everywhere["pages"], ["row"]).drop("size")
    lessen = lambda a: F.zip_with(a, "posterior", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("of_site", lessen(F.col("of_site"))).withColumn("site_n", total("of_site"))
    out = out.withColumn("site_prior", F.zip_with("of_site", base, lambda x, b: (x + F.lit(trust) * b) / (F.col("site_n") + trust)))
    out = out.withColumn("of_host", lessen(F.col("of_host"))).withColumn("host_n", total("of_host"))
    out = out.withColumn("host_prior", F.zip_with("of_host", "site_prior", lambda x, b: (x + F.lit(trust) * b) / (F.col("host_n") + trust)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(F.col("likelihood"), F.transform("host_prior", lambda x: F.log(x)))
    for name in ("declared", "suffix", "segment"):
        fused = add(fused, F.col(f"by_{name}"))
    out = out.withColumn("fused", fused).withColumn("peak", F.array_max("fused"))
    named = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(named, F.array_position(a, F.array_max(a)).cast("int"))
    sure = F.lit(1.0) / F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("peak"))), F.lit(0.0), lambda s, x: s + x)
    return out.select("page_id", best(F.col("fused")).alias("lang"), sure.alias("score"), best(F.col("likelihood")).alias("text_lang"), "declared", "host", "n_ngrams")
