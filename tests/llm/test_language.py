import math
import time
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm.language import BITS, ORDERS, declared_language, identify, visible_text
from sparkloom.llm.ngrams import characters, hashed

TEXT = {
    "en": "the house is on the hill and the river runs to the sea with the wind",
    "de": "das haus steht auf dem hügel und der fluss läuft mit dem wind zum meer",
    "fr": "la maison est sur la colline et la rivière coule vers la mer avec le vent",
}


def page(lang, declared=None, url=None, text=None):
    mark = f' lang="{declared}"' if declared else ""
    return (url, f"<html{mark}><script>var x = 'das der die';</script><p>{TEXT[lang] if text is None else text}</p></html>")


def make(spark, documents, pages):
    docs = documents(*[(i, TEXT[k], k, "s", 1) for i, k in enumerate(list(TEXT) * 10)], (99, None, "en", None, 0), (98, "x", None, None, 0), extra=True)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string"), docs


def test_text_evidence_and_fusion(spark, documents):
    pages = [page(k, k, f"https://{k}.example.org/{k}/{i}") for i in range(12) for k in TEXT]
    n = len(pages)
    pages += [page("en", "de", "https://en.example.org/x", ""), page("fr", None, None), (None, None), ("nonsense", "<p>" + "wort " * 20_000)]
    p, docs = make(spark, documents, pages)
    found = {r.page_id: r for r in identify(p, docs).collect()}
    assert len(found) == len(pages)
    assert [found[i].lang for i in range(n)] == list(TEXT) * 12
    assert found[n].declared == "de" and found[n].n_ngrams < 5  # no text: markup and host decide
    assert found[n + 1].lang == "fr" and found[n + 1].host == ""
    assert all(0 < r.score <= 1 for r in found.values())


def test_host_decides_for_a_page_without_text(spark, documents):
    pages = [page("fr", None, f"https://maison.example.net/{i}") for i in range(30)] + [page("en", None, f"https://home.example.net/{i}") for i in range(30)]
    pages.append(page("en", None, "https://maison.example.net/none", ""))
    p, docs = make(spark, documents, pages)
    assert {r.page_id: r.lang for r in identify(p, docs).collect()}[60] == "fr"


def test_all_of_many_languages_count(spark, documents):
    """70 languages, the rarest of them too."""
    langs = [f"{a}{b}" for a in "abcdefg" for b in "qrstuvwxyz"]
    text = {k: " ".join(f"{k}{c}{k}" for c in "aeiou") for k in langs}
    docs = documents(*[(100 * i + j, text[k], k, "s", 1) for i, k in enumerate(langs) for j in range(1 if i % 7 == 6 else 2)])
    p = spark.createDataFrame([(i, None, f"<p>{text[k] * 9}</p>") for i, k in enumerate(langs)], "page_id long, url string, html string")
    assert [r.text_lang for r in identify(p, docs).orderBy("page_id").collect()] == langs


def test_repeated_pages_no_languages_and_empty(spark, documents):
    p, docs = make(spark, documents, [page("de", "de", "https://a.org/")] * 3)
    assert [r.lang for r in identify(p, docs).collect()] == ["de"] * 3
    assert [r.lang for r in identify(p, docs.limit(0)).collect()] == [None] * 3
    assert identify(p.limit(0), docs).count() == 0


def test_visible_text():
    assert visible_text("<p>a<br>b<!-- c --><style>d</style>&amp;").split() == ["a", "b", "&"]
    assert visible_text("1 < 2 <b>x</b><SCRIPT>y</script >z<style/>w").split() == ["1", "<", "2", "x", "z", "w"]
    assert visible_text("a<!-- b").split() == visible_text("a<script>b").split() == visible_text("a<b").split() == ["a"]


def test_hostile_markup_takes_linear_time():
    for piece in ("<", "<!--", "<script>", "<html ", "<a", "lang=", "</"):
        start = time.perf_counter()
        for markup in (piece * (1_000_000 // len(piece)), "<html " + piece * (1_000_000 // len(piece))):
            visible_text(markup)
            declared_language(markup)
        assert time.perf_counter() - start < 5, piece


def test_whole_tags_and_suffixes(spark, documents):
    assert declared_language("<!doctype html><HTML class='x' lang = 'pt-BR'>") == "pt-br"
    assert declared_language("<html data-lang='xx'><p lang='de'>") == "" and declared_language("<html xml:lang=sr-Latn") == "sr-latn"
    urls = ["https://a.example.info/x", "https://b.xn--p1ai/", "https://c.museum", "https://10.0.0.1/", "https://host/"]
    pages = [page("de", "de-AT", u) for u in urls] + [page("fr", "fr-CA", f"https://d.example.info/{i}") for i in range(3)]
    p, docs = make(spark, documents, pages)
    found = {r.page_id: r for r in identify(p.selectExpr("*", "'x' AS host", "'y' AS lang", "'z' AS size", "1 AS row"), docs).collect()}
    assert [found[i].lang for i in range(8)] == ["de"] * 5 + ["fr"] * 3
    assert {r.declared for r in found.values()} == {"de-at", "fr-ca"}


def test_fusion_against_brute_force(spark, documents):
    """All sums in plain Python, from the same n-grams."""
    pages = [page(k, d, f"https://{h}.example.{x}/{g}/{i}", t) for i, (k, d, h, x, g, t) in enumerate(
        [("en", "en", "a", "org", "en", None), ("de", None, "a", "de", "x", None), ("fr", "en", "b", "fr", "fr", None), ("en", "de", "b", "info", "", ""),
         ("de", "de-at", "c", "de", "de", "der wind"), ("fr", None, "c", "fr", "f", "la mer"), ("en", "en", "a", "org", "en", "the sea")] * 3)]
    p, docs = make(spark, documents, pages)
    grams = lambda t: Counter(hashed(characters(t), ORDERS, BITS).tolist())
    langs, counts = sorted(TEXT), defaultdict(Counter)
    for r in docs.collect():
        if r.lang:
            counts[r.lang] += grams(r.text or "")
    size = 1 << BITS
    log = {k: (lambda g, c=counts[k], n=sum(counts[k].values()): math.log((c[g] + 0.5) / (n + 0.5 * size))) for k in langs}
    mean = lambda g: sum(log[k](g) for k in langs) / len(langs)
    rows = []
    for url, markup in pages:
        like = np.array([0.05 * sum(c * (log[k](g) - mean(g)) for g, c in grams(visible_text(markup)).items()) for k in langs])
        post = np.exp(like - like.max()) / np.exp(like - like.max()).sum()
        host = url.split("/")[2]
        first = url.split("/")[3]
        rows.append({"like": like, "post": post, "declared": declared_language(markup), "suffix": host.split(".")[-1], "segment": first if len(first) in (2, 3) else "",
                     "site": ".".join(host.split(".")[-2:]), "host": host})
    whole = sum(r["post"] for r in rows) + 0.5
    base, trust = whole / whole.sum(), 8.0
    found = {r.page_id: r for r in identify(p, docs).collect()}
    for i, r in enumerate(rows):
        fused = r["like"].copy()
        for name in ("declared", "suffix", "segment"):
            same = [x for x in rows if x[name] == r[name]]
            fused += np.log((sum(x["post"] for x in same) + len(same) / len(rows)) / (whole + 1))
        prior = base
        for name in ("site", "host"):
            others = np.maximum(sum(x["post"] for x in rows if x[name] == r[name]) - r["post"], 0)
            prior = (others + trust * prior) / (others.sum() + trust)
        fused += np.log(prior)
        assert found[i].lang == langs[int(fused.argmax())]
        assert abs(found[i].score - 1 / np.exp(fused - fused.max()).sum()) < 1e-6
