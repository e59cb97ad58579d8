import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import cotraining, toxicity
from sparkloom.llm.cotraining import keep_good, score_quality
from sparkloom.llm.ngrams import characters, fit_logistic, hashed
from sparkloom.llm.toxicity import score_toxicity

WORDS = ["river", "stone", "cloud", "north", "table", "glass", "light", "paper", "green", "house", "under", "music", "seven", "bread", "ocean", "tiger"]


@pytest.fixture
def corpus(spark, documents):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(500):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobianish", "Grobians!"]))
        if bad:
            words = [w.upper() + "!!!" for w in words]
        texts.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad), int(toxic)))
    texts += [(9000, None), (None, "river stone grobian"), (9001, "")]
    return documents(*texts, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(corpus):
    docs, labels = corpus
    found = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(found) == 503
    held = [r for d, r in found.items() if d is not None and d < 500 and r.held_out]
    assert 60 < len(held) < 140
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert found[9000].score == found[9001].score and found[None].held_out


def test_toxicity_ignores_held_out_labels(spark, corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({(r.doc_id, round(r.score, 12)) for r in score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark, documents):
    docs = documents("a", "b")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, None, None), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.5}
    assert all(r.predicted == 0 for r in score_toxicity(docs, one).collect())
    assert score_toxicity(docs.limit(0), none).count() == 0


def test_quality(corpus):
    docs, labels = corpus
    found = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    held = [r for d, r in found.items() if d is not None and d < 500 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 7 != 0) for r in held) / len(held) >= 0.97
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.predicted}


def test_quality_without_labels(spark, documents):
    docs = documents("a", None)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep_good(docs, none).count() == 2
    assert {r.predicted for r in score_quality(docs, none).collect()} == {1}
    assert score_quality(docs.limit(0), none).count() == 0


def test_views_of_odd_texts():
    for text in ("", " ", "\n\n", "é" * 100_000, "a\n" * 1000):
        found = cotraining.content(text)
        assert (found >= 1 << cotraining.BITS).sum() == len(cotraining.CUTS)
        assert (cotraining._places(cotraining._packed(found)) == found).all()
    for declared in ((None, None, None), ("en", "src", 10**9), ("", "", -5)):
        assert len(set(cotraining.metadata(*declared).tolist())) == 5
    assert (cotraining.metadata(None, None, None) != cotraining.metadata("", "", 0)).any()


def test_labels_that_repeat_count_once(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 7)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.labelled(labels, "toxic", 10, 10**9).collect()) == [(1, 1), (2, 0)]


def test_toxicity_counts_and_fit_against_brute_force(corpus):
    """Counts and ratios from plain dictionaries; the fit is where the slope of its loss is nil; scores follow."""
    docs, labels = corpus
    rows = {r.doc_id: r.label for r in toxicity.labelled(labels, "toxic", 10**6, 5).collect()}
    texts = toxicity.sample_texts(docs, toxicity.labelled(labels, "toxic", 10**6, 5), "doc_id", "text")
    model = toxicity.fit_ngrams(texts, (3, 4), 16, least=4, significance=0, ridge=1e-3)
    all_texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    grams = {d: set(hashed(characters(all_texts[d], False), (3, 4), 16).tolist()) for d in all_texts}
    n = [sum(y == c for y in rows.values()) for c in (0, 1)]
    counts = [Counter(g for d, y in rows.items() if y == c for g in grams[d]) for c in (0, 1)]
    ratio = {g: math.log((counts[1][g] + 1) / (n[1] + 2)) - math.log((counts[0][g] + 1) / (n[0] + 2)) for g in set(counts[0]) | set(counts[1]) if counts[0][g] + counts[1][g] >= 4}
    assert {int(b) for b in np.flatnonzero(model.table >= 0)} == set(ratio)
    weight = {g: float(model.weights[model.table[g]]) for g in ratio}
    logit = lambda d: sum(weight[g] for g in grams[d] if g in weight) + model.bias
    rest = {d: 1 / (1 + math.exp(-logit(d))) - y for d, y in rows.items()}
    for g in list(ratio)[::50]:
        slope = sum(rest[d] for d in rows if g in grams[d]) * ratio[g] / len(rows) + 1e-3 * (weight[g] / ratio[g] if ratio[g] else 0)
        assert abs(slope) < 2e-3
    assert abs(sum(rest.values()) / len(rows)) < 2e-3
    assert all(abs(model.logit(all_texts[d]) - logit(d)) < 1e-3 for d in all_texts)


def test_disguised_words_are_seen(spark, documents):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=30)) + (" you gr0b!@n" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in score_toxicity(documents(*texts), labels).collect()}
    assert all(found[i] == int(i % 4 == 0) for i in range(400))


def test_fit_against_plain_descent():
    """The fit in pieces, rows without features among them, ends where plain gradient descent does."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(60)]
    scales, labels = rng.normal(size=6), (rng.random(60) < 0.5).astype(float)
    w, bias = fit_logistic(np.concatenate(rows), np.array([len(r) for r in rows]), scales, labels, 0.01, steps=500, piece=7)
    x = np.array([[scales[j] if j in set(r) else 0.0 for j in range(6)] + [1.0] for r in rows])
    v = np.zeros(7)
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-x @ v)) - labels) / 60
        g[:6] += 0.01 * v[:6]
        v -= g
    assert np.abs(np.append(w, bias) - v).max() < 2e-2


def test_repeated_rows_and_clashing_names(spark, documents):
    """An id that repeats is learnt from once; each of its rows gets a score, the same for the same text."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=20)) + (" grobian" if i % 3 == 0 else "")) for i in range(90)] + [(4, "river " * 50_000, "en", "s", 300_000)] * 3
    docs = documents(*rows, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    for found in (score_toxicity(docs, labels).collect(), score_quality(docs, labels).collect()):
        assert len(found) == 93
        assert len({r.score for r in found if r.doc_id == 4}) <= 2
    known = toxicity.sample_texts(docs, toxicity.labelled(labels, "toxic", 100, 5), "doc_id", "text").collect()
    assert len(known) == len({r.doc_id for r in known})


def test_quality_against_brute_force(corpus):
    """Scores follow from the model's views and calibration, computed in plain Python for every document."""
    docs, labels = corpus
    model, _ = cotraining.fit_cotraining(docs, labels)
    scored = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    for r in docs.limit(60).collect():
        z = [float(v.weights[places].sum() + v.bias) for v, places in zip(model.views, (cotraining.content(r.text or ""), cotraining.metadata(r.lang, r.source, r.n_chars)), strict=True)]
        p = 1 / (1 + math.exp(-(model.slopes[0] * z[0] + model.slopes[1] * z[1] + model.bias)))
        assert abs(scored[r.doc_id].score - p) < 1e-9


def test_views_teach_each_other(spark, documents):
    """Labels in one source only; metadata knows the bad source, content learns its words from it."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = rng.choices(WORDS[:8] if i < 200 else WORDS[8:], k=40) + (["junk"] * 8 if bad and i < 200 else ["waste"] * 8 if bad else [])
        rows.append((i, " ".join(words), "en", "bad" if bad else "good", 300))
        if i < 200:
            labels.append((i, int(not bad)))
    found = {r.doc_id: r for r in score_quality(documents(*rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    late = [found[i] for i in range(200, 600)]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in late) / len(late) >= 0.97
    assert sum((r.content_score >= 0.5) == (r.doc_id % 3 != 0) for r in late) / len(late) >= 0.97
