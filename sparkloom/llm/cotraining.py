"""Quality classifier by co-training of two views.

View 1 is the text's content: n-grams of its characters, case and signs included, and statistics of its words and lines
(repeats, variety, word and line lengths, shares of capitals, digits and signs), each cut into intervals. View 2 is what
the page declares beside its text: source, language, declared length and pairs of them; it never sees the text. Both are
fitted on a bounded sample of labelled rows, on all places that occur. In each round both score all documents; each
view's surest unlabelled documents become labelled examples for the other view (a view that is sure of nothing teaches
nothing). At the end a part of the sample that was not learnt from calibrates both views, and their combination scores
all documents. Texts are turned into features once, in a stored table that all rounds read.

Bounds: `sample` labelled rows and `exchange` documents a class, view and round are learnt from, each of them one row of
its id (that with the least hash, where an id repeats); scoring and the search for sure documents cover all rows.

Defined results: a null text is an empty one; null source, language and length are values of their own; ids that repeat
in the labels count once, as bad if any row says so; a null id is held out of learning; without labels of both classes
nothing is rejected. Repeated rows each get their score, very long texts are read whole, other columns are unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import fit_logistic
from .shared import discard, small_batches, stored, tidy
from .toxicity import held_out, labelled

BITS = 15
#: Odd factors of the hashes of pairs and triples of characters, and the shift that leaves BITS bits.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_DOWN = np.uint32(32 - BITS)
#: Upper ends of the intervals that layout values fall into.
CUTS = {
    "chars": np.array([0, 40, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200]),
    "line": np.array([1, 20, 40, 80, 160, 320, 640, 1280]),
    "lines": np.array([1, 2, 3, 5, 8, 13, 21, 34, 55]),
    "repeats": np.array([0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8]),
    "variety": np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "stutter": np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4]),
    "word": np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 14]),
    "capitals": np.array([0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.7]),
    "digits": np.array([0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3]),
    "signs": np.array([0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.15, 0.25]),
    "stops": np.array([0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.04, 0.1]),
}
_WIDTH = 16
#: 1 capital, 2 digit, 3 sign, 4 full stop, 0 other; by Latin-1 code, the last one standing for all beyond.
_KIND = np.zeros(256, np.int64)
_KIND[65:91] = _KIND[0xC0:0xDF] = 1
_KIND[48:58] = 2
for _low, _high in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_low:_high] = 3
_KIND[46] = 4
_CONTENT = (1 << BITS) + len(CUTS) * _WIDTH
#: Upper ends of the intervals of declared lengths, and places of lengths, languages, sources and pairs.
LENGTHS = np.array([0, 20, 40, 70, 100, 150, 200, 300, 400, 600, 800, 1200, 1600, 2400, 3200, 4800, 6400, 12800, 25600, 51200])
_META = (32, 64, 512, 1024, 1024)


def _codes(text: str) -> np.ndarray:
    """Code points of a text, a byte each where all fit into one."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def statistics(text: str, codes: np.ndarray) -> list[int]:
    """The interval that each statistic of the text falls into, as places."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_KIND[np.minimum(codes, 255)], minlength=5) / max(1, len(codes))
    values = {
        "chars": len(text),
        "line": len(text) / max(1, len(lines)),
        "lines": len(lines),
        "repeats": 1 - len(set(lines)) / max(1, len(lines)),
        "variety": len(set(words)) / max(1, len(words)),
        "stutter": sum(map(eq, words, words[1:])) / max(1, len(words)),
        "word": sum(map(len, words)) / max(1, len(words)),
        "capitals": kinds[1],
        "digits": kinds[2],
        "signs": kinds[3] + kinds[4],
        "stops": kinds[4],
    }
    return [i * _WIDTH + int(np.searchsorted(CUTS[k], values[k])) for i, k in enumerate(CUTS)]


def content(text: str) -> np.ndarray:
    """Distinct n-gram buckets of a text with its case and signs, then the places of its statistics."""
    codes = _codes(text)
    padded = np.concatenate(([32], codes, [32])).astype(np.uint32)
    pairs = padded[:-1] * _FACTORS[0] + padded[1:]
    seen = np.zeros(_CONTENT, bool)
    seen[(pairs * _FACTORS[1]) >> _DOWN] = True
    seen[((pairs[:-1] * _FACTORS[0] + padded[2:]) * _FACTORS[2]) >> _DOWN] = True
    seen[[(1 << BITS) + x for x in statistics(text, codes)]] = True
    return np.flatnonzero(seen)


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Active places of what is declared about a document."""
    length = _META[0] - 1 if n_chars is None else int(np.searchsorted(LENGTHS, n_chars))
    lang, source = ("null" if x is None else f"={x}" for x in (lang, source))
    values = (length, zlib.crc32(lang.encode()), zlib.crc32(source.encode()), zlib.crc32(f"{lang} {length}".encode()), zlib.crc32(f"{source} {lang}".encode()))
    starts = np.cumsum((0, *_META[:-1]))
    return np.array([a + v % n for a, v, n in zip(starts, values, _META, strict=True)])


@dataclass
class View:
    weights: np.ndarray
    bias: float

    def logit(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() + self.bias)


def fit_view(rows: list[np.ndarray], labels: np.ndarray, places: int, ridge: float, least: int = 3) -> View:
    """Logistic regression on log-count ratios of all places that `least` rows have."""
    counts = [np.zeros(places), np.zeros(places)]
    for r, y in zip(rows, labels, strict=True):
        counts[int(y)][r] += 1
    n = [max(1, int((labels == c).sum())) for c in (0, 1)]
    scales = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    scales[counts[0] + counts[1] < least] = 0
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    w, bias = fit_logistic(flat, sizes, scales, labels.astype(float), ridge)
    return View(w * scales, bias)


def _inputs(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(chars_col).cast("long").alias("n_chars"),
    )


def _packed(found: np.ndarray) -> bytes:
    """Ascending places as their gaps, which compress well."""
    return np.diff(found, prepend=0).astype("<u2").tobytes()


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2"), dtype=np.int32)


def features(rows: DataFrame) -> DataFrame:
    """doc_id, content, metadata of rows (doc_id, text, lang, source, n_chars), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, *declared = (batch.column(1 + i).to_pylist() for i in range(4))
            arrays = [pa.array([_packed(content(t)) for t in texts], pa.binary()), pa.array([_packed(metadata(*d)) for d in zip(*declared, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "content", "metadata"])

    return stored(rows.mapInArrow(tidy(run), "doc_id long, content binary, metadata binary"), "features")


def _learnt(found: DataFrame, chosen: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """doc_id, label and both views of a bounded set of rows (doc_id, label), one an id, in order of doc_id."""
    both = F.struct("content", "metadata")
    rows = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by(both, F.xxhash64("content", "metadata")).alias("v"))
    rows = rows.select("doc_id", "label", "v.content", "v.metadata").orderBy("doc_id").toPandas()
    return [(d, y, _places(a), _places(b)) for d, y, a, b in rows.itertuples(index=False)]


def _score(found: DataFrame, views: tuple[View, View]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [pa.array([v.logit(_places(x)) for x in batch.column(1 + i).to_pylist()], pa.float64()) for i, v in enumerate(views)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *z], ["doc_id", "za", "zb"])

    return found.select("doc_id", "content", "metadata").mapInArrow(tidy(run), "doc_id long, za double, zb double")


def _surest(scores: DataFrame, view: str, most: int) -> DataFrame:
    """The documents a view is surest of: `most` of each class at most, if it is sure to 0.95 of them."""
    sides = []
    for label, order in ((1, F.desc(view)), (0, F.asc(view))):
        sure = F.col(view) >= 3 if label else F.col(view) <= -3
        sides.append(scores.filter(sure).orderBy(order, "doc_id").limit(most).select("doc_id", F.lit(label).alias("label")))
    return sides[0].unionByName(sides[1])


@dataclass
class CoModel:
    """Two views, and for each the slope of its calibrated logit; the bias of their sum."""

    views: tuple[View, View]
    slopes: tuple[float, float]
    bias: float

    def probability(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        za, zb = self.views[0].logit(a), self.views[1].logit(b)
        squash = lambda z: 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))
        return squash(za), squash(zb), squash(self.slopes[0] * za + self.slopes[1] * zb + self.bias)


def fit_cotraining(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8_000, exchange: int = 400, rounds: int = 2, folds: int = 5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars",
) -> tuple[CoModel | None, DataFrame]:
    """The model, or None without labels of both classes; and the stored features of all rows."""
    small_batches(docs.sparkSession)
    found = features(_inputs(docs, id_col, text_col, lang_col, source_col, chars_col))
    good = labels.select(F.col(id_col), (1 - F.col(label)).alias("_bad"))
    known = labelled(good, "_bad", sample, folds, id_col).select("doc_id", (1 - F.col("label")).alias("label"))
    known = stored(known, "known")
    first = {d: (y, a, b) for d, y, a, b in _learnt(found, known)}  # bounded by sample
    aside = {d for d in first if zlib.crc32(f"aside {d}".encode()) % 4 == 0}
    learn = [v for d, v in first.items() if d not in aside]
    check = [v for d, v in first.items() if d in aside]
    if len({v[0] for v in learn}) < 2:
        return None, found
    extra: tuple[list, list] = ([], [])  # what view 1 and view 2 are taught by the other
    views = None
    for turn in range(rounds + 1):
        fitted = []
        for i, ridge in ((0, 3e-4), (1, 1e-3)):
            data = [(v[0], v[1 + i]) for v in learn] + [(y, v) for y, v in extra[i]]
            fitted.append(fit_view([v for _, v in data], np.array([y for y, _ in data]), (_CONTENT, sum(_META))[i], ridge))
        views = (fitted[0], fitted[1])
        if turn == rounds:
            break
        scores = stored(_score(found.join(F.broadcast(known), "doc_id", "left_anti"), views), "scores")
        for i, view in ((1, "za"), (0, "zb")):
            surest = _surest(scores, view, exchange)  # bounded by exchange
            extra[i].extend((y, (a, b)[i]) for _, y, a, b in _learnt(found, surest))
        discard(scores)
    return calibrate(views, check or learn), found


def calibrate(views: tuple[View, View], rows: list[tuple]) -> CoModel:
    """Slopes and bias that make the views' sum a probability on rows not learnt from, by Newton steps."""
    x = np.array([[views[0].logit(a), views[1].logit(b), 1.0] for _, a, b in rows])
    y = np.array([v[0] for v in rows], float)
    w, ridge = np.array([0.5, 0.5, 0.0]), np.array([1.0, 1.0, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * (w - np.array([0.5, 0.5, 0.0])))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return CoModel(views, (max(0.0, float(w[0])), max(0.0, float(w[1]))), float(w[2]))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.5, **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, content_score, metadata_score, score, predicted (1: good)."""
    model, found = fit_cotraining(docs, labels, label, folds=folds, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(map(_places, batch.column(1 + i).to_pylist()) for i in range(2)), strict=True)
            p = np.array([model.probability(a, b) if model else (1.0, 1.0, 1.0) for a, b in both]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(3))], ["doc_id", "content_score", "metadata_score", "score"])

    scored = found.mapInArrow(tidy(run), "doc_id long, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs."""
    model, found = fit_cotraining(docs, labels, label, **how)
    discard(found)
    if model is None:
        return docs
    shown = [f"_c{i}" for i in range(len(docs.columns))]
    at = [docs.columns.index(how.get(k, v)) for k, v in (("text_col", "text"), ("lang_col", "lang"), ("source_col", "source"), ("chars_col", "n_chars"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            good = [model.probability(content(t or ""), metadata(g, s, n))[2] >= threshold for t, g, s, n in values]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.toDF(*shown).mapInArrow(tidy(run), docs.toDF(*shown).schema).toDF(*docs.columns)
