"""Language-model scoring with a log-frequency Bloom filter.

1. Words of the training texts are counted exactly (128-bit names of words, numpy in tasks, summed by shuffle). The most
   frequent ones, `most_words` at most, are broadcast; counts of the others are joined to the few tokens that need them.
2. n-grams of all orders are counted by segments of their 64-bit hash: tasks send sorted arrays, a segment merges them,
   quantises each count to a level of a logarithmic codebook and enters the n-gram once for each level up to its own in
   the segment's Bloom filter (4 bits in one 64-bit word an entry, `bits` bits of filter an entry). All n-grams are
   entered; the filter grows with the corpus, and a segment keeps its size.
3. Scoring probes level after level until one is missing, which gives the count of an n-gram within the codebook's steps,
   seldom more by chance and never less. Probabilities are smoothed from order to order:
   p_n = (c_n + strength * p_(n-1)) / (c_history + strength), p_1 = (c_1 + 0.1) / (N + 0.1 * (V + 1)).
   The filter is broadcast where it has no more than `most_bytes` bytes. Where it has more, the distinct n-grams of
   chunks of texts (8 MB) are sent to the segments instead, in groups of bounded size, and the levels come back: the
   same scores. Levels and counts of words are looked up once for each distinct n-gram of a block.

Tokens are words of other characters than U+0020 and U+0009 to U+000D, with A-Z lower-cased, and one end a text. Long texts are read
in blocks at word boundaries, n-grams across them included.

Defined results: a null text is an empty one and has the end alone; a null doc_id is never learnt from; repeated rows
count and are scored each for itself; without training rows every count is 0; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, small_batches, stored, tidy

_U = np.uint64
_M1, _M2, _ODD1, _ODD2, _GOLD = map(_U, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15))
_S33, _S32, _S6, _S12, _S18, _63, _ONE = map(_U, (33, 32, 6, 12, 18, 63, 1))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_END = (_U(0x656E64206F662074), _U(0x6865207465787421))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_LONG = 4096
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def blocks(texts: list[str | None], context: int, limit: int = 4 << 20) -> Iterator[list[tuple[int, bytes, int, bool]]]:
    """Lists of (text's place, bytes, number of leading words that are context only, whether the text ends here)."""
    out: list[tuple[int, bytes, int, bool]] = []
    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower: A-Z only
        start, before = 0, []
        while True:
            after = _WHITE.search(raw, start + limit) if len(raw) - start > limit else None
            stop = after.start() if after else len(raw)
            part = raw[start:stop]
            out.append((i, b" ".join([*before, part]), len(before), stop == len(raw)))
            size += len(part) + 1
            if size >= limit:
                yield out
                out, size = [], 0
            if stop == len(raw):
                break
            if context:
                before = [*before, *part.rsplit(None, context)[-context:]][-context:]
            start = stop
    if out:
        yield out


class Tokens:
    """Tokens of a block: two 64-bit names of each, their text's place, whether they count, their place in the block's part."""

    def __init__(self, block: list[tuple[int, bytes, int, bool]]) -> None:
        texts = np.array([b[0] for b in block])
        skip, ends_here = np.array([b[2] for b in block]), np.array([b[3] for b in block])
        raw = b" ".join(b[1] for b in block) + b" " * 8
        data = np.frombuffer(raw, np.uint8)
        begins = np.cumsum([0, *(len(b[1]) + 1 for b in block[:-1])])
        white = np.concatenate(([True], _IS_WHITE[data]))
        edge = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edge[::2], edge[1::2]
        one, two = self._names(raw, starts, ends - starts)
        part = np.searchsorted(begins, starts, "right") - 1
        words = np.bincount(part, minlength=len(block))
        held = words + ends_here
        self.one, self.two = np.empty(held.sum(), _U), np.empty(held.sum(), _U)
        at = np.arange(len(one)) + (np.cumsum(ends_here) - ends_here)[part]
        last = (np.cumsum(held) - 1)[ends_here]
        self.one[at], self.two[at] = one, two
        self.one[last], self.two[last] = _END
        part = np.repeat(np.arange(len(block)), held)
        self.place = np.arange(len(part)) - (np.cumsum(held) - held)[part]
        self.counted = self.place >= skip[part]
        self.text = texts[part]

    @staticmethod
    def _names(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the 8 bytes from any place on
        one, two = _mix(sizes.astype(_U) * _ODD2), _mix(sizes.astype(_U) * _ODD1)
        todo, done = np.arange(len(starts)), 0
        while len(todo):
            chunk = eight[starts[todo] + done] & _FIRST[np.minimum(sizes[todo] - done, 8)]
            one[todo], two[todo] = _mix(one[todo] ^ chunk * _ODD1), _mix(two[todo] * _GOLD + chunk * _ODD2)
            done += 8
            todo = todo[sizes[todo] > done]
            if done >= _LONG:
                break
        for i in todo:  # very long words
            name = hashlib.blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=16).digest()
            one[i], two[i] = np.frombuffer(name, "<u8")
        return one, two

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the hash of the n-gram that ends at each token, and whether there is one."""
        out = [(_mix(self.one ^ _GOLD), np.ones(len(self.one), bool))]
        for n in range(2, order + 1):
            last = np.concatenate((np.zeros(1, _U), out[-1][0][:-1]))
            out.append((_mix(last * _ODD2 + self.one), self.place >= n - 1))
        return out


def _firsts(x: np.ndarray) -> np.ndarray:
    """Whether each value of sorted ones is the first of its kind."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Grams:
    """A block's tokens, its distinct n-grams in order of their hashes, and for each order the place of each token's n-gram among them."""

    def __init__(self, block: list[tuple[int, bytes, int, bool]], order: int) -> None:
        self.tokens = Tokens(block)
        grams = self.tokens.grams(order)
        hashes = np.concatenate([h for h, _ in grams])
        by = np.argsort(hashes)
        hashes = hashes[by]
        first = _firsts(hashes)
        self.hashes, at = hashes[first], np.empty(len(by), np.int32)
        at[by] = np.cumsum(first, dtype=np.int32) - 1
        self.at, self.there = np.split(at, order), [there for _, there in grams]

    def counts(self, words: Words) -> np.ndarray:
        """Counts of the tokens as words, each distinct one looked up once."""
        one, two, at = self.tokens.one, self.tokens.two, self.at[0]
        some = np.full(len(self.hashes), -1, np.int64)
        some[at] = np.arange(len(at))  # a token of each word
        kinds = some[some >= 0]
        out = np.empty(len(some), np.int64)
        out[some >= 0] = words.counts(one[kinds], two[kinds])
        out, other = out[at], np.flatnonzero(two != two[some[at]])
        out[other] = words.counts(one[other], two[other])  # words that share one name of the two
        return out


def counted_words(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    start = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, int)
    return one[start], two[start], np.diff(np.r_[start, len(one)])


def codebook(ratio: float = 1.5, most: int = 1 << 62) -> np.ndarray:
    """Least count of each level: 1, 2, 3, 4, 6, 9 and so on."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


CODES = codebook()
#: The count that a level stands for, from level 0 on.
VALUES = np.r_[0.0, (CODES[:-1] + CODES[1:] - 1) / 2]


def _bits(hashes: np.ndarray, level: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of an entry."""
    x = _mix(hashes + _U(level * int(_GOLD) & _ALL))
    mask = (_ONE << (x & _63)) | (_ONE << ((x >> _S6) & _63)) | (_ONE << ((x >> _S12) & _63)) | (_ONE << ((x >> _S18) & _63))
    return ((x >> _S32) * words) >> _S32, mask


def filter_of(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A segment's filter of distinct hashes."""
    levels = np.searchsorted(CODES, counts, "right")
    out = np.zeros(max(1, -(-int(levels.sum()) * bits // 64)), _U)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _bits(hashes[levels >= level], level, _U(len(out)))
        np.bitwise_or.at(out, at.astype(np.int64), mask)
    return out


class Filter:
    """Levels of n-grams, from the filters of some segments: their sizes first, then each (segment, filter)."""

    def __init__(self, segments: int, sizes: dict[int, int], filters: Iterable[tuple[int, np.ndarray]]) -> None:
        self.segments, self.sizes = segments, np.ones(segments, _U)
        self.sizes[list(sizes)] = list(sizes.values())
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(_U)
        self.body = np.zeros(int(self.sizes.sum()), _U)
        for k, f in filters:
            self.body[int(self.starts[k]) : int(self.starts[k]) + len(f)] = f

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
        segment = segment_of(hashes, self.segments)
        starts, sizes, level = self.starts[segment], self.sizes[segment], 0
        while len(alive) and level < len(CODES) - 1:
            level += 1
            at, mask = _bits(hashes, level, sizes)
            there = (self.body[(starts + at).astype(np.int64)] & mask) == mask
            alive, hashes, starts, sizes = alive[there], hashes[there], starts[there], sizes[there]
            out[alive] = level
        return out


class Segment(Filter):
    """Levels of the n-grams of one segment."""

    def __init__(self, body: np.ndarray) -> None:
        super().__init__(1, {0: len(body)}, [(0, body)])


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (((hashes >> _S32) * _U(segments)) >> _S32).astype(np.int64)


def by_segment(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """The slice of each segment in sorted hashes."""
    own = segment_of(hashes, segments)
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for a, b in pairwise(cuts):
        if b > a:
            yield int(own[a]), slice(a, b)


def held_out(doc_id: Column, folds: int) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """one, two, count: the two names of each token of the texts, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), 0):
                t = Tokens(block)
                one, two, n = counted_words(t.one, t.two)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n)], ["one", "two", "count"])

    rows = texts.mapInArrow(tidy(run), "one long, two long, count long")
    return stored(rows.groupBy("one", "two").agg(F.sum("count").alias("count")), "word-counts")


def segment_filters(texts: DataFrame, order: int, segments: int, bits: int, held: int = 4_000_000) -> DataFrame:
    """segment, filter: the Bloom filter of each segment that has n-grams. held: n-grams that a task sorts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def rows() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, _U), return_counts=True)
            out = []
            for k, s in by_segment(hashes, segments):
                h, c = hashes[s], counts[s]
                out.append((k, h[c == 1].tobytes(), h[c > 1].tobytes(), c[c > 1].astype("<i8").tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["segment", "single", "several", "counts"])

        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), order - 1):
                t = Tokens(block)
                for hashes, there in t.grams(order):
                    parts.append(hashes[there & t.counted])
                    size += len(parts[-1])
                if size >= held:
                    yield rows()
                    parts, size = [], 0
        yield rows()

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        single, several = (np.frombuffer(b"".join(rows[c]), "<u8") for c in ("single", "several"))
        hashes = np.concatenate((single, several))
        counts = np.concatenate((np.ones(len(single), np.int64), np.frombuffer(b"".join(rows["counts"]), "<i8")))
        hashes, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, counts, len(hashes)).astype(np.int64)
        out = pd.DataFrame({"segment": [key[0]], "filter": [filter_of(hashes, counts, bits).tobytes()]})
        del single, several, hashes, at, counts
        give_back()
        return out

    rows = texts.mapInArrow(tidy(run), "segment long, single binary, several binary, counts binary")
    return stored(rows.groupBy("segment").applyInPandas(build, "segment long, filter binary"), "filters")


class Words:
    """Counts of the frequent words. complete: words that aren't among them have the count 0."""

    def __init__(self, one: np.ndarray, two: np.ndarray, count: np.ndarray, complete: bool) -> None:
        order = np.lexsort((two, one))
        self.one, self.two, self.count, self.complete = one[order], two[order], count[order], complete

    def counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Counts, -1 where there is none here."""
        out, todo = np.full(len(one), -1, np.int64), np.arange(len(one))
        at = np.searchsorted(self.one, one)
        while len(todo):
            todo = todo[at[todo] < len(self.one)]
            todo = todo[self.one[at[todo]] == one[todo]]
            same = self.two[at[todo]] == two[todo]
            out[todo[same]] = self.count[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1
        return np.maximum(out, 0) if self.complete else out


class Model:
    def __init__(self, tokens: int, words: int, order: int, strength: float) -> None:
        self.order, self.strength, self.total = order, strength, tokens + 0.1 * (words + 1)

    def logs(self, g: Grams, levels: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token. levels: of the distinct n-grams."""
        p, history, values = None, None, VALUES[levels]
        for at, there in zip(g.at, g.there, strict=True):
            found = values[at]
            if p is None:
                p = (found + 0.1) / self.total
            else:
                last = np.r_[0.0, history[:-1]]
                found = np.minimum(found, np.minimum(last, history))  # no n-gram is more frequent than its parts
                p = np.where(there, (found + self.strength * p) / (last + self.strength), p)
            history = found
        return np.log10(np.minimum(p, 1.0))


_FIELDS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, one array<long>, two array<long>"


def _scored(batch: pa.RecordBatch, grams: Iterable[Grams], words: Words, model: Model, levels: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """A row of _FIELDS for each row (row, doc_id, held_out, text) of a batch; words not among the frequent ones as arrays."""
    n, known, base, score = (np.zeros(len(batch), d) for d in (np.int64, np.int64, float, float))
    rest: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))]
    for g in grams:
        t = g.tokens
        at, count = t.text[t.counted], g.counts(words)[t.counted]
        logs = model.logs(g, levels(g.hashes))[t.counted]
        add = lambda v: np.bincount(at, v, len(batch))  # noqa: B023, E731
        n += add(None)
        known += add((count > 0).astype(float)).astype(np.int64)
        base += add(np.where(count < 0, 0.0, np.log10((np.maximum(count, 0) + 0.1) / model.total)))
        score += add(logs)
        rare = np.flatnonzero(count < 0)
        rest.append((at[rare], t.one[t.counted][rare], t.two[t.counted][rare]))
    of, *names = (np.concatenate(x) for x in zip(*rest, strict=True))  # in order of the texts
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(batch)))].astype(np.int32)
    arrays = [*batch.columns[:3], pa.array(n), pa.array(known), pa.array(base), pa.array(score)]
    arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(np.int64))) for x in names]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _FIELDS.split(", ")])


def _grams(batch: pa.RecordBatch, order: int) -> Iterator[Grams]:
    return (Grams(block, order) for block in blocks(batch.column(3).to_pylist(), order - 1, 1 << 20))


def score_here(rows: DataFrame, words, model: Model, filters) -> DataFrame:
    """Scores by the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bloom = words.value, filters.value
        for batch in batches:
            yield _scored(batch, _grams(batch, model.order), table, model, bloom.levels)

    return rows.mapInArrow(tidy(run), _FIELDS)


def in_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, tokens (that many at most), body: rows (row, doc_id, held_out, text) of at most chunk_bytes of text, or one row, in Arrow's format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            tokens = sum(len((text or "").split()) + 1 for part in held for text in part.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["tokens", "body"])

        for batch in batches:
            start = 0
            for i, more in enumerate(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()):
                if size and size + more > chunk_bytes:
                    held.append(batch.slice(start, i - start))
                    yield chunk()
                    held, size, start = [], 0, i
                size += more + 1
            held.append(batch.slice(start))
        if size:
            yield chunk()

    chunks = rows.mapInArrow(tidy(run), "tokens long, body binary")
    return stored(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _opened(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]


def _distinct(grams: Iterable[Grams]) -> np.ndarray:
    hashes = np.sort(np.concatenate([g.hashes for g in grams]))
    return hashes[_firsts(hashes)]


def score_by_segments(rows: DataFrame, words, model: Model, filters: DataFrame, segments: int, group_bytes: int = 48 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The same scores where the filter isn't broadcast: distinct n-grams of chunks go to the segments, their levels come back.

    group_bytes: of n-grams, before the distinct ones are taken, that are answered at once.
    """
    chunks = in_chunks(rows, chunk_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _distinct(_grams(_opened(body), model.order))
                own = list(by_segment(hashes, segments))
                arrays = [pa.array([chunk] * len(own)), pa.array([k for k, _ in own]), pa.array([hashes[s].tobytes() for _, s in own])]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "segment", "hashes"])

    def answer(probes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if probes.empty:
            return pd.DataFrame(columns=["chunk", "segment", "levels"])
        bloom = Segment(np.frombuffer(own["filter"].iloc[0], "<u8") if len(own) else np.zeros(1, _U))
        hashes = np.frombuffer(b"".join(probes["hashes"]), "<u8")
        levels = b"".join(bloom.levels(hashes[i : i + (1 << 20)]).tobytes() for i in range(0, len(hashes), 1 << 20))
        ends = [0, *np.cumsum(probes["hashes"].str.len() // 8).tolist()]
        return pd.DataFrame({"chunk": probes["chunk"], "segment": probes["segment"], "levels": [levels[a:b] for a, b in pairwise(ends)]})

    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, math.ceil(tokens * model.order * 8 / segments / group_bytes))
    probes = chunks.select("chunk", "body").mapInArrow(tidy(ask), "chunk long, segment long, hashes binary")
    probes = probes.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
    dealt = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    answers = probes.groupBy("segment", "part").cogroup(dealt.groupBy("segment", "part")).applyInPandas(answer, "chunk long, segment long, levels binary")
    answers = stored(answers, "levels")
    gathered = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("segment", "levels"))).alias("levels")).select("chunk", F.col("levels.levels").alias("levels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        for batch in batches:
            for body, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = _opened(body)
                grams = list(_grams(texts, model.order))
                hashes, known = _distinct(grams), np.frombuffer(b"".join(levels), np.uint8)
                yield _scored(texts, grams, table, model, lambda h, hashes=hashes, known=known: known[np.searchsorted(hashes, h)])

    return chunks.join(gathered, "chunk").select("body", "levels").mapInArrow(tidy(run), _FIELDS)


def frequent_words(counts: DataFrame, words: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The words with the highest counts, at most `most` of them, and the others."""
    if words <= most:
        return counts, counts.limit(0)
    steps = counts.withColumn("step", F.floor(F.log2("count") * 8).cast("int"))
    room, least = most, None
    for r in steps.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 8 rows for each doubling of a count
        room -= r.n
        if room < 0:
            break
        least = r.step
    frequent = F.col("step") >= F.lit(least) if least is not None else F.lit(False)
    return steps.filter(frequent).drop("step"), steps.filter(~frequent).drop("step")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that end in it go with each job; they would else stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def score_texts(
    docs: DataFrame, order: int = 2, strength: float = 8.0, folds: int = 10, bits: int = 16, most_words: int = 1 << 20, most_bytes: int = 256 << 20, per_segment: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    order: longest n-grams; strength: weight of the lower order; per_segment: n-grams in the text for each segment.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).alias("text"))
    train = docs.filter(~held_out(F.col(id_col), folds)).select(F.col(text_col).alias("text"))
    with shuffles_freed(spark):
        counts = word_counts(train)
    tokens, words = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    frequent, others = frequent_words(counts, words, most_words)
    table = frequent.select("one", "two", "count").toArrow()  # most_words rows at most
    columns = [table.column(c).to_numpy() for c in ("one", "two", "count")]
    complete = words <= most_words
    shared_words = spark.sparkContext.broadcast(Words(columns[0].view(_U), columns[1].view(_U), columns[2], complete))
    segments = max(1, math.ceil(tokens * order / per_segment))
    with shuffles_freed(spark):
        filters = segment_filters(train, order, segments, bits)
    model = Model(tokens, words, order, strength)
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size + 24 * segments <= most_bytes:
        sizes = {r.segment: r.size // 8 for r in filters.select("segment", F.octet_length("filter").alias("size")).collect()}
        bloom = Filter(segments, sizes, ((r.segment, np.frombuffer(r.filter, "<u8")) for r in filters.toLocalIterator()))
        scored = score_here(rows, shared_words, model, spark.sparkContext.broadcast(bloom))
    else:
        with shuffles_freed(spark):
            scored = score_by_segments(rows, shared_words, model, filters, segments)
    if complete:
        out = scored.withColumn("base_score", F.col("base"))
    else:
        with shuffles_freed(spark):
            scored = stored(scored, "scored")
        lacking = scored.select("row", F.explode(F.arrays_zip("one", "two")).alias("w")).select("row", "w.one", "w.two")
        # A word that is not among the frequent ones holds less than one in most_words of all training tokens.
        found = lacking.join(others, ["one", "two"]).groupBy("row").agg(F.sum(F.log10((F.col("count") + 0.1) / F.lit(model.total))).alias("more"), F.count("*").alias("found"))
        out = scored.join(found, "row", "left").withColumn("found", F.coalesce("found", F.lit(0)))
        unknown = (F.size("one") - F.col("found")) * F.lit(math.log10(0.1 / model.total))
        out = out.withColumn("base_score", F.col("base") + F.coalesce("more", F.lit(0.0)) + unknown)
        out = out.withColumn("n_known", F.col("n_known") + F.col("found"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
