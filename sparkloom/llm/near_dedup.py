"""MinHash near-deduplication: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Each document becomes the set of its hashed word shingles, a digest of that set, and one key for each band of its
   one-permutation signature. Documents with equal sets are one node from here on.
2. In each bucket (band, key) one member is the centre; candidate edges go from the centre to the others, so a bucket
   gives fewer edges than it has members. Candidates are confirmed on full sets and joined into components.
3. A bucket whose members still are in several components may hide links between members that aren't its centre. The
   members of all such buckets are searched exactly: each set's hashes are put in one order, rare ones first (by counts
   of ranges of hash values: a table of fixed size, the only thing that goes through the driver), and of two similar
   sets the first hash they share must come early in both, the earlier the more their sizes differ. Sets that meet at
   such a hash are held against each other in bounded pieces, of which only links that join two components are given
   out. Texts that share long passages but are not similar don't meet, as the passages' hashes come late.

So no pair that shares a bucket is left out, and no step emits the pairs of a group. The bands follow from the threshold
(`banding`; 30 of 6 values at 0.85), so that a pair at the threshold shares no bucket with a probability below 1e-6.
Sets are computed once more for one row of each node that shares a bucket, and shipped as sorted 64-bit hashes; a centre
with many candidates is dealt out in several copies. Joins on keys that may be hot are spread (`shared.spread_join`).

Defined results: a null text is an empty one; texts without words link to nothing; texts with fewer words than a shingle
has are one shingle; a null id is reported as null and counts as larger than any other; an empty table gives an empty
result. In near_groups rows that repeat an id (not null) are one document: the id links them, so they share one
component. In near_dedup they are documents of their own, and of each component the rows stay that equal its first one
(smallest id, null last, then text hash) in id and text.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import components
from .shared import discard, small_batches, spread_join, stored, tidy

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


_BASE = 0x5851F42D4C957F2D
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base)], dtype=np.uint64)
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, inverse)], dtype=np.uint64)


_POWERS = _Powers()


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower: A-Z only
    white = np.concatenate(([True], _IS_WHITE[raw], [True]))
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    _POWERS.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POWERS.up[: len(raw)], out=sums[1:])
    w = _mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))
    n = len(w) - words + 1
    if n < 1:
        h = np.uint64(len(w))
        for x in w:
            h = _mix(np.array([h], np.uint64) * np.uint64(_BASE) + x)[0]
        return np.array([h], np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = h * np.uint64(_BASE) + w[j : j + n]
    return np.unique(_mix(h))


class Signer:
    """Band keys of a set by one-permutation hashing; empty bins borrow from bins that a fixed hash names."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        self.bands, self.rows, k = bands, rows, bands * rows
        self.bounds = np.array([(j << 64) // k for j in range(k)], np.uint64)
        self.donors = np.random.default_rng(seed).integers(0, k, (k, 32 * 16))
        self.factors = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band = _mix(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.bounds)
        filled = np.append(at[1:], len(hashes)) > at
        values = hashes[np.minimum(at, len(hashes) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            donor = np.full(len(empty), -1)
            for t in range(0, self.donors.shape[1], 32):
                todo = np.flatnonzero(donor < 0)
                if not len(todo):
                    break
                tried = self.donors[empty[todo], t : t + 32]
                hit = filled[tried]
                donor[todo] = np.where(hit.any(1), tried[np.arange(len(todo)), hit.argmax(1)], -1)
            donor[donor < 0] = np.flatnonzero(filled)[0]
            values[empty] = values[donor]
        rows = values.reshape(self.bands, self.rows)
        return _mix((rows * self.factors).sum(1, dtype=np.uint64) ^ self.band).view(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands, and values a band, at which a pair at the threshold shares no band with a probability below 1e-6."""
    for rows in range(6, 0, -1):
        same = min(percent / 100, 0.99) ** rows
        bands = max(30, math.ceil(math.log(1e-6) / math.log1p(-same)))
        if bands <= 40:
            break
    return bands, rows


def similar(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_shingles, node (digest of the set; a row's own where it is empty), keys (null where it is empty), text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            places, sizes, nodes, keys = batch.column(3).to_pylist(), [], [], []
            for place, text in zip(places, batch.column(1).to_pylist(), strict=True):
                found = shingles(text or "", words)
                sizes.append(len(found))
                nodes.append(digest(found) if len(found) else hashlib.blake2b(f"empty {place}".encode(), digest_size=16).digest())
                keys.append(signer(found) if len(found) else None)
            arrays = [batch.column(3), batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_shingles", "node", "keys", "text_hash"])

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    return rows_.mapInArrow(tidy(run), "row long, doc_id long, n_shingles long, node binary, keys array<long>, text_hash long")


def node_sets(docs: DataFrame, wanted: DataFrame, words: int, text_col: str, remember: int = 200_000) -> DataFrame:
    """node, set: sorted hashes of each wanted node (node, text_hash: the hash of one of its texts).

    Copies of a text leave a task once (as long as it remembers them), and hashes that agree by chance are told apart by
    the digest of the set.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > remember:
                seen.clear()
            new = []
            for h in batch.column(0).to_pylist():
                new.append(h not in seen)
                seen.add(h)
            yield batch.filter(pa.array(new, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(1).to_pylist()]
            same = pa.array([digest(f) == n for f, n in zip(found, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), pa.array([f.tobytes() for f in found], pa.binary()).filter(same)], ["node", "set"])

    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.mapInArrow(tidy(first), "text_hash long, text string").join(wanted, "text_hash").select("node", "text")
    return stored(texts.mapInArrow(tidy(run), "node binary, set binary").dropDuplicates(["node"]), "sets")


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, copies: int = 256) -> DataFrame:
    """The pairs u, v whose sets are similar, of pairs centre, node, count (how many nodes their largest bucket has).

    A centre's set is dealt out in a copy for every `copies` members of its largest bucket; a node has no more centres
    than there are bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ours = None, None
        for batch in batches:
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i in range(len(u)):
                if u[i] != last:
                    last, ours = u[i], _set(a[i])
                other = _set(b[i])
                at = np.searchsorted(ours, other)
                common = int((ours[np.minimum(at, len(ours) - 1)] == other).sum())
                good.append(similar(len(ours), len(other), common, percent))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    parts = F.ceil(F.col("count") / copies).cast("int")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    centres = pairs.groupBy("centre").agg(F.max(parts).alias("parts"))
    centres = centres.join(sets.withColumnsRenamed({"node": "centre", "set": "a"}), "centre").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = pairs.join(sets.withColumnRenamed("set", "b"), "node").join(centres, ["centre", "part"])
    rows = rows.select(F.col("centre").alias("u"), F.col("node").alias("v"), "a", "b").sortWithinPartitions("u")
    return rows.mapInArrow(tidy(run), "u binary, v binary")


def _common(sets: list[np.ndarray], rare: int = 8, width: int = 1024) -> np.ndarray:
    """How many hashes each pair of sets shares (above the diagonal): rare ones pair by pair, others as products."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    uses = np.diff(np.r_[start, len(flat)])
    out = np.zeros((n, n), np.float32)
    for u in range(2, rare + 1):
        at = start[uses == u]
        for i in range(u if len(at) else 0):
            for j in range(i + 1, u):  # rows of a hash ascend
                np.add.at(out, (row[at + i], row[at + j]), 1)
    often = np.flatnonzero(uses > rare)
    for k in range(0, len(often), width):
        here = often[k : k + width]
        member = np.repeat(start[here] - np.r_[0, np.cumsum(uses[here])[:-1]], uses[here]) + np.arange(uses[here].sum())
        part = np.zeros((n, len(here)), np.float32)
        part[row[member], np.repeat(np.arange(len(here)), uses[here])] = 1
        out += part @ part.T
    return np.triu(out, 1)


def _links_of_block(names: list[bytes], comps: list[bytes], halves: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of different components; where there are two halves, between them only. A spanning set."""
    sizes = np.array([len(s) for s in sets])
    common = _common(sets)
    union = sizes[:, None] + sizes[None, :] - common
    comp, half = np.unique(comps, return_inverse=True)[1], np.array(halves)
    good = (100 * common >= percent * union) & (common > 0) & (comp[:, None] != comp[None, :])
    if half.any() and not half.all():
        good &= half[:, None] != half[None, :]
    root = {c: c for c in comps}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
        x, y = find(comps[a]), find(comps[b])
        if x != y:
            root[x] = y
            out.append((names[a], names[b]))
    return out


def _ranks(sets: DataFrame, cells: int = 1 << 20) -> np.ndarray:
    """How often hashes fall in each of `cells` ranges of hash values, in quarters of powers of two: one byte a range."""
    shift = np.uint64(65 - cells.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        for batch in batches:
            seen += np.bincount((_set(b"".join(batch.column(0).to_pylist())) >> shift).astype(np.int64), minlength=cells)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "uses"])

    found = sets.select("set").mapInArrow(tidy(run), "cell long, uses long").groupBy("cell").agg(F.sum("uses").alias("uses")).toArrow()
    ranks = np.zeros(cells, np.uint8)
    ranks[found["cell"].to_numpy()] = 4 * np.log2(1 + found["uses"].to_numpy())
    return ranks


def _leading(n: int, percent: int) -> tuple[np.ndarray, int]:
    """For a set of n hashes in an order that all sets share: the largest set it can be similar to if the first common
    hash is its p-th, for each p where there is one; and the smallest one.

    From there on n - p hashes are left, so (100 + percent) * (n - p) >= percent * (n + m) bounds m.
    """
    least = -(-percent * n // 100)
    left = n - np.arange(n - least + 1)
    return left * (100 + percent) // percent - n, least


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int, ranks: np.ndarray) -> DataFrame:
    """hash, node, comp, n, cls, low, high: the rarest hashes of each node, and which classes of sizes it may meet there.

    Of two similar sets, both have the rarest hash they share among these, each in the other's classes. A class holds
    the sizes within a fourth of the way (in logarithms) to the smallest size that can be similar.
    """
    shift, wide = np.uint64(65 - len(ranks).bit_length()), -math.log(min(percent, 99) / 100) / 4
    classes = lambda sizes: np.floor(np.log(sizes) / wide).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, sizes, low, high = [], [], [], [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                found = _set(raw)
                most, least = _leading(len(found), percent)
                hashes.append(found[np.argsort(ranks[found >> shift], kind="stable")[: len(most)]])
                at.append(np.full(len(most), i))
                sizes.append(np.full(len(most), len(found)))
                low.append(np.full(len(most), least))
                high.append(most)
            if not at:
                continue
            at, n = np.concatenate(at), np.concatenate(sizes)
            columns = [pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(n)]
            columns += [pa.array(classes(x)) for x in (n, np.concatenate(low), np.concatenate(high))]
            out = pa.RecordBatch.from_arrays(columns, ["hash", "node", "comp", "n", "cls", "low", "high"])
            for k in range(0, len(at), 50_000):
                yield out.slice(k, 50_000)

    return nodes.join(sets, "node").select("node", "comp", "set").mapInArrow(tidy(run), "hash long, node binary, comp binary, n long, cls int, low int, high int")


def _search(nodes: DataFrame, sets: DataFrame, percent: int, block: int, hashes: int = 1 << 18) -> DataFrame:
    """Links u, v between the nodes (node, comp) of different components, as many as span what the components make.

    Nodes meet at hashes that are among the rarest of both (`_prefixes`), by pairs of size classes c <= d. What meets
    there holds full sets against each other in pieces of `block` sets of a class and `hashes` hashes at most (two sets
    at least). Meetings of one component, or of the same nodes as another, are left out.
    """
    wide = -math.log(min(percent, 99) / 100) / 4
    entries = stored(_prefixes(nodes, sets, percent, _ranks(sets)), "prefixes")
    total = entries.count()
    ends = [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    uses = entries.groupBy("hash").agg(F.count("*").alias("uses"), *ends).filter("lo <> hi").select("hash", "uses")
    rows = spread_join(entries, uses, ["hash"], "uses", total, ["node"]).withColumn("other", F.explode(F.sequence("low", "high")))
    rows = rows.select("hash", F.least("cls", "other").alias("c"), F.greatest("cls", "other").alias("d"), (F.col("cls") > F.col("other")).alias("second"), "node", "comp", "n")
    meetings = stored(rows, "meetings")
    discard(entries)
    total, second = meetings.count(), F.col("second")
    alike = [F.sum((~second).cast("long")).alias("firsts"), F.sum(second.cast("long")).alias("seconds"), F.sum("n").alias("weight"), *(F.bit_xor(F.xxhash64(F.lit(seed), "second", "node")).alias(f"h{seed}") for seed in (1, 2))]
    groups = meetings.groupBy("hash", "c", "d").agg(*alike, *ends).filter("lo <> hi and (c = d or firsts > 0 and seconds > 0)")
    groups = groups.groupBy("c", "d", "firsts", "seconds", "weight", "h1", "h2").agg(F.min("hash").alias("hash")).withColumn("held", F.col("firsts") + F.col("seconds"))
    small = (F.col("held") <= block) & (F.col("weight") <= hashes)
    most = lambda cls: F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(float(hashes)) / F.exp((F.col(cls) + 1) * F.lit(wide)))))
    blocks = lambda held, cls: F.when(small, 1).otherwise(F.ceil(F.col(held) / most(cls))).cast("int")
    same = F.col("c") == F.col("d")
    groups = groups.select("hash", "c", "d", "held", blocks("firsts", "c").alias("ours"), F.when(same, blocks("firsts", "c")).otherwise(blocks("seconds", "d")).alias("theirs"))
    rows = spread_join(meetings, groups, ["hash", "c", "d"], "held", total, ["node"])
    half = F.pmod(F.xxhash64("node"), F.when(second, F.col("theirs")).otherwise(F.col("ours"))).cast("int")
    rows = rows.withColumn("half", half)
    work = lambda i, j, late: F.struct(i.alias("i"), j.alias("j"), late.alias("second"))
    mine, upto = F.col("half"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    within = F.transform(upto("ours"), lambda j: work(F.least(mine, j), F.greatest(mine, j), mine > j))
    across = F.transform(F.when(second, upto("ours")).otherwise(upto("theirs")), lambda j: work(F.when(second, j).otherwise(mine), F.when(second, mine).otherwise(j), second))
    rows = rows.select("hash", "c", "d", "node", "comp", F.explode(F.when(same, within).otherwise(across)).alias("w"))
    rows = rows.select("node", "comp", F.concat_ws(":", "hash", "c", "d", "w.i", "w.j").alias("work"), F.col("w.second").alias("second"))
    rows = rows.join(sets, "node").select("work", "node", "comp", "second", "set")
    rows = rows.repartition("work").sortWithinPartitions("work")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links() -> list[tuple[bytes, bytes]]:
            if len(held) < 2:
                return []
            _, names, comps, halves, body = zip(*held, strict=True)
            _, c, d, i, j = held[0][0].split(":")
            if len(set(comps)) < 2 or ((c, i) != (d, j) and len(set(halves)) < 2):
                return []
            return _links_of_block(list(names), list(comps), list(halves), [_set(x) for x in body], percent)

        def batch_of(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    found += links()
                    held = []
                held.append(r)
            yield batch_of(found)
        yield batch_of(links())

    links_ = stored(rows.mapInArrow(tidy(run), "u binary, v binary"), "more")
    discard(meetings)
    return links_


def near_groups(docs: DataFrame, percent: int = 85, words: int = 5, bands: int | None = None, rows: int | None = None, block: int = 512, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, text_hash, first (doc_id and text_hash of its component's first row)."""
    small_batches(docs.sparkSession)
    if bands is None or rows is None:
        bands, rows = banding(percent)
    signed = stored(signatures(docs, words, bands, rows, id_col, text_col), "signed")
    total = signed.count()
    heads = signed.filter("keys is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash"))
    heads = stored(heads, "heads")
    entries = heads.select("node", "n", F.posexplode("keys").alias("band", "key"))
    head = F.struct(F.xxhash64("band", "node").alias("order"), "node", "n")
    buckets = entries.groupBy("band", "key").agg(F.count("*").alias("count"), F.min(head).alias("centre")).filter("count > 1")
    members = stored(spread_join(entries, buckets, ["band", "key"], "count", total * bands, ["node"]), "members")
    fit = F.lit(100) * F.least("n", "centre.n") >= F.lit(percent) * F.greatest("n", "centre.n")
    stars = members.filter((F.col("node") != F.col("centre.node")) & fit)
    pairs = stars.groupBy(F.col("centre.node").alias("centre"), "node").agg(F.max("count").alias("count"))
    sets = node_sets(docs, heads.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_hash"), words, text_col)
    links = stored(_confirm(pairs, sets, percent), "links")
    roots = components(links)
    # Nodes of buckets whose members are in several components.
    placed = stored(members.filter("count > 2").join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("comp")), "placed")
    mixed = placed.groupBy("band", "key").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    open_ = stored(spread_join(placed, mixed.select("band", "key", "held"), ["band", "key"], "held", total * bands, ["node"]).select("node", "comp").distinct(), "open")
    discard(heads, members, links, placed)
    found, spent = [], [sets, open_]
    if not open_.isEmpty():
        found.append(_search(open_, sets, percent, block))
    if by_id:  # the least node of an id that repeats with its others
        twice = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("uses")).filter("u <> v")
        twice = stored(twice.drop("v"), "twice")
        spent.append(twice)
        if not twice.isEmpty():
            same = spread_join(signed.select("doc_id", "node", "row"), twice, ["doc_id"], "uses", total, ["row"]).filter("node <> u")
            found.append(same.select("u", F.col("node").alias("v")).distinct())
    spent += found
    found = [x for x in found if not x.isEmpty()]
    if found:
        linked = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(functools.reduce(DataFrame.unionByName, found, linked))
    discard(*spent)  # the result reads signed, roots and nodes
    # The first row of each component, for the nodes that are in one with others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(signed.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("uses")), "nodes")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes"))
    named = spread_join(linked.select("node", "root"), least, ["root"], "nodes", total, ["node"]).select("node", "least")
    named = nodes.join(named, "node", "left").select("node", "uses", F.coalesce("least", "first").alias("least"))
    out = spread_join(signed.drop("keys"), named, ["node"], "uses", total, ["row"])
    component = F.col("least.doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash",
        F.struct("least.doc_id", "least.text_hash").alias("first"),
    )


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of each component the first row, with those that equal it."""
    at = [f"_c{i}" for i in range(len(docs.columns))]
    body = docs.toDF(*at)
    row_id, text = (F.col(at[docs.columns.index(c)]) for c in (id_col, text_col))
    groups = near_groups(docs, percent, id_col=id_col, text_col=text_col, by_id=False, **how)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    gone = groups.filter(~stays).select("doc_id", "text_hash").distinct()
    kept = body.join(gone, row_id.cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash")), "left_anti")
    return kept.toDF(*docs.columns)
