"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest. Full windows are sequences of their own. Rests are dealt into
groups of bounded size; in each group, differencing merges partial partitions with opposing imbalances until one
near-equal partition is left. Where a window of it exceeds the capacity, the number of windows rises and the group is
parted again.

Tokenizing: vocabulary, merges and added tokens are read from the tokenizer file. Pieces between spaces are tokenized
once per worker and remembered, because the byte-level pattern never joins characters over a space that follows a
non-space; where that doesn't hold, the whole text is tokenized. Texts that hold an added token of the file go through the
`tokenizers` library, as do all texts if the file is not of the plain byte-level form or its ids aren't in order of its
merges. Other pieces go through the file's vocabulary as ranks (tiktoken, half the time of the library on single
pieces), which gives the same ids; tests compare the two on any text.

Defined results: a null text is an empty one: it has the end id alone. Repeated rows are packed each for itself. Empty
input gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored, tidy

#: Fixed value: the pattern of byte-level pre-tokenizers, which tokenizer files name by their type only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 1

_BYTE_IDS: dict[str, ByteIds] = {}


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it shows, else one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteIds:
    """Ids of a byte-level tokenizer file, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, remember: int = 300_000) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.added = [x["content"] for x in parts.get("added_tokens") or []]
        self.plain = self._ranks(parts)
        self.seen: dict[str, bytes | None] = {}
        self.remember = remember

    @functools.cached_property
    def tokenizer(self):
        """The library's own, read when a text first needs it: a worker keeps it from then on."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _ranks(self, parts: dict):
        """A function from text to ids by the file's vocabulary as ranks; None where the file can't be used so."""
        import tiktoken

        model, first = parts["model"], parts.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        simple = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not parts.get("normalizer")
        if not simple or model.get("dropout") or model.get("ignore_merges") or ids != sorted(ids):
            return None
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> ByteIds:
        """One for each worker and file."""
        if path not in _BYTE_IDS:
            _BYTE_IDS[path] = cls(path)
        return _BYTE_IDS[path]

    def _pack(self, text: str) -> bytes:
        return np.array(self.plain(text), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and a piece; None where the space may belong to a longer run."""
        ids = None if not piece or piece[0].isspace() else self._pack(" " + piece)
        if len(self.seen) < self.remember:
            self.seen[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.plain is None or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *pieces = text.split(" ")
        seen, out = self.seen, [self._pack(first)]
        for p in pieces:
            ids = seen[p] if p in seen else self._piece(p)
            if ids is None:
                return self._pack(text)
            out.append(ids)
        return b"".join(out)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size: multiway differencing, largest imbalance first."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, int)
    nodes: list[tuple] = []  # (left, right, place of each slot after the merge)
    heap = []
    sums: list[np.ndarray | None] = []
    for i, s in enumerate(sizes):
        first = np.zeros(windows, np.int64)
        first[0] = s
        sums.append(first)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]  # the largest of one joins the smallest of the other
        order = np.argsort(-total, kind="stable")
        sums[a] = sums[b] = None
        total = total[order]
        total -= total[-1]
        place = np.empty(windows, np.int64)
        place[order] = np.arange(windows)
        nodes.append((a, b, place))
        sums.append(total)
        heapq.heappush(heap, (-int(total[0]), n + len(nodes) - 1))
    out = np.zeros(n, int)
    windows_of = {n + len(nodes) - 1: np.arange(windows)}
    for k in range(len(nodes) - 1, -1, -1):
        a, b, place = nodes[k]
        at = windows_of.pop(n + k)[place]
        for child, its in ((a, at), (b, at[::-1])):
            if child < n:
                out[child] = its[0]
            else:
                windows_of[child] = its
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none over capacity; no size may exceed it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        most = int(np.bincount(at, sizes, windows).max())
        if most <= capacity:
            return at
        windows = max(windows + 1, int(windows * (1 + 0.25 * (most / capacity - 1))))


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, rest: int = 256, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, source_col: str | None = None) -> DataFrame:
    """Tokenize and cut: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids as bytes and the source.

    Windows of `window` ids, then pieces of at most `rest` ids: short pieces level windows better.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long")]
    fields += [("ids", "binary")] * with_ids + [("source", "string")] * bool(source_col)
    schema, names = ", ".join(f"{n} {t}" for n, t in fields), [n for n, _ in fields]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = ByteIds.of(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            sources = batch.column(2).to_pylist()
            for doc_id, text, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sources, strict=True):
                ids = tokens(text or "") + end
                n = len(ids) // 4
                full = n - n % window
                starts = [*range(0, full, window), *range(full, n, rest)]
                for start, stop in zip(starts, [*starts[1:], n], strict=True):
                    part = ids[4 * start : 4 * stop]
                    out.append((doc_id, start, stop - start, zlib.crc32(part), n, *[part] * with_ids, *[source] * bool(source_col)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(fields)], names)

    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), source.alias("source")).mapInArrow(tidy(run), schema)


def pack(pieces: DataFrame, window: int = 2048, group: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces. group: about how many short pieces are parted at once."""
    pieces = stored(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == window)
    full = full.withColumn("sequence_id", F.col("_piece") * 2).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < window)
    groups = max(1, round(short.count() / group))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_piece", ignore_index=True)
        at = pack_sizes(rows["length"].to_numpy(), window)
        first = rows["_piece"].groupby(at).transform("min")
        rows["sequence_id"] = first * 2 + 1
        rows["offset"] = rows["length"].groupby(at).cumsum() - rows["length"]
        return rows[["_piece", "sequence_id", "offset"]]

    parted = short.select("_piece", "length", F.pmod(F.xxhash64("_piece"), F.lit(groups)).alias("_group"))
    parted = parted.groupBy("_group").applyInPandas(part, "_piece long, sequence_id long, offset long")
    return full.unionByName(short.join(parted, "_piece")).drop("_piece")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, source_col: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Asked for, also their ids, of which `sequences` makes the windows, and their document's source.
    """
    return pack(cut_pieces(docs, tokenizer, window, id_col=id_col, text_col=text_col, with_ids=with_ids, source_col=source_col), window)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each window, from pieces packed with their ids. A window's pieces fit its length."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
