"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In each step every sequence's lowest-rank pair is
merged in all sequences at once; a sequence without a known pair is done and its symbols are counted. A pair made by a
merge always has a higher rank than that merge, so merging all places of the lowest pair at once is what merging them
one by one gives.

Libraries differ in their tables of letters and digits. So each character beyond ASCII is tried once in a worker: if the
`tokenizers` library normalizes or splits short texts with it otherwise, texts that hold it are counted by that library.

Defined results: a null text is empty and has no tokens; strings of special tokens count as one token each wherever
they stand, as the tokenizer file has them; texts of any length are counted whole; other columns are ignored, whatever
their names; repeated rows each get their count; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

_NONE = np.iinfo(np.int64).max
_COUNTERS: dict[str, TokenCounter] = {}


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the others from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class TokenCounter:
    """Counts tokens of a BPE file whose words end in a suffix and whose pre-tokens never hold white space."""

    def __init__(self, path: str, remember: int = 500_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [(vocab[a] * self.size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])]
        pairs = np.array(sorted(merges), np.int64)
        self.pairs, self.ranks, self.made = pairs[:, 0].copy(), np.append(pairs[:, 1], _NONE), pairs[:, 2].copy()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.seen: dict[str, int] = {}
        self.remember = remember
        self.path, self._library = path, None
        self.tried: set[str] = {chr(i) for i in range(128)}
        self.odd_ones: set[str] = set()

    @property
    def library(self):
        """The library's tokenizer of the same file, for the characters that it takes otherwise."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _try(self, chars: set[str]) -> None:
        """Find out which characters the library normalizes or splits otherwise: after a letter, after a sign, and doubled."""
        self.tried |= chars
        for c in chars:
            for text in (f"a{c}", f"!{c}", f"{c}{c}"):
                own, theirs = self.spaces.sub(" ", self._normal(text)), self.library.normalizer.normalize_str(text)
                if own != theirs or len(self.split.findall(own)) != len(self.library.pre_tokenizer.pre_tokenize_str(theirs)):
                    self.odd_ones.add(c)

    @staticmethod
    def _normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # lower() alone would look at a sigma's place

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """One for each worker and file."""
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(path)
        return _COUNTERS[path]

    def merged(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols of each pre-token once no pair is left."""
        raw = [t.encode() for t in tokens]
        lengths = np.array([len(r) for r in raw])
        counts = lengths.copy()
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        seq = np.repeat(np.arange(len(raw)), lengths)
        while len(symbols) > 1:
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            known = (self.pairs[at] == keys) & (seq[:-1] == seq[1:])
            ranks = np.where(known, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(np.append(ranks, _NONE), starts)  # the last symbol of a sequence has no pair
            sizes = np.diff(np.append(starts, len(seq)))
            here = known & (ranks == np.repeat(lowest, sizes)[:-1])
            # Of places that overlap (a run of one symbol), every second is merged, from the left.
            run = here & np.r_[False, here[:-1] & (keys[1:] == keys[:-1])]
            if run.any():
                index = np.arange(len(here))
                begin = np.maximum.accumulate(np.where(here & ~run, index, 0))
                here &= ~(run & ((index - begin) % 2 == 1))
            places = np.flatnonzero(here)
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            counts -= np.bincount(seq[places], minlength=len(counts))
            keep &= np.repeat(lowest != _NONE, sizes)
            symbols, seq = symbols[keep], seq[keep]
        return counts

    def _learn(self, chunks: set[str]) -> dict[str, int]:
        names = list(chunks)
        parts = [self.split.findall(c) for c in names]
        unique = list({t for p in parts for t in p})
        counts = dict(zip(unique, self.merged(unique).tolist(), strict=True)) if unique else {}
        return {c: sum(counts[t] for t in p) for c, p in zip(names, parts, strict=True)}

    def __call__(self, texts: list[str]) -> list[int]:
        chars = [set() if t.isascii() else set(t) for t in texts]
        new = set().union(*chars) - self.tried
        if new:
            self._try(new)
        if not self.odd_ones:
            return self._own(texts)
        odd = [not self.odd_ones.isdisjoint(c) for c in chars]
        own = iter(self._own([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [self._by_library(t) if o else next(own) for t, o in zip(texts, odd, strict=True)]

    def _own(self, texts: list[str]) -> list[int]:
        extra, chunked = [], []
        for text in texts:
            found = 0
            if "<|" in text:
                for s in self.special:
                    found += text.count(s)
                    text = text.replace(s, " ")
            text = text.lower() if text.isascii() else self._normal(text)
            chunked.append(self.spaces.split(text) if self.odd.search(text) else text.split())
            extra.append(found)
        new = {c for chunks in chunked for c in chunks}
        new.difference_update(self.seen)
        learned = self._learn(new)
        if len(self.seen) + len(learned) > self.remember:
            self.seen = {c: self.seen[c] for chunks in chunked for c in chunks if c in self.seen}
        self.seen.update(learned)
        get = self.seen.__getitem__
        return [n + sum(map(get, chunks)) for n, chunks in zip(extra, chunked, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(path)
        for batch in batches:
            counts = counter([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
