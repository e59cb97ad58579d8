"""Vectors of texts by feature hashing: the same text gives the same vector everywhere, and no model is needed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """Counts of words and of pairs of words in hashed places, with hashed signs, to length 1 (0 for blank texts)."""
    words = [w.encode() for w in _WORD.findall(text.lower())]
    hashes = np.array([crc32(w) for w in words] + [crc32(a + b" " + b) for a, b in zip(words, words[1:])], np.uint64)
    out = np.zeros(dim, np.float64)
    np.add.at(out, (hashes % np.uint64(dim)).astype(int), np.where(hashes >> np.uint64(31), 1.0, -1.0))
    length = np.sqrt((out**2).sum())
    return (out / length if length else out).astype(np.float32)


def embed(text: Column, dim: int = 768) -> Column:
    """array<float> of `dim` numbers. Another model can take this function's place: a Series of texts in, vectors out."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hashed_vector(t or "", dim) for t in batch])

    return run(text)
