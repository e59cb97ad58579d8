"""Hashed character n-grams of whole texts, and a logistic fit on bounded samples."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def characters(text: str, letters_only: bool = True) -> np.ndarray:
    """Code points of the lower-cased text between spaces; what isn't a letter counts as a space, if asked for."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    if letters_only:
        other = ~(((codes >= 97) & (codes <= 122)) | (codes >= 0xAA))
        codes[other] = 32
        codes = codes[np.r_[True, ~(other[1:] & other[:-1])]]  # runs of spaces are one
    return codes


def hashed(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets (of 2**bits) of all n-grams of the given orders, repeats included."""
    out, h = [], np.zeros(len(codes), np.uint64)
    down = np.uint64(64 - bits)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * _STEP + codes[n - 1 :]) if n > 1 else codes.copy()
        if n in orders:
            x = (h ^ (h >> _SHIFT)) * _MIX
            out.append(((x ^ (x >> _SHIFT)) * _STEP >> down).astype(np.int32))
        h = h[: len(codes) - n] if len(codes) > n else h[:0]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def present(text: str, orders: tuple[int, ...], bits: int, table: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text with its digits and signs; with a table (bucket to feature, -1 for none), its distinct features."""
    buckets = hashed(characters(text, letters_only=False), orders, bits)
    if table is None:
        seen = np.zeros(1 << bits, bool)
        seen[buckets] = True
        return np.flatnonzero(seen)
    found = table[buckets]
    return np.unique(found[found >= 0])


def fit_logistic(flat: np.ndarray, sizes: np.ndarray, scales: np.ndarray, labels: np.ndarray, ridge: float = 1e-5, steps: int = 60, piece: int = 1 << 22) -> tuple[np.ndarray, float]:
    """Weights and bias over features that a row has (1) or hasn't (0), each scaled. Limited-memory BFGS.

    flat: the rows' features end to end; sizes: how many each row has. Beside them it holds vectors of as many places as
    there are features, and `piece` values (or a row's) at a time.
    """
    n, k = len(labels), len(scales)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + piece, "right")) - 1))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        u, g, total, bias = scales * x[:k], np.zeros(k), 0.0, 0.0
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = flat[ends[a] : ends[b]]
            z, some = np.full(b - a, x[k]), sizes[a:b] > 0
            if some.any():
                z[some] += np.add.reduceat(u[here], (ends[a:b] - ends[a])[some])
            rest = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[a:b]) / n
            g += np.bincount(here, np.repeat(rest, sizes[a:b]), k)
            bias += rest.sum()
            total += np.logaddexp(0, np.where(labels[a:b] == 1, -z, z)).sum() / n
        return float(total + ridge / 2 * (x[:k] ** 2).sum()), np.append(scales * g + ridge * x[:k], bias)

    share = min(max(float(labels.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    x = np.zeros(k + 1)
    x[k] = np.log(share / (1 - share))
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ d))
            d = d - kept[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d = d + (a - r * (y @ d)) * s
        slope, t = float(g @ d), 1.0 if past else 1.0 / max(1.0, float(np.abs(g).sum()))
        if slope > -1e-12:
            break
        while True:
            new, h = loss(x + t * d)
            if new <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = t * d, h - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        done = abs(f - new) < 1e-8
        x, f, g = x + s, new, h
        if done:
            break
    return x[:k], float(x[k])
