"""Vectorised polynomial (Rabin-Karp) hashes of byte and word spans, modulo 2^64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: words are runs of bytes other than these
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PIECE_BYTES = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); the array is kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that their top bits can deal them out."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(BASE, len(values))
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [first, end), equal for equal content wherever it stands."""
    return mix((prefix[end] - prefix[first]) * powers(INVERSE, len(prefix))[first])


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of ``width`` values."""
    n = max(0, len(prefix) - width)
    return mix((prefix[width:] - prefix[:n]) * powers(INVERSE, len(prefix))[:n])


def batches(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of texts of about ``limit`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts in turn, number of words of each text)."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for first, end in batches(texts):
        buf = np.frombuffer(b"\n".join(texts[first:end]) + b"\n", np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        hashes.append(span_hash(prefix_hash(buf), starts, ends))
        stops = np.cumsum([len(t) + 1 for t in texts[first:end]])
        counts[first:end] = np.diff(np.searchsorted(starts, stops), prepend=0)
    return np.concatenate(hashes), counts
