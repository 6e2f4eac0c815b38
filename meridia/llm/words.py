"""Words of many texts at once, as 64-bit hashes in numpy.

The texts of a batch are laid into one buffer. A word's hash is a difference of
prefix sums of byte * power, brought to one power and mixed, so no Python runs per
word. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)
_kept = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, of: int = int(_P)) -> np.ndarray:
    """of^0 .. of^(n-1); kept, and made longer when need be."""
    had = _kept.get(of, ())
    if len(had) < n:
        more = np.full(max(n, 2 * len(had)), of, np.uint64)
        more[0] = 1
        _kept[of] = had = np.multiply.accumulate(more)
    return had[:n]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of buffer[start:end] for each span; equal bytes give equal hashes."""
    p, back = powers(len(buffer)), powers(len(buffer) + 1, pow(int(_P), -1, 1 << 64))
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[buffer] * p, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def batches(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes each, or of one longer text, with the number of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def spaced_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the texts, in order, and at i the number of words before text i (one more at the end)."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate(([False], ~_SPACE[buffer]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return span_hashes(buffer, starts, ends), np.searchsorted(starts, begin)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles as hashes; of a text with fewer words the whole sequence; empty without words.

    Texts are to be lower-cased already.
    """
    for _, part in batches(texts):
        words, before = spaced_words(part)
        n = len(words)
        grams = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            grams = grams * _P + words[j : n - k + 1 + j] if n >= k else grams
        grams = mix(grams)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    h = h * _P + w
                yield mix(h ^ np.uint64(0x5BF03635))
            else:
                yield np.zeros(0, np.uint64)
