"""Words of a text as 64-bit hashes, a whole text at a time.

A word is a run of bytes outside the blanks [\\x20\\x09-\\x0D]; its hash is a
polynomial over its bytes, read off prefix sums of the text, so the cost is a
few passes over the bytes and no call per word.
"""
from __future__ import annotations

import functools

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed in blocks of about so many bytes, cut at a blank.
BLOCK = 1 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=None)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base and of its inverse modulo 2**64."""
    n, out = 1 << bits, []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base & _MASK, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    word = np.concatenate(([False], ~_IS_BLANK[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(data)
    powers, inverse = _powers(max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and hashes of the words of ``text``."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= BLOCK:
        return _hash_block(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):  # go on to the next blank
            rest = _IS_BLANK[data[end : end + BLOCK]]
            while not rest.any() and end < len(data):
                end += len(rest)
                rest = _IS_BLANK[data[end : end + BLOCK]]
            end = end + int(rest.argmax()) if rest.any() else len(data)
        s, e, h = _hash_block(data[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; of the whole sequence if it
    is shorter; none without words."""
    if not len(words):
        return words
    n, size = (len(words) - k + 1, k) if len(words) >= k else (1, len(words))
    # the length of the run goes in, so a short sequence equals no full run
    h = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(_BASE) + words[i : i + n]
    return mix(h)


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case, other bytes as they are."""
    return text.lower()
