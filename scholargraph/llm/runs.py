"""Runs of word bytes in a column of texts, as 64-bit hashes.

The texts of an Arrow batch lie behind each other in one buffer; runs are found
and hashed for a piece of that buffer at a time, whatever the texts' lengths,
with a few passes over the bytes and no call per run.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from scholargraph.llm.words import _BASE, _powers, mix

#: Bytes looked at together.
PIECE = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_TERM = _LETTER.copy()
_TERM[ord("0") : ord("9") + 1] = _TERM[0x80:] = True
#: Bytes at which a text may be cut: they are in no run of either kind.
_CUT = ~_TERM


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 80 to C3 BF)."""
    lead = data == 0xC3
    after = np.concatenate(([False], lead[:-1]))
    return _LETTER[data] | lead | after


def terms(data: np.ndarray) -> np.ndarray:
    """Bytes of letters, digits and everything beyond ASCII."""
    return _TERM[data]


class Runs(NamedTuple):
    data: np.ndarray  #: bytes of the piece, A-Z in lower case
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray  #: for every run, its text's place in the column


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and the bounds of its texts."""
    column = column.cast(pa.binary()).cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def _stop(data: np.ndarray, bounds: np.ndarray, at: int, end: int) -> int:
    """Where the piece from ``at`` ends: behind a byte that is in no run, or at the end of a text."""
    if end - at <= PIECE:
        return end
    cuts = np.flatnonzero(_CUT[data[at : at + PIECE]])
    text_end = int(bounds[np.searchsorted(bounds, at + PIECE, "right") - 1])
    if len(cuts) or text_end > at:
        return max(text_end, at + int(cuts[-1]) + 1 if len(cuts) else at)
    limit = int(bounds[np.searchsorted(bounds, at + PIECE, "left")])  # a run longer than a piece
    for low in range(at + PIECE, limit, PIECE):
        cuts = np.flatnonzero(_CUT[data[low : min(limit, low + PIECE)]])
        if len(cuts):
            return low + int(cuts[0]) + 1
    return limit


def hashed_runs(column: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[Runs]:
    """The runs of bytes that are ``inside``, piece by piece. Only A-Z are
    lower-cased. Equal runs have equal hashes; two different ones of 64 bits
    agree with a chance of about 2**-64."""
    data, bounds = _texts(column)
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        stop = _stop(data, bounds, at, end)
        piece = LOWER[data[at:stop]]
        first = np.zeros(len(piece) + 1, bool)  # a text begins here
        own = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop, "right")] - at
        first[own] = True
        mask = np.concatenate(([False], inside(piece), [False]))
        starts = np.flatnonzero(mask[1:] & (~mask[:-1] | first))
        ends = np.flatnonzero(mask[:-1] & (~mask[1:] | first))
        powers, inverse = _powers(max(10, int(len(piece)).bit_length()))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        yield Runs(piece, starts, ends, hashes, np.searchsorted(bounds, starts + at, "right") - 1)
        at = stop


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of ``data`` as an array of strings."""
    sizes = ends - starts
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    picked = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(picked)).cast(pa.string())


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else order
