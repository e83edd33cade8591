"""Packing token pieces into sequences: large-item matching, then best fit.

Piece lengths are whole numbers up to the capacity, so the packing of any
number of pieces is a function of one histogram with at most ``capacity``
entries. The histogram is counted by Spark, the plan (which lengths share a
bin, and how many such bins) is made from it, and every piece finds its place
from its length and its rank within that length. Nothing of the size of the
data passes the driver or a single task.
"""
from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import running_totals, text_or_empty, written

PIECE_SCHEMA = "_id long, piece int, start long, length int, ids_crc32 long"


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """Byte-level BPE with the vocabulary's ranks; special strings in a text are their ids."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@functools.lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(text: str, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...], library_path: str | None) -> list[int]:
    """The ids of a text. The pattern's look-ahead gives up on very long runs of
    blanks; such a text is encoded by the tokenizers library from the vocabulary's
    ``library_path``, which gives the same ids."""
    try:
        return encoder(ranks_path, pattern, special).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        if library_path is None:
            raise
        return _library(library_path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the first takes the rest, the others are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    end_id: int,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    library_path: str | None = None,
) -> DataFrame:
    """Every text's tokens and ``end_id``, in pieces of at most ``capacity``.

    Null texts are empty: they have one piece with ``end_id`` alone. Only
    texts of more than ``capacity`` tokens are cut; the first piece takes the
    remainder, so at most one piece of a document is shorter than a sequence.
    Returns id, piece, start, length, ids_crc32 (of the little-endian 32-bit
    ids) and, with ``keep_ids``, ids.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    specials = tuple(sorted(special.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("id", "piece", "start", "length", "crc", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = list(encoded(text.as_py(), ranks_path, pattern, specials, library_path))
                ids.append(end_id)
                ids = np.array(ids, dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    out["id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["crc"].append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        out["ids"].append(part.astype(np.int32))
            cols = [
                pa.array(out["id"], pa.int64()),
                pa.array(out["piece"], pa.int32()),
                pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int32()),
                pa.array(out["crc"], pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)


class Plan:
    """Bins for a histogram of lengths, as runs of like bins.

    ``runs`` holds (length, rank, count, bin, offset): the pieces of that
    length with ranks rank .. rank+count-1 go, one each, into bins
    bin .. bin+count-1 at that offset. Its size depends on the number of
    different lengths, not on the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.n_bins = 0
        self._left = dict(counts)
        self._used = dict.fromkeys(counts, 0)
        #: runs of open bins by the room they have left: room -> [(first bin, count)]
        self._open: dict[int, list[tuple[int, int]]] = {}
        self._match_large()
        self._fit_small()

    def _put(self, length: int, count: int, first_bin: int, offset: int) -> None:
        self.runs.append((length, self._used[length], count, first_bin, offset))
        self._used[length] += count
        self._left[length] -= count

    def _new_bins(self, count: int) -> int:
        first = self.n_bins
        self.n_bins += count
        return first

    def _keep(self, room: int, first_bin: int, count: int) -> None:
        if room and count:
            self._open.setdefault(room, []).append((first_bin, count))

    def _match_large(self) -> None:
        """Pieces above a third of the capacity: at most two share a bin. Largest
        first, each takes the largest partner that fits."""
        large = sorted((n for n in self._left if 3 * n > self.capacity), reverse=True)
        for a in large:
            for b in (b for b in large if b <= a and a + b <= self.capacity):
                pairs = self._left[a] // 2 if a == b else min(self._left[a], self._left[b])
                if pairs > 0:
                    first = self._new_bins(pairs)
                    self._put(a, pairs, first, 0)
                    self._put(b, pairs, first, a)
                    self._keep(self.capacity - a - b, first, pairs)
                if not self._left[a]:
                    break
            if n := self._left[a]:
                first = self._new_bins(n)
                self._put(a, n, first, 0)
                self._keep(self.capacity - a, first, n)

    def _fit_small(self) -> None:
        """The others, largest first, go where they leave the least room."""
        for n in sorted((n for n in self._left if 3 * n <= self.capacity), reverse=True):
            while left := self._left[n]:
                room = min((r for r in self._open if r >= n), default=None)
                if room is None:
                    # no bin takes it: open as many as this length fills, and one for the rest
                    per_bin = self.capacity // n
                    bins, each = (left // per_bin, per_bin) if left >= per_bin else (1, left)
                    first = self._new_bins(bins)
                    for k in range(each):
                        self._put(n, bins, first, k * n)
                    self._keep(self.capacity - each * n, first, bins)
                    continue
                first, bins = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room]
                take = min(left, bins)
                self._put(n, take, first, self.capacity - room)
                self._keep(room - n, first, take)
                self._keep(room, first + take, bins - take)


def place_pieces(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a column ``length``, 1 to
    ``capacity``; ``keys`` tell pieces apart).

    Full pieces are sequences by themselves. The others are ranked within
    their length by one global sort on (length, keys); the plan's runs, kept
    by length, turn (length, rank) into a bin and an offset.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    full = counts.pop(capacity, 0)
    plan = Plan(counts, capacity)
    starts, at = {}, 0
    for n in sorted(counts):
        starts[n], at = at, at + counts[n]
    runs = sorted((starts[n] + rank, count, first, offset) for n, rank, count, first, offset in plan.runs)
    if full:
        runs.append((at, full, plan.n_bins, 0))
    lows, _, bins, offsets = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 4
    ranked = running_totals(pieces, [F.col(c) for c in ["length", *keys]], [])
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(lows, row, side="right") - 1
            cols = [batch.column(i) for i in range(len(names))]
            cols += [pa.array(bins[k] + (row - lows[k])), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.select(*names, "_row").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    library_path: str | None = None,
) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id (from 0), offset. Repeated rows are packed each for itself;
    an empty table gives no rows; null ids are packed too; other columns are
    not read. ``library_path``: the vocabulary for texts the pattern gives up on
    (``encoded``).
    """
    pieces = tokenised_pieces(df, ranks_path, pattern, special, end_id, capacity, id_col, text_col, library_path=library_path)
    placed = place_pieces(written(pieces, "packing"), capacity, ["_id", "piece"])
    return placed.select(
        F.col("_id").alias(id_col),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        "offset",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The token ids of every sequence, from placed pieces with their ``ids``;
    a group holds at most a sequence."""
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )
