"""Document fingerprints from closed syncmers, compared by their places."""
from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import running_totals, shuffle_partitions, text_or_empty
from scholargraph.llm.words import _BASE, mix

#: Code points looked at together.
PIECE = 1 << 20


def _joined(left: np.ndarray, right: np.ndarray, shift: int, size: int) -> np.ndarray:
    """Hashes of substrings from those of a first part and of the ``size``
    code points that begin ``shift`` behind."""
    n = len(right) - shift
    return left[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + right[shift : shift + n]


def _substrings(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every substring of ``size`` code points, from those of halves."""
    if size == 1:
        return mix(codes.astype(np.uint64) + np.uint64(1))
    half = _substrings(codes, size // 2)
    out = _joined(half, half, size // 2, size // 2)
    return _joined(out, _substrings(codes, 1), size - 1, 1) if size % 2 else out


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


class Syncmers:
    """Closed syncmers: of all substrings of ``k`` code points, those whose
    least inner substring of ``s`` (by hash; equal ones count alike) begins or
    ends them. Whether one is chosen depends on its own ``k`` code points only,
    and of ``k - s`` neighbours at least one is chosen."""

    def __init__(self, k: int = 40, s: int = 8):
        if not 0 < s < k <= 255 + s:
            raise ValueError("0 < s < k <= 255 + s")
        self.k, self.s = k, s

    def anchors(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (32 bits) and places of the chosen substrings, in order. A
        text of 1 to k - 1 code points is one anchor as a whole; an empty one
        has none."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(codes) < self.k:
            return (_substrings(codes, len(codes)) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
        hashes, places = [], []
        for at in range(0, len(codes) - self.k + 1, PIECE):
            piece = codes[at : at + PIECE + self.k - 1]
            inner = mix(_substrings(piece, self.s))
            least = _window_least(inner, self.k - self.s + 1)
            chosen = np.flatnonzero((inner[: len(least)] == least) | (inner[self.k - self.s :] == least))
            whole = _substrings(piece, self.k)[chosen]
            hashes.append((mix(whole) >> np.uint64(32)).astype(np.uint32))
            places.append(chosen + at)
        return np.concatenate(hashes), np.concatenate(places)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Twice the anchors that two texts share in the same order, over all
    anchors of both: 0 to 1, and 1 for equal ones (two empty ones too).

    The i-th occurrence of an anchor meets the i-th of the other text; what
    stays in order is a longest increasing run of places.
    """
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    if len(x[0]) == len(y[0]) and (x[0] == y[0]).all():
        return 1.0
    _, in_x, in_y = np.intersect1d(_numbered(x[0]), _numbered(y[0]), assume_unique=True, return_indices=True)
    matched = in_y[np.argsort(in_x)]
    if len(matched) > 1 and (np.diff(matched) < 0).any():
        ends: list[int] = []
        for place in matched.tolist():
            i = bisect_right(ends, place)
            ends[i : i + 1] = [place]
        return 2 * len(ends) / (len(x[0]) + len(y[0]))
    return 2 * len(matched) / (len(x[0]) + len(y[0]))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Every hash with its occurrence's number, so that none repeats."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(len(hashes))
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty(len(hashes), np.uint64)
    out[order] = (ranked.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
    return out


def packed(anchors: tuple[np.ndarray, np.ndarray]) -> str:
    """Anchors as text: base64 of the hashes (32 bits each, little-endian) and
    then the distances from one place to the next (8 bits each)."""
    hashes, places = anchors
    gaps = np.diff(places, prepend=places[:1])
    return base64.b64encode(hashes.astype("<u4").tobytes() + gaps.astype(np.uint8).tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places again; the first place counts as 0."""
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 5
    return np.frombuffer(raw[: 4 * n], "<u4"), np.cumsum(np.frombuffer(raw[4 * n :], np.uint8).astype(np.int64))


def _compared(syncmers: Syncmers):
    """Rows (part, id, text, guest) sorted by part, id and text: every row that
    is no guest is compared with the row behind it, in the same part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for part, doc, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text = text.as_py()
                anchors = syncmers.anchors(text)
                if before is not None and before[0] == part and not before[4]:
                    out.append(_row(syncmers, before, text, anchors))
                before = (part, doc, text, anchors, guest)
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _NAMES)

    return run


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(syncmers: Syncmers, row: tuple, following: str, next_anchors: tuple) -> tuple:
    _, doc, text, anchors, _ = row
    taken = len(text) // 2
    edited = text[: len(text) - taken] + following[:taken]
    changed = syncmers.anchors(edited)
    return (
        doc,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        packed(anchors),
        packed(changed),
        likeness(anchors, changed),
        likeness(anchors, next_anchors),
    )


def _part_of(id_col: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most the id, found by halving;
    null ids come before all."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    further = lambda at, step: (at + step <= len(cuts)) & (F.get(listed, at + step - 1) <= id_col)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def fingerprints(
    df: DataFrame, k: int = 40, s: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how near it is
    to that and to the next document's.

    The next document is that of the next larger id, the first one's for the
    last. In the edited text the last half of the code points (rounded down) is
    replaced by as many of the next document's first ones, or all it has. A
    fingerprint is the sequence of closed syncmers (``Syncmers``) of the whole
    text with their distances; likeness is the share of anchors met in the same
    order (``likeness``).

    Ids alone are sorted first, to cut them into ranges of near-equal bytes;
    then each text goes to its range once, and the first of every range also
    to the range before it (the first of all to the last one), so that
    neighbours meet without a join and nothing is gathered.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts are empty; an empty
    fingerprint is like another empty one (1) and unlike the rest (0). Null ids
    come before all others; rows of equal id are ordered by their text, each a
    document of its own; a single row is its own next document; an empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n = shuffle_partitions(spark)
    sizes = running_totals(docs.select("id", F.octet_length("text").cast("long").alias("bytes")), ["id"], ["bytes"])
    total = F.col("_before_bytes") + F.col("bytes")
    whole = sizes.agg(F.max(total)).first()[0]
    if whole is None:
        return docs.mapInArrow(_compared(Syncmers(k, s)), _SCHEMA).select(F.col("id").alias(id_col), *_NAMES[1:])
    # one id per range: as many as there are partitions
    target = max(1, -(-whole // n))
    starts = sizes.groupBy(F.floor(F.col("_before_bytes") / target).alias("range")).agg(F.min("id").alias("id"))
    cuts = sorted({r["id"] for r in starts.where("range > 0 and id is not null").collect()})
    first_id = sizes.agg(F.when(F.max(F.col("id").isNull()), F.lit(None)).otherwise(F.min("id"))).first()[0]
    cuts = [c for c in cuts if first_id is None or c > first_id]
    placed = docs.withColumn("part", _part_of(F.col("id"), cuts)).withColumn("guest", F.lit(False))
    # the first text of every range, again, for the range before
    heads = docs.where(F.col("id").isin(cuts) | F.col("id").eqNullSafe(F.lit(first_id)))
    heads = heads.groupBy("id").agg(F.min("text").alias("text"))
    own = _part_of(F.col("id"), cuts)
    guests = heads.select("id", "text", F.pmod(own - 1, F.lit(len(cuts) + 1)).alias("part"), F.lit(True).alias("guest"))
    both = placed.unionByName(guests).select(F.col("part").cast("long").alias("part"), "id", "text", "guest")
    dealt = both.repartitionById(len(cuts) + 1, F.col("part").cast("int"))
    out = dealt.sortWithinPartitions("part", "guest", "id", "text").mapInArrow(_compared(Syncmers(k, s)), _SCHEMA)
    return out.select(F.col("id").alias(id_col), *_NAMES[1:])


_SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
