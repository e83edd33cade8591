"""Removal of repeated byte strings through run-length indexes.

A string of ``length`` bytes that occurs twice has the same minimizer (its
smallest k-gram) at the same place in both, so occurrences can only be found
among the contexts of one anchor: the stretches of text whose strings have
that k-gram as minimizer. Contexts that are equal as a whole repeat as a
whole. What differs is put, anchor by anchor, into a run-length index: the
Burrows-Wheeler transform of the contexts as runs, with the neighbour and the
match length sampled where runs begin and end; the matching statistics of all
positions are streamed from these samples.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import merged_spans, sieve, sifted, split_rows, text_or_empty, written
from scholargraph.llm.words import _powers, mix

#: Strings of a text taken at a time.
_STEP = 1 << 19
#: Contexts of an anchor that one task indexes; anchors with more go by string.
_MAX_CONTEXTS = 4096
#: Bytes of contexts that share an index.
_INDEX_BYTES = 1 << 20
_LOW = np.uint64((1 << 20) - 1)


class Hashes:
    """Hashes of any substring of a block, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _powers(max(10, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def anchors(text: bytes, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block of the text: (anchor, context, first, last) arrays, where the
    strings that start at first..last have the k-gram with hash ``anchor`` as
    minimizer and ``context`` is a hash of the bytes they cover together."""
    data = np.frombuffer(text, dtype=np.uint8)
    for base in range(0, len(data) - length + 1, _STEP):
        block = data[base : base + _STEP - 1 + length]
        hashes, n = Hashes(block), len(block)
        starts = np.arange(n - k + 1)
        grams = hashes.of(starts, starts + k)
        least = (grams & ~_LOW) | starts.astype(np.uint64)
        size, window = 1, length - k + 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: n - length + 1], least[window - size :])
        at = (least & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        context = mix(hashes.of(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield grams[at].view(np.int64), context.view(np.int64), first + base, last + base


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                for found in anchors(text.as_py(), length, k):
                    rows.append(found)
                    docs.append(np.full(len(found[0]), i))
            if rows:
                cols = [np.concatenate(c) for c in zip(*rows)]
                doc = batch.column(0).take(pa.array(np.concatenate(docs)))
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(c) for c in cols]], ["doc", "anchor", "context", "first", "last"])

    return run


def _cut_contexts(length: int):
    """The bytes of the contexts that are asked of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, asked = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)
            out = []
            for i, doc in enumerate(docs):
                data = texts[i].as_py()
                for a in asked[i].as_py():
                    out.append((a["anchor"], doc, a["first"], a["alone"], data[a["first"] : a["last"] + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["anchor", "doc", "first", "alone", "data"]
            )

    return run


class RunLengthIndex:
    """The suffixes of a set of contexts that start strings, in sorted order,
    kept as the runs of their Burrows-Wheeler transform.

    Two neighbours in the order whose preceding bytes are equal are, one byte
    earlier, neighbours again, and their match is one byte longer; so inside a
    run of equal preceding bytes the neighbour of a position moves along with
    it. Neighbour and match length are stored only where that breaks: at the
    first suffix of a run for the neighbour above and at the last one for the
    neighbour below, and where a context's strings begin.
    """

    def __init__(self, contexts: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        sizes = np.array([len(c) for c in contexts])
        ends = np.cumsum(sizes)
        n = len(self.data)
        self.end = np.repeat(ends, sizes)
        place = np.arange(n)
        # the first 7 bytes; places past the end of a context are smaller than any byte
        key = np.zeros(n, dtype=np.int64)
        for i in range(7):
            byte = np.zeros(n, dtype=np.int64)
            inside = place + i < self.end
            byte[inside] = self.data[place[inside] + i].astype(np.int64) + 1
            key = key << 9 | byte
        order, rank = self._ranked(key)
        size = 7
        while size < length:
            beyond = place + size
            tail = np.zeros(n, dtype=np.int64)
            inside = beyond < self.end
            tail[inside] = rank[beyond[inside]] + 1
            order, rank = self._ranked(rank * np.int64(n + 1) + tail)
            size *= 2
        # only suffixes that start a string take part
        starts = self.end - place >= length
        order = order[starts[order]]
        begin = ends - sizes
        edge = np.zeros(n, dtype=bool)
        edge[begin] = True
        before = np.where(edge[order], 256, self.data[order - 1].astype(np.int64))
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))) if len(order) else order
        #: The transform as runs: the preceding bytes (256: none) and how often.
        self.symbols, self.counts = before[heads], np.diff(np.append(heads, len(order)))
        #: Positions where strings start.
        self.starts = np.flatnonzero(starts)
        self.above = self._samples(order, edge)
        self.below = self._samples(order[::-1], edge)

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64)))
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return order, rank

    def _samples(self, order: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, neighbour, match length) at the ends of runs, by position."""
        near = np.full(len(self.data), -2, dtype=np.int64)
        near[order[1:]] = order[:-1]
        near[order[:1]] = -1
        at = self.starts
        moves = (near[at] != near[at - 1] + 1) | edge[at] | (near[at] < 0)
        moves |= self.data[at - 1] != self.data[near[at] - 1]
        sampled = at[moves]
        return sampled, near[sampled], self._match(sampled, near[sampled])

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, within their contexts."""
        room = np.where(b >= 0, np.minimum(self.end[a] - a, self.end[b] - b), 0)
        shared = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(room)
        while len(live):
            live = live[self.data[a[live] + shared[live]] == self.data[b[live] + shared[live]]]
            shared[live] += 1
            live = live[shared[live] < room[live]]
        return shared

    def statistics(self) -> np.ndarray:
        """For every position of ``starts`` its longest match with any other,
        streamed from the samples: one byte on, a match is one byte shorter."""
        best = np.zeros(len(self.starts), dtype=np.int64)
        for sampled, _, shared in (self.above, self.below):
            if len(sampled):
                k = np.searchsorted(sampled, self.starts, side="right") - 1
                best = np.maximum(best, shared[k] - (self.starts - sampled[k]))
        return best


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive places."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return places[np.concatenate(([0], cut))], places[np.append(cut, len(places)) - 1]


def _indexed(length: int):
    """Over contexts sorted by anchor: the repeated bytes of those that are
    alone of their kind. All contexts of an anchor share one index."""

    def spans(contexts: list[tuple]) -> Iterator[tuple[int, int, int]]:
        index = RunLengthIndex([c[3] for c in contexts], length)
        hit = index.starts[index.statistics() >= length]
        begin = 0
        for doc, first, alone, data in contexts:
            if alone:
                own = hit[np.searchsorted(hit, begin) : np.searchsorted(hit, begin + len(data))] - begin
                if len(own):
                    for s, e in zip(*_runs(own)):
                        yield doc, first + int(s), first + int(e) + length
            begin += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        anchor, size = None, 0

        def emit() -> pa.RecordBatch:
            rows = list(spans(kept)) if len(kept) > 1 else []
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["doc", "start", "end"])

        for batch in batches:
            for a, doc, first, alone, data in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor and size >= _INDEX_BYTES:
                    yield emit()
                    size = 0
                anchor = a
                kept.append((doc, first, alone, data))
                size += len(data)
        yield emit()

    return run


def _strings(length: int):
    """The strings of contexts one by one: (hash, doc, start, alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            for _, doc, first, alone, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = np.frombuffer(data, dtype=np.uint8)
                at = np.arange(len(block) - length + 1)
                for part, x in zip(parts, (Hashes(block).of(at, at + length).view(np.int64), np.full(len(at), doc), at + first, np.full(len(at), alone))):
                    part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["h", "doc", "start", "alone"])

    return run


def repeated_spans(df: DataFrame, length: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): the bytes of every text that a string of ``length`` bytes
    covers which starts anywhere else too, the same text included; maximal
    disjoint runs [start, end) in order. Documents without any have no row.

    1. Every string's minimizer, its smallest ``k``-gram, is an anchor; the
       strings in a row with one anchor are its context. Anchors met once are
       done.
    2. Contexts that are equal as a whole repeat as a whole.
    3. One copy of each different context of the other anchors goes, by anchor,
       into run-length indexes; strings of contexts that are alone and whose
       matching statistics reach ``length`` repeat. Anchors with more than 4096
       different contexts are compared string by string in a grouping instead,
       so no task gets an unbounded anchor.

    Counting by anchor and by context are partial aggregates, so contexts that
    a third of all documents share are combined before the shuffle. Texts that
    hold contexts for step 3 are read again through a bitmap of bounded size.
    Null texts are empty; rows with a null id take no part; an empty table
    gives no rows; other columns are not read. Ids should be unique: every row
    is a document of its own when strings are counted, but spans are kept by
    id, so two different texts of one id get each other's spans.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")
    )
    rows = docs.mapInArrow(_anchor_rows(length, k), "doc long, anchor long, context long, first long, last long")
    rows = written(rows, "anchors")
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    rows = rows.join(often, "anchor")
    kinds = rows.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "last")).alias("one")
    )
    kinds = written(kinds, "contexts")
    whole = rows.join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    whole = whole.select("doc", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # without a context that is alone there is nothing left to find
    several = several.where("kinds > 1 and least = 1").select("anchor", (F.col("kinds") > _MAX_CONTEXTS).alias("many"))
    asked = kinds.join(several, "anchor").select(
        "anchor", "many", F.col("one.doc").alias("doc"), F.col("one.first").alias("first"), F.col("one.last").alias("last"), (F.col("n") == 1).alias("alone")
    )
    asked = written(asked, "asked-contexts")

    def contexts(which: DataFrame) -> DataFrame:
        per_doc = which.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "last", "alone")).alias("asked"))
        texts = sifted(docs, sieve(which.select("doc"), ["doc"]), ["_id"]).where("_hit").dropDuplicates(["_id"])
        found = texts.join(per_doc, F.col("_id") == F.col("doc")).select("_id", "_text", "asked")
        return found.mapInArrow(_cut_contexts(length), "anchor long, doc long, first long, alone boolean, data binary")

    by_anchor = contexts(asked.where("not many")).repartition("anchor").sortWithinPartitions("anchor")
    indexed = by_anchor.mapInArrow(_indexed(length), "doc long, start long, end long")
    strings = contexts(asked.where("many")).mapInArrow(_strings(length), "h long, doc long, start long, alone boolean")
    twice = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    by_string = strings.where("alone").join(twice, "h", "left_semi")
    by_string = by_string.select("doc", "start", (F.col("start") + length).alias("end"))
    return merged_spans(whole.unionByName(indexed).unionByName(by_string))


def without_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, n_bytes, n_removed, n_spans and kept, the bytes
    that remain (binary: a cut may fall inside a character)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                data, parts, at = text.as_py(), [], 0
                for run in runs.as_py():
                    parts.append(data[at : run["start"]])
                    at = run["end"]
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
            sizes = pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64())
            n_spans = pa.array([len(r) for r in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(removed, pa.int64()), n_spans, pa.array(kept, pa.binary())],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    spans = written(spans, "repeated-spans")
    whole, touched = split_rows(docs, spans.select("doc"), "_id")
    joined = touched.join(spans, F.col("_id") == F.col("doc"), "left")
    none = F.lit(0).cast("long")
    same = whole.unionByName(joined.where("spans is null").select("_id", "_text")).select(
        "_id", F.octet_length("_text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.encode("_text", "UTF-8").alias("kept"),
    )
    changed = joined.where("spans is not null").select("_id", "_text", "spans")
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return same.unionByName(changed.mapInArrow(cut, schema)).withColumnRenamed("_id", id_col)
