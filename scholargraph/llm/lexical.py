"""Ranked lexical search over an index whose strata are documents of equal
length normaliser."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.common import running_totals, shuffle_partitions, text_or_empty, written
from scholargraph.llm.runs import hashed_runs, terms

#: Documents and (document, term) pairs of one row of the index; a document
#: with more terms has a row of its own.
BLOCK_DOCS, BLOCK_PAIRS = 4096, 1 << 20
#: (item, term) pairs searched in one pass over the index.
PASS_TERMS = 200_000

#: A bitmap over hashes of terms: 256 rows of 32,768 bits, 1 MB.
_ROWS, _BITS = 256, 32768


def _filter_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_ROWS * _BITS - 1)).astype(np.int64)


def _term_counts(bits: np.ndarray | None):
    """(id, n, terms, tfs): a text's number of terms, and how often each term
    occurs whose bit is set in ``bits`` (None: each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            n = np.zeros(rows, np.int64)
            found, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            counts = [np.zeros(0, np.int64)]
            for piece in hashed_runs(batch.column(1), terms):
                n += np.bincount(piece.texts, minlength=rows)
                hashes, texts = piece.hashes, piece.texts
                if bits is not None:
                    place = _filter_bits(hashes)
                    asked = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    hashes, texts = hashes[asked], texts[asked]
                texts, hashes, tf = _summed(texts, hashes, np.ones(len(texts), np.int64))
                found.append(hashes), where.append(texts), counts.append(tf)
            # a long text may have several pieces
            where, found, counts = _summed(*map(np.concatenate, (where, found, counts)))
            bounds = pa.array(np.searchsorted(where, np.arange(rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.ListArray.from_arrays(bounds, pa.array(found.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(counts)),
                ],
                ["id", "n", "terms", "tfs"],
            )

    return run


def _summed(texts: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
    """``counts`` summed for equal (text, hash), ordered by text and hash."""
    order = np.lexsort((hashes, texts))
    texts, hashes, counts = texts[order], hashes[order], counts[order]
    if not len(texts):
        return texts, hashes, counts
    first = np.flatnonzero(np.concatenate(([True], (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1]))))
    return texts[first], hashes[first], np.add.reduceat(counts, first)


def _counted(df: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).where("id is not null")
    return rows.mapInArrow(_term_counts(bits), "id long, n long, terms array<long>, tfs array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the terms in ``hashes`` (its column term): 1 MB, whatever their number."""
    place = F.col("term").bitwiseAND(F.lit(_ROWS * _BITS - 1))
    rows = (
        hashes.select(F.floor(place / _BITS).alias("row"), F.pmod(place, F.lit(_BITS)).alias("bit"))
        .groupBy("row")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    )
    out = np.zeros(_ROWS * _BITS // 8, np.uint8)
    for row, bits in rows.collect():
        out[row * _BITS // 8 : (row + 1) * _BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


class Index(NamedTuple):
    """``blocks``: a row per block of documents in order of normaliser (see
    ``_inverted``); ``docs`` N, ``tokens`` L; ``frequencies``: (term, df)."""

    blocks: DataFrame
    docs: int
    tokens: int
    frequencies: DataFrame


BLOCK_SCHEMA = "strata array<long>, term array<long>, stratum array<int>, tf array<long>, stop array<int>, docs array<long>"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of an index from documents (m, id, terms, tfs) sorted by m.

    A block holds the normalisers of its strata, ascending, and its postings:
    entry i of ``term``, ``stratum``, ``tf``, ``stop`` says that the documents
    ``docs[stop[i - 1]:stop[i]]`` of that stratum have the term tf times.
    Entries ascend by term and stratum and descend by tf, so the first one of a
    term in a stratum bounds what it can add there.
    """
    ms, ids, found, tfs, pairs = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        strata, of = np.unique(np.array(ms), return_inverse=True)
        sizes = [len(t) for t in found]
        doc, stratum = np.repeat(np.array(ids), sizes), np.repeat(of, sizes)
        term, tf = np.concatenate(found), np.concatenate(tfs)
        order = np.lexsort((doc, -tf, stratum, term))
        term, stratum, tf, doc = term[order], stratum[order], tf[order], doc[order]
        new = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
        first = np.flatnonzero(np.concatenate(([True], new)))
        stop = np.append(first[1:], len(term))
        columns = [strata, term[first], stratum[first].astype(np.int32), tf[first], stop.astype(np.int32), doc]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
        return pa.RecordBatch.from_arrays(lists, ["strata", "term", "stratum", "tf", "stop", "docs"])

    for batch in batches:
        for m, i, t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            t, f = t.values.to_numpy(), f.values.to_numpy()
            if ids and (len(ids) >= BLOCK_DOCS or pairs + len(t) > BLOCK_PAIRS):
                yield block()
                ms, ids, found, tfs, pairs = [], [], [], [], 0
            ms.append(m), ids.append(i), found.append(t), tfs.append(f)
            pairs += len(t)
    if ids:
        yield block()


def build_index(df: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents. ``asked``: a table of hashed terms (term); the
    postings of others may be left out (a bitmap of 1 MB decides in the scan).

    Documents are dealt by (normaliser, id), so one normaliser that many
    documents have is spread over tasks; they reach the shuffle as numbers,
    never as text. Rows with a null id are not indexed.
    """
    counted = written(_counted(df, id_col, text_col, None if asked is None else _bitmap(asked)), "term-counts")
    docs, tokens = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    m = F.expr(f"10L + (90L * n * {docs}L) div {max(tokens, 1)}L").alias("m")
    placed = counted.where("size(terms) > 0").select(m, "id", "terms", "tfs")
    n = shuffle_partitions(df.sparkSession)
    blocks = placed.repartitionByRange(n, "m", "id").sortWithinPartitions("m", "id").mapInArrow(_inverted, BLOCK_SCHEMA)
    return Index(written(blocks, "lexical-index"), docs, tokens, frequencies)


class Block:
    """A block in memory, with the impact of every (term, stratum, tf) but for
    the term's weight."""

    def __init__(self, row: tuple[np.ndarray, ...]):
        self.strata, term, self.stratum, tf, self.stop, docs = row
        self.start = np.concatenate(([0], self.stop[:-1]))
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * self.strata[self.stratum])
        self.ids, self.doc = np.unique(docs, return_inverse=True)
        self.terms, first = np.unique(term, return_index=True)
        self.bounds = np.append(first, len(term))
        #: the first entry of each term in each stratum
        self.top = np.concatenate(([True], (term[1:] != term[:-1]) | (self.stratum[1:] != self.stratum[:-1])))

    def search(self, wanted: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of documents, among them the block's ``k`` best of at
        least ``least``. Strata are visited by the most a document in them can
        reach, until that is below the k-th score found."""
        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == wanted
        at, weights = at[known], weights[known]
        low, high = self.bounds[at], self.bounds[at + 1]
        entries = _ranges(low, high)
        if not len(entries):
            return self.ids[:0], entries
        stratum = self.stratum[entries]
        gain = np.repeat(weights, high - low) * self.impact[entries]
        bound = np.zeros(len(self.strata), np.int64)
        np.add.at(bound, stratum[self.top[entries]], gain[self.top[entries]])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= max(least, 1)]
        out_ids, out_scores, step = [], [], 1
        scores = np.zeros(len(self.ids), np.int64)
        while len(order):
            visit = np.zeros(len(bound), bool)
            visit[order[:step]] = True
            mine = visit[stratum]
            start, stop = self.start[entries[mine]], self.stop[entries[mine]]
            scores[:] = 0
            docs = self.doc[_ranges(start, stop)]
            np.add.at(scores, docs, np.repeat(gain[mine], stop - start))
            best = np.flatnonzero(scores >= max(least, 1))
            out_ids.append(self.ids[best]), out_scores.append(scores[best])
            reached = np.concatenate(out_scores)
            if len(reached) >= k:
                least = max(least, int(np.partition(reached, len(reached) - k)[len(reached) - k]))
            order = order[step:]
            order, step = order[bound[order] >= max(least, 1)], step * 2
        if not out_ids:
            return self.ids[:0], entries[:0]
        return np.concatenate(out_ids), np.concatenate(out_scores)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range behind the other."""
    sizes = stops - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """(item, id, score): the best ``k`` documents of a task's blocks for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for batch in batches:
            for i in range(len(batch)):
                block = Block(tuple(c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns))
                for j, (_, wanted, weights) in enumerate(items):
                    ids, scores = best[j]
                    # a document with the k-th score and a smaller id still goes before
                    more = block.search(wanted, weights, k, int(scores[-1]) if len(scores) == k else 0)
                    if len(more[0]):
                        best[j] = _best(np.append(ids, more[0]), np.append(scores, more[1]), k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([i for i, _, _ in items], np.int64), [len(b[0]) for b in best])),
                pa.array(np.concatenate([none, *(b[0] for b in best)])),
                pa.array(np.concatenate([none, *(b[1] for b in best)])),
            ],
            ["item", "id", "score"],
        )

    return run


def ranked_search(
    df: DataFrame,
    items: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` documents of ``df`` that score highest for each item's text.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. With N documents that have a term, L terms in all, n in the
    document and df documents holding a term, a term weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document's normaliser m is
    10 + 90nN div L, and its score the sum over the item's different terms of
    weight * (10^9 tf div (1000 tf + 8m)), all in 64-bit integers.

    The index holds documents of equal m as strata with postings by tf, cut
    into blocks of bounded size. A task goes through its blocks, in each visits
    strata in order of what they can reach and stops below the k-th score it
    has; it returns k rows per item. Items are searched in passes of at most
    PASS_TERMS terms (one item of more has its own).

    Returns item_id, rank (from 1), doc_id, score: higher scores first, then
    smaller ids; scores above 0 only. Null and empty texts have no terms and
    are in no result. Rows with a null id take no part, on either side.
    Repeated rows of ``df`` are documents of their own; repeated rows of an item are one
    item with the terms of all. Empty tables give no rows; other columns are
    not read. Terms are compared by 64-bit hashes.
    """
    pairs = _counted(items, item_col, item_text, None).select("id", F.explode("terms").alias("term")).distinct()
    pairs = written(pairs, "item-terms")
    index = build_index(df, pairs, id_col, text_col)
    weight = F.floor(F.lit(1000) * F.log((2 * F.lit(index.docs) + 2) / (2 * F.col("df") + 1))).alias("weight")
    weighted = pairs.join(index.frequencies, "term").select("id", "term", weight).where("weight > 0")
    per_item = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    per_item = running_totals(per_item.withColumn("size", F.size("terms").cast("long")), ["id"], ["size"])
    per_item = written(per_item.withColumn("pass", F.floor(F.col("_before_size") / PASS_TERMS)), "weighted-items")
    found = None
    for (number,) in per_item.select("pass").distinct().orderBy("pass").toLocalIterator():
        # at most PASS_TERMS pairs and one item more
        chosen = [
            (i, np.array([t[0] for t in ts], np.int64), np.array([t[1] for t in ts], np.int64))
            for i, ts in per_item.where(F.col("pass") == number).select("id", "terms").collect()
        ]
        part = index.blocks.mapInArrow(_search(chosen, k), "item long, id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
