"""Spelling variants: words one edit apart, found on sorted lists whose edit
matrices share rows along common prefixes."""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import shuffle_partitions, text_or_empty, written
from scholargraph.llm.runs import grouped, hashed_runs, letters, strings
from scholargraph.llm.words import mix

#: A group of more words than this is cut before it is given to a task ...
TASK_GROUP = 20_000
#: ... and one of more than this is cut inside the task.
SCAN_GROUP = 48

#: CRC-32 of single bytes, by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Runs of more bytes are hashed one by one.
_LONG_RUN = 64


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The CRC-32 of every slice of ``data``, begun with the CRC-32 in ``seeds``."""
    sizes = np.minimum(ends - starts, _LONG_RUN + 1)
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(1, _LONG_RUN + 1), "right")  # slices with more bytes than this
    at, state = starts[order], ~seeds[order]
    for j, k in enumerate(left):
        if not k:
            break
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + j]) & 255] ^ (state[:k] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    for i in order[: np.searchsorted(-sizes[order], -_LONG_RUN, "left")]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    return out


def _word_counts(damage: int):
    """(word, n): the runs of the texts, summed over a piece of a batch. A run
    whose hash with its document's id is a multiple of ``damage`` loses a
    letter (0: none does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            seeds = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            named = np.array([i is not None for i in ids], bool)
            for piece in hashed_runs(batch.column(1), letters):
                # equal runs of one text
                order, first = grouped(mix(piece.hashes + mix(piece.texts.astype(np.uint64))))
                if not len(first):
                    continue
                n = np.diff(np.append(first, len(order)))
                one = order[first]
                starts, ends, texts = piece.starts[one], piece.ends[one], piece.texts[one]
                hurt = np.zeros(len(one), bool)
                if damage:
                    crc = _crc32(piece.data, starts, ends, seeds[texts])
                    hurt = (crc % damage == 0) & named[texts]
                words, counts = [], []
                for i in np.flatnonzero(hurt):
                    word = piece.data[starts[i] : ends[i]].tobytes().decode()
                    cut = int(crc[i]) % len(word)
                    words.append(word[:cut] + word[cut + 1 :])
                    counts.append(int(n[i]))
                # equal runs of all texts of the piece
                whole = ~hurt
                starts, ends, n, hashes = starts[whole], ends[whole], n[whole], piece.hashes[one][whole]
                order, first = grouped(hashes)
                if len(first):
                    total = np.add.reduceat(n[order], first)
                    words = pa.concat_arrays([strings(piece.data, starts[order[first]], ends[order[first]]), pa.array(words, pa.string())])
                    counts = np.append(total, counts)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    return run


def vocabulary(
    df: DataFrame, least_length: int, least_count: int, damage: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points with at least
    ``least_count`` occurrences. Counts are summed in the scan, so a frequent
    word reaches the shuffle once per task."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    counted = docs.mapInArrow(_word_counts(damage), "word string, n long").where(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def scan(query: str, words: list[str], shared: list[int], jump: list[int]) -> Iterator[int]:
    """Places in the sorted list ``words`` of those exactly one edit from
    ``query`` that have its length or one code point more.

    ``shared[i]`` is the length of the prefix that word i shares with word
    i - 1, ``jump[i]`` the next place with a smaller one. Of the matrix between
    a word's prefixes and the query only the band of the three middle
    diagonals is kept, and its rows for the shared prefix are those of the word
    before. Where all three are above one edit, no word with that prefix can be
    near, and the scan goes on behind them.
    """
    size, n = len(query), len(words)
    padded = query + "\0\0"
    rows = [(2, 0, 1)]  # distances to the query's prefixes one shorter, equal and one longer
    at = 0
    while at < n:
        word = words[at]
        d = shared[at] if at else 0
        del rows[d + 1 :]
        low, mid, high = rows[d]
        dead = False
        while d < len(word):
            c = word[d]
            below = low if d and c == padded[d - 1] else low + 1
            if mid + 1 < below:
                below = mid + 1
            here = mid if d < size and c == padded[d] else mid + 1
            if high + 1 < here:
                here = high + 1
            if below + 1 < here:
                here = below + 1
            above = high if d + 1 < size and c == padded[d + 1] else high + 1
            if here + 1 < above:
                above = here + 1
            low, mid, high = below, here, above
            d += 1
            rows.append((low, mid, high))
            if low > 1 and mid > 1 and high > 1:
                dead = True
                break
        if not dead and (mid if len(word) == size else low if len(word) == size + 1 else 2) == 1:
            yield at
        if dead:
            at += 1
            while at < n and shared[at] >= d:
                at = jump[at]
        else:
            at += 1


def _sorted_list(words: list[str]) -> tuple[list[int], list[int]]:
    shared, jump = [0] * len(words), [len(words)] * len(words)
    for i in range(1, len(words)):
        x, y = words[i - 1], words[i]
        k, most = 0, min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        shared[i] = k
    stack: list[int] = []
    for i, k in enumerate(shared):
        while stack and shared[stack[-1]] > k:
            jump[stack.pop()] = i
        stack.append(i)
    return shared, jump


def near_in_group(words: list[str], size: int, low: int, tail: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words`` one edit apart, of which one word has
    ``size`` code points and the other ``size`` or one more, whose first
    difference is at a place from ``low`` to below ``high``.

    All words agree in their first ``low`` and last ``tail`` code points, and
    such a pair agrees in them anyway. A large group is cut in two by the place
    of the difference: behind the middle, the prefix up to it is shared as
    well, before it, the rest from it on. Every pair is in exactly one part.
    """
    todo = [(list(range(len(words))), low, tail, high)]
    while todo:
        group, low, tail, high = todo.pop()
        last = min(high, size + 1)
        if len(group) > SCAN_GROUP and last - low > 1:
            middle = (low + last) // 2
            front, back = defaultdict(list), defaultdict(list)
            for i in group:
                word = words[i]
                front[word[low:middle]].append(i)
                back[word[len(word) - (size - middle) : len(word) - tail]].append(i)
            todo += [(g, middle, tail, high) for g in front.values() if len(g) > 1]
            todo += [(g, low, size - middle, middle) for g in back.values() if len(g) > 1]
            continue
        if not any(len(words[i]) == size for i in group):
            continue
        inner = sorted((words[i][low : len(words[i]) - tail], i) for i in group)
        listed = [w for w, _ in inner]
        shared, jump = _sorted_list(listed)
        for place, (word, i) in enumerate(inner):
            if len(words[i]) != size:
                continue
            for found in scan(word, listed, shared, jump):
                j, other = inner[found][1], listed[found]
                if len(words[j]) == size and found < place:
                    continue  # seen from the other side
                k = 0
                while k < len(word) and word[k] == other[k]:
                    k += 1
                if low + k < high:
                    yield i, j


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple[str, str, int]] = []
    for key, group in groupby(rows(), key=lambda r: r[0]):
        members = list(group)
        if len(members) > 1:
            words = [r[1] for r in members]
            for i, j in near_in_group(words, *map(int, key.split(" ")[:4])):
                out += [(words[i], words[j], members[j][2]), (words[j], words[i], members[i][2])]
        if len(out) > 50_000:
            yield _rows(out)
            out = []
    yield _rows(out)


def _rows(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [(), (), ()]
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])


def _part(size: Column, low: Column, tail: Column, high: Column) -> Column:
    return F.struct(size.alias("size"), low.alias("low"), tail.alias("tail"), high.alias("high"))


def _keyed(df: DataFrame, parts: Column) -> DataFrame:
    """(word, n, part, key): ``df`` with every part of ``parts`` it is in."""
    out = df.select("word", "n", F.explode(parts).alias("part"))
    prefix = F.expr("substring(word, 1, part.low)")
    rest = F.expr("substring(word, char_length(word) - part.tail + 1, part.tail)")
    return out.withColumn("key", F.concat_ws(" ", "part.size", "part.low", "part.tail", "part.high", prefix, rest))


def _groups(words: DataFrame) -> DataFrame:
    """Every word in the groups in which it can meet a near word: for pairs
    whose shorter word has its length or one less, by the first half of that
    length (difference behind it) and by the rest (difference before it). A
    group too large for a task is cut the same way, until none is left that can
    be cut; one that cannot holds words that differ in a single place."""
    length = F.char_length("word")

    def halves(size: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        none = F.lit(0)
        return F.array(_part(size, half, none, size + 1), _part(size, none, size - half, half))

    pending = _keyed(words, F.concat(halves(length), F.when(length > 1, halves(length - 1)).otherwise(F.array())))
    last = F.least(F.col("part.high"), F.col("part.size") + 1)
    middle = F.floor((F.col("part.low") + last) / 2).cast("int")
    both = F.array(
        _part(F.col("part.size"), middle, F.col("part.tail"), F.col("part.high")),
        _part(F.col("part.size"), F.col("part.low"), F.col("part.size") - middle, middle),
    )
    done = None
    while True:
        sizes = pending.where(last - F.col("part.low") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
        large = written(sizes.where(F.col("_rows") > TASK_GROUP).select("key"), "large-word-groups")
        if large.isEmpty():
            return pending if done is None else done.unionByName(pending)
        small = pending.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        pending = written(_keyed(pending.join(large, "key", "left_semi").withColumn("_parts", both), F.col("_parts")), "cut-word-groups")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word reached by following
    forms. Every step goes to a word with more occurrences, so there are no
    circles; each round doubles the steps, until none is left."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = written(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "word-roots")
        if at.where("_moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("_moved")


def spelling_variants(
    df: DataFrame,
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    damage: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The words of all texts with the form each is a variant of.

    Words are maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased. Two are
    near if exactly one code point is inserted, deleted or replaced between
    them. A word's form is its near word with the most occurrences (ties: the
    first in code-point order) if that has at least ``ratio`` times its own;
    its root is reached by following forms to the last.

    1. Words are counted in the scan and summed.
    2. Near words share the first or the second half of the shorter one, so
       words meet in groups of equal halves, each sorted and scanned with edit
       rows that neighbours in the list share (``scan``).
    3. Pairs are reduced to a count and the best form per word; roots come
       from doubling the steps along forms.

    ``damage``: a run whose CRC-32 of '<id>:<run>' is a multiple of it loses
    the code point at that hash modulo its length, in every occurrence.

    Returns word, form, root, n, n_near (0 if none), form_n. Null and empty
    texts have no words; a row with a null id counts and is never damaged;
    repeated rows count each; an empty table gives no rows; other columns are
    not read.
    """
    words = written(vocabulary(df, least_length, least_count, damage, id_col, text_col), "vocabulary")
    groups = _groups(words).select("key", "word", "n")
    n = shuffle_partitions(df.sparkSession)
    pairs = groups.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_near, "word string, near string, near_n long")
    near = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    most = -F.col("best.minus")
    enough = most >= F.lit(ratio) * F.col("n")
    known = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, most).alias("form_n"),
        ),
        "word-forms",
    )
    out = known.join(_roots(known.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
