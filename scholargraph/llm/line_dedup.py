"""Line dedup by an exact set-similarity join over lines."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.common import bits, shuffles_go, sieve, sifted, split_rows, text_or_empty, written
from scholargraph.llm.words import hash_words, lower_ascii, mix

#: Bytes of text (arrays over them fit a core's cache) and number of lines taken
#: through the array operations at once.
_CHUNK_BYTES, _CHUNK_LINES = 1 << 18, 1 << 16
#: Lines of a bucket that the others of it are compared with before the join.
_HUBS = 8
#: Counters of the word-frequency sketch (a power of two) and bits of a token hash.
_COUNTERS, _HASH_BITS = 1 << 17, 48
#: Rows of a token that one task pairs, and pairs that it makes together.
_MOST, _PAIRS = 1 << 16, 1 << 18
#: Largest size of a set and place of a token that the filters tell apart.
_MOST_SIZE, _MOST_AT = (1 << 19) - 1, (1 << 12) - 1
#: Numbers that spread lines over a bitmap.
_SPOT_IDS, _SPOT_STEP = 8388593, 1000003


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(first, end, joined text) of runs of documents of about a chunk's bytes."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        data = lower_ascii(text.as_py())
        if parts and size + len(data) > _CHUNK_BYTES:
            yield first, i, b"\n".join(parts)
            first, parts, size = i, [], 0
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield first, len(texts), b"\n".join(parts)


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Line (counted over the chunk) and token hash of every word."""
    starts, _, h = hash_words(data)
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    return np.searchsorted(breaks, starts), h >> np.uint64(64 - _HASH_BITS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    for batch in batches:
        for _, _, data in _chunks(batch.column(0).cast(pa.binary())):
            tokens = _tokens(data)[1] & np.uint64(_COUNTERS - 1)
            counts += np.bincount(tokens.astype(np.int64), minlength=_COUNTERS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["counter", "n"])


class Lines:
    """The token sets of a chunk's lines, each in order of rarity.

    Rarity is the count of the token's counter, then its hash: one total order
    over all tokens of the corpus, which is what the prefix filter needs.
    """

    def __init__(self, data: bytes, counts: np.ndarray):
        line, token = _tokens(data)
        rarity = counts[(token & np.uint64(_COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
        code = rarity << np.uint64(_HASH_BITS) | token
        lines, codes = [], []
        at = 0
        while at < len(line):  # line numbers of 16 bits sort in linear time
            low = line[at]
            end = int(np.searchsorted(line, low + _CHUNK_LINES))
            order = np.argsort(code[at:end])
            small = (line[at:end] - low).astype(np.uint16)[order]
            by_line = np.argsort(small, kind="stable")
            ln, cd = small[by_line].astype(np.int64) + low, code[at:end][order][by_line]
            new = np.ones(len(ln), dtype=bool)
            new[1:] = (ln[1:] != ln[:-1]) | (cd[1:] != cd[:-1])
            lines.append(ln[new])
            codes.append(cd[new])
            at = end
        ln = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        self.tokens = (np.concatenate(codes) if codes else np.zeros(0, np.uint64)) & np.uint64((1 << _HASH_BITS) - 1)
        self.first = np.flatnonzero(np.concatenate(([True], ln[1:] != ln[:-1]))) if len(ln) else np.zeros(0, np.int64)
        #: The lines that have words, their sizes, and an order-free hash of their sets.
        self.line = ln[self.first]
        self.size = np.diff(np.append(self.first, len(ln)))
        if len(ln):
            total = np.add.reduceat(mix(self.tokens + np.uint64(1)), self.first)
            self.key = mix(total + self.size.astype(np.uint64)).view(np.int64)
            #: Parities of the tokens over 128 places, two words of 64: two sets
            #: differ in at least as many tokens as places.
            place = (self.tokens & np.uint64(127)).astype(np.uint64)
            bit = np.uint64(1) << (place & np.uint64(63))
            self.parities = [
                np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == w, bit, 0).astype(np.uint64), self.first).view(np.int64)
                for w in (0, 1)
            ]
            #: Smallest token under two hash functions: near copies mostly share one.
            self.mins = [np.minimum.reduceat(mix(self.tokens ^ np.uint64(r)), self.first).view(np.int64) for r in (0x5DEECE66D, 0xB5026F5AA)]
        else:
            self.key = np.zeros(0, np.int64)
            self.parities = self.mins = [self.key, self.key]

    def heads(self, which: np.ndarray, lengths: np.ndarray, kind: type = np.int64) -> pa.ListArray:
        """The first ``lengths`` tokens of the lines ``which`` (their low bits,
        for a narrow ``kind``); null for other lines."""
        lengths = np.where(which, lengths, 0)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.first - offsets[:-1], lengths) + np.arange(offsets[-1])
        values = pa.array(self.tokens[at].astype(kind))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~which))


def _new(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which keys this task has not met before."""
    fresh = np.zeros(len(keys), dtype=bool)
    firsts = np.unique(keys, return_index=True)[1]
    for i in firsts:
        if (k := int(keys[i])) not in seen:
            seen.add(k)
            fresh[i] = True
    return fresh


def _lines(counts: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for first, end, data in _chunks(texts):
                lines = Lines(data, counts)
                n_lines = np.array([t.as_py().count(b"\n") + 1 for t in texts[first:end]])
                starts = np.concatenate(([0], np.cumsum(n_lines)))
                doc = np.searchsorted(starts, lines.line, side="right") - 1
                # sets of up to 3 tokens match equal sets alone
                joins = percent * (lines.size + 1) <= 100 * lines.size
                prefix = lines.size - -(-percent * lines.size // 100) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(pa.array(doc + first)),
                        pa.array((lines.line - starts[doc]).astype(np.int32)),
                        pa.array(lines.key),
                        pa.array(lines.size.astype(np.int32)),
                        *map(pa.array, lines.parities),
                        *map(pa.array, lines.mins),
                        # candidates may be too many but not too few: 32 bits of a token are enough
                        lines.heads(_new(lines.key, seen) & joins, prefix, np.int32),
                    ],
                    ["_id", "line", "key", "size", "p", "q", "m1", "m2", "prefix"],
                )

    return run


def _spot(ids, line):
    """A place in a bitmap for a line of a document; numbers stay below 2**53."""
    return (ids % _SPOT_IDS) * _SPOT_STEP + line * 7919


def _sets(counts: np.ndarray, wanted: np.ndarray):
    """The whole sets of the lines whose spot's bit is set; no other line's words are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            n_lines = np.array([t.as_py().count(b"\n") + 1 for t in texts], np.int64)
            before = np.cumsum(n_lines) - n_lines
            cuts = np.flatnonzero(np.diff(before // _CHUNK_LINES)) + 1
            for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):  # documents of about a chunk's lines
                starts, n = before[first:end] - before[first], n_lines[first:end]
                line = np.arange(n.sum()) - np.repeat(starts, n)
                spots = _spot(np.repeat(ids[first:end], n), line) & (len(wanted) - 1)
                hits = np.flatnonzero(wanted[spots])
                docs = np.searchsorted(starts, hits, "right") - 1
                which, at = np.unique(docs, return_index=True)
                numbers, ends, picked = line[hits].tolist(), [*at[1:].tolist(), len(docs)], []
                for doc, low, high in zip(which.tolist(), at.tolist(), ends):
                    own = texts[first + doc].as_py().split(b"\n")
                    picked += [own[i] for i in numbers[low:high]]
                for _, _, data in _chunks(pa.array(picked, pa.binary())):
                    lines = Lines(data, counts)
                    new = _new(lines.key, seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lines.key[new]), lines.heads(new, lines.size).filter(pa.array(new))], ["key", "tokens"]
                    )

    return run


def _close_pairs(w: np.ndarray, key: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by ``w``, that share a token and can reach the threshold."""
    size, at = w >> 13 & _MOST_SIZE, w >> 1 & _MOST_AT
    left = size - at
    # rows of a token are in order of size: a row meets those after it that are not too large
    largest = np.minimum(100 * size // percent, _MOST_SIZE)
    ends = np.searchsorted(w, w >> 32 << 32 | largest << 13 | 0x1FFF, "right")
    n = np.where(left * (100 + percent) >= 2 * percent * size, ends - np.arange(len(w)) - 1, 0)
    done, last = np.cumsum(n), 0
    while last < len(n):
        first, before = last, done[last - 1] if last else 0
        last = max(first + 1, int(np.searchsorted(done, before + _PAIRS, "right")))
        own = n[first:last]
        i = np.repeat(np.arange(first, last), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        sizes = size[i] + size[j]
        # the first token that two sets share has all their common tokens at or after it
        ok = np.minimum(left[i], left[j]) * (100 + percent) >= percent * sizes
        # of two settled lines neither has anything left to find
        ok &= (w[i] & w[j] & 1) == 0
        i, j, sizes = i[ok], j[ok], sizes[ok]
        # of signed numbers numpy counts the bits of the absolute value
        differ = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in (p, q))
        ok = (100 + percent) * differ <= (100 - percent) * sizes
        a, b = key[i[ok]], key[j[ok]]
        yield np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def _meet(percent: int, most: int):
    """Pairs of the rows (w, key, p, q) that share a token, from rows sorted by
    ``w``. Of a token with more than ``most`` rows the rows go on themselves,
    with ``w``: a task holds no more of one token than that."""

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in _close_pairs(*rows, percent):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none], names)

    def rest(rows: list[np.ndarray]) -> pa.RecordBatch:
        w, key, p, q = map(pa.array, rows)
        return pa.RecordBatch.from_arrays([key, pa.nulls(len(key), pa.int64()), w, p, q], names)

    names = ["a", "b", "w", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, passed = [], 0, None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if passed is not None:  # the token that is passed on may go on
                end = int(np.searchsorted(rows[0] >> 32, passed, "right"))
                if end:
                    yield rest([r[:end] for r in rows])
                rows = [r[end:] for r in rows]
            if not len(rows[0]):
                continue
            passed = None
            held.append(rows)
            n += len(rows[0])
            if n < most:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            token = rows[0] >> 32
            last = int(np.searchsorted(token, token[-1]))
            yield from pairs([r[:last] for r in rows])
            held, n = [[r[last:] for r in rows]], n - last
            if n > most:
                yield rest(held[0])
                held, n, passed = [], 0, token[-1]
        if n:
            yield from pairs([np.concatenate(c) for c in zip(*held)])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written; what its query has shuffled need not lie beside the next."""
    with shuffles_go(df.sparkSession):
        return written(df, name)


def repeated_lines(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that repeat an earlier line: ``id_col``, removed (line numbers from
    0, sorted), one row per document that has any.

    A line is what stands between line feeds; its tokens are the different
    words (runs outside [\\x20\\x09-\\x0D], A-Z lower-cased). A line repeats an
    earlier one, in order of (id, line number), if their sets of tokens have a
    Jaccard similarity of at least ``percent`` per cent; whether the earlier
    one stays does not matter. Lines without words stay.

    1. A frequency sketch of all words gives the order of rarity.
    2. Lines with equal sets are one class, with its first occurrence. Classes
       meet on the tokens of their prefix (n - ceil(percent n) + 1 rarest); sizes
       and positions must leave room for the threshold, and 128 parities must
       not differ in more places than the sets may in tokens.
       Rows of a token are sorted by size in one task, up to 65,536 of them; those
       of a more common token are joined, which spreads them over tasks.
    3. What meets is confirmed on the whole sets, read again for those classes.

    Before step 2 every class is compared with the first 8 lines that share its
    smallest token under either of two hash functions. Lines that this settles
    are not paired with each other any more, so a group of near copies costs
    its size and not its square; what is found does not depend on it.

    Null texts are empty; rows that share an id count as one document; rows
    with a null id are left alone; other columns are not read.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")
    )
    counted = docs.select("_text").mapInArrow(_count_words, "counter long, n long")
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    for r in counted.groupBy("counter").agg(F.sum("n").alias("n")).collect():  # at most _COUNTERS rows
        counts[r["counter"]] = r["n"]
    # counts above 16 bits are as common as can be told
    counts = np.minimum(counts, 0xFFFF).astype(np.uint16)

    lines = docs.mapInArrow(_lines(counts, percent), "_id long, line int, key long, size int, p long, q long, m1 long, m2 long, prefix array<int>")
    lines = _kept(lines, "lines")
    classes = lines.groupBy("key").agg(F.min(F.struct("_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = _kept(classes, "line-classes")

    # several tasks may bring a line that repeats; other lines need no shuffle to be brought once
    rows = lines.where("prefix is not null").withColumn("place", F.struct("_id", "line"))
    rows = rows.select("key", "place", "size", "p", "q", "m1", "m2", "prefix")
    rows = sifted(rows, sieve(classes.where("n > 1"), ["key"]), ["key"])
    many = rows.where("_hit").groupBy("key").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in rows.columns[2:-1]])
    one = _kept(rows.where("not _hit").drop("_hit").unionByName(many), "line-firsts")

    def near(n, p, q, m, r, s):
        """Whether sets of n and m tokens with these parities can reach the threshold."""
        differ = F.bit_count(p.bitwiseXOR(r)) + F.bit_count(q.bitwiseXOR(s))
        return F.lit(100 + percent) * differ <= F.lit(100 - percent) * (n + m)

    def later(pairs: DataFrame) -> DataFrame:
        """Of every pair (a, b) that is similar, the class that comes later."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
        places = sifted(classes.select("key", "first"), sieve(ends, ["key"]), ["key"]).where("_hit")
        spot = _spot(F.pmod("first._id", F.lit(_SPOT_IDS)), F.col("first.line").cast("long"))
        wanted = bits(places.select(spot.alias("spot")), "spot")
        sets = docs.mapInArrow(_sets(counts, wanted), "key long, tokens array<long>").dropDuplicates(["key"])
        sets = _kept(sets, "line-sets")
        x = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
        similar = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
        firsts = classes.select("key", "first")
        found = (
            similar.join(firsts.select(F.col("key").alias("a"), F.col("first").alias("fa")), "a")
            .join(firsts.select(F.col("key").alias("b"), F.col("first").alias("fb")), "b")
            .select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("key"))
        )
        return _kept(found.distinct(), "later-lines")

    # near copies meet the first lines that share their smallest token under a hash function
    buckets = one.select("key", "place", "size", "p", "q", F.explode(F.array("m1", "m2")).alias("m"))
    by_place = Window.partitionBy("m").orderBy("place")
    firsts = buckets.withColumn("_k", F.row_number().over(by_place)).where(F.col("_k") <= _HUBS)
    hubs = firsts.select("m", F.struct("place", "key", "size", "p", "q").alias("hub"))
    stars = buckets.join(hubs, "m").where(F.col("hub.place") < F.col("place"))
    stars = stars.where(near(*[F.col(c) for c in ("size", "p", "q", "hub.size", "hub.p", "hub.q")]))
    ends = F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")
    settled = later(_kept(stars.select(*ends).distinct(), "line-stars"))

    # token, size, place and whether the line is settled in one word: four words a row are shuffled, once
    flagged = sifted(one, sieve(settled, ["key"]), ["key"])
    sure = flagged.where("_hit").drop("_hit").join(settled.withColumn("_settled", F.lit(1)), "key", "left")
    flagged = flagged.where("not _hit").drop("_hit").withColumn("_settled", F.lit(0)).unionByName(sure)
    met = flagged.select("key", "size", "p", "q", F.coalesce("_settled", F.lit(0)).alias("_settled"), F.posexplode("prefix").alias("at", "token"))
    # a place or a size too large for its bits counts as the largest that fits, which filters less
    low = F.shiftleft(F.least("size", F.lit(_MOST_SIZE)).cast("long"), 13)
    low = low.bitwiseOR(F.shiftleft(F.least("at", F.lit(_MOST_AT)).cast("long"), 1)).bitwiseOR(F.col("_settled").cast("long"))
    met = met.select(F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(low).alias("w"), "key", "p", "q")
    met = met.repartition(F.shiftright("w", 32)).sortWithinPartitions("w")
    met = _kept(met.mapInArrow(_meet(percent, _MOST), "a long, b long, w long, p long, q long"), "line-meets")

    # rows of a token that too many lines share are joined: a join spreads them over tasks
    common = met.where("w is not null")
    x = common.select("w", "a", "p", "q")
    y = common.select(F.col("w").alias("v"), F.col("a").alias("b"), F.col("p").alias("r"), F.col("q").alias("s"))
    size = lambda w: F.shiftrightunsigned(F.col(w), 13).bitwiseAND(F.lit(_MOST_SIZE))
    left = lambda w: size(w) - F.shiftrightunsigned(F.col(w), 1).bitwiseAND(F.lit(_MOST_AT))
    room = F.least(left("w"), left("v")) * F.lit(100 + percent) >= F.lit(percent) * (size("w") + size("v"))
    open_ = F.col("w").bitwiseAND(F.col("v")).bitwiseAND(F.lit(1)) == 0
    same = F.shiftright(F.col("w"), 32) == F.shiftright(F.col("v"), 32)
    close = near(size("w"), F.col("p"), F.col("q"), size("v"), F.col("r"), F.col("s"))
    pairs = x.join(y, same & (F.col("a") < F.col("b")) & open_ & room & close)
    pairs = pairs.select("a", "b").unionByName(met.where("w is null").select("a", "b"))
    found = later(_kept(pairs.select("a", "b").distinct(), "line-pairs"))
    later_ones = settled.unionByName(found).distinct().withColumn("_later", F.lit(True))
    decided = classes.join(later_ones, "key", "left").where("n > 1 or _later")
    removed = lines.select("_id", "line", "key").join(decided, "key")
    removed = removed.where("_later or first._id <> _id or first.line <> line")
    return removed.groupBy(F.col("_id").alias(id_col)).agg(F.array_sort(F.collect_set("line")).alias("removed"))


def without_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the lines in ``removed`` taken out of its texts. A document
    of which no line with words is left goes; one that had none stays."""
    whole, touched = split_rows(df, removed.select(F.col(id_col).cast("long").alias("_rid")), id_col)
    by_id = removed.select(F.col(id_col).alias("_rid"), F.col("removed").alias("_removed"))
    cut = touched.join(by_id, F.col(id_col) == F.col("_rid"), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("_removed", i))
    cut = cut.withColumn("_left", F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    gone = F.col("_removed").isNotNull() & (F.trim(F.translate("_left", "\t\n\x0b\x0c\r", "     ")) == "")
    cut = cut.where(~gone).select(*[F.col("_left").alias(c) if c == text_col else F.col(c) for c in df.columns])
    return whole.unionByName(cut)
