"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.common import sieve, sifted, text_or_empty, written
from scholargraph.llm.components import components
from scholargraph.llm.words import hash_words, lower_ascii, mix, shingles

#: Shingles hashed at a time, so a long text needs no more memory.
_BLOCK = 8192


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingles(hash_words(lower_ascii(text))[2], k))


class MinMax:
    """Smallest and largest hash of a set under ``permutations`` hash functions,
    folded into bands of ``rows`` values."""

    def __init__(self, permutations: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 63, size=(permutations, 1), dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, size=(permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.rows, self.bands = rows, 2 * permutations // rows

    def band_keys(self, items: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(items), _BLOCK):
            h = (items[None, at : at + _BLOCK] ^ self.xor) * self.mul
            least, most = h.min(axis=1), h.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        values = np.concatenate((low, high))[: self.bands * self.rows].reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = mix(key + values[:, r])
        return key.view(np.int64)


def _signatures(k: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(permutations, rows)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                items = shingle_set(text.as_py(), k)
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                bands.append(minmax.band_keys(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["_id", "n", "set_key", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "items"])

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


def near_duplicates(
    df: DataFrame,
    k: int = 5,
    percent: int = 80,
    permutations: int = 56,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their sets of
    ``k``-word shingles, at least ``percent`` per cent.

    A-Z are lower-cased; words are runs outside [\\x20\\x09-\\x0D]; a shorter
    text is one shingle, one without words has an empty set and is linked with
    nothing.

    Both the smallest and the largest value under each of ``permutations``
    hash functions go into the signature; its 2 x permutations values make
    bands of ``rows``. With 56 and 4, a pair at 0.8 shares no band with
    probability (1 - 0.8^4)^28 = 4e-7.

    1. Documents with equal sets are one class, named by its smallest id.
    2. In every bucket (classes sharing a band) all classes are compared with
       one hub, so a bucket of n gives n - 1 pairs. Links join components.
    3. Classes of buckets that still hold several components are compared
       across components wherever a prefix filter over their full sets leaves
       a chance, so no link that could join two components is missed.

    Pairs are confirmed on the full sets, which are made again for classes in
    a pair only, found in the scan through a bitmap of bounded size.

    Returns ``id_col``, n_shingles, component_id (smallest id reachable,
    itself included), kept (the id is its component's). Null texts are empty.
    Rows with a null id are linked with nothing: component null, kept. Repeated
    rows of one id each have their row, all kept or none; an empty table gives
    no rows; other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    signed = docs.mapInArrow(_signatures(k, permutations, rows), "_id long, n long, set_key binary, bands array<long>")
    signed = written(signed, "minmax-signatures")
    classes = signed.where("n > 0 and _id is not null").groupBy("set_key").agg(F.min("_id").alias("cls"))
    linked = links(docs, signed, classes, k, percent)
    labels = components(linked)
    joined = (
        signed.drop("bands")
        .join(classes, "set_key", "left")
        .join(labels, F.col("cls") == F.col("node"), "left")
        .withColumn("component_id", F.when(F.col("_id").isNotNull(), F.coalesce("component", "cls", "_id")))
    )
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("_id")).alias("kept"),
    )


def links(docs: DataFrame, signed: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between classes that join all classes that any links join."""
    # a class's signature is that of its smallest id
    ours = classes.withColumnRenamed("cls", "_id")
    reps = signed.join(ours, ["set_key", "_id"], "left_semi").dropDuplicates(["set_key"])
    in_bands = reps.select(F.col("_id").alias("cls"), "n", F.explode("bands").alias("band"))
    hubs = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("cls", "n")).alias("hub")).where("_c > 1")
    shared = written(in_bands.join(hubs.select("band", "hub"), "band"), "minmax-buckets")
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes of sets that can be linked
    star = (
        shared.where(F.col("cls") != F.col("hub.cls"))
        .where(close(F.col("n"), F.col("hub.n")))
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )
    star = written(star, "minmax-pairs")

    found = sifted(docs, sieve(shared.select("cls"), ["cls"]), ["_id"]).where("_hit")
    sets = written(found.select("_id", "_text").mapInArrow(_sets(k), "_id long, items array<long>"), "minmax-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("_id").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("_id").alias("b"), F.col("items").alias("y"))
        full = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
        return full.mapInArrow(_confirm(percent), "a long, b long")

    first = written(confirmed(star), "minmax-links")
    labels = components(first)
    named = shared.join(labels, F.col("cls") == F.col("node"), "left").select(
        "band", "cls", "n", F.coalesce("component", "cls").alias("c")
    )
    mixed = named.groupBy("band").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("band")
    rest = named.join(mixed, "band", "left_semi").select("cls", "n", "c").distinct()
    across = across_components(written(rest, "minmax-rest"), sets, percent).join(star, ["a", "b"], "left_anti")
    across = written(across, "minmax-across")
    return first.unionByName(confirmed(across))


def across_components(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of classes of different components in ``rest`` (cls,
    n, c) that can reach ``percent``, without pairing a bucket's classes.

    Prefix and positional filter: sets that reach the threshold share one of the first
    n - ceil(percent n) + 1 shingles of each in any common order. Rarest first,
    a class whose prefix holds only shingles that no other class of ``rest``
    has is done. Of a shingle, the classes outside its most frequent component
    are joined with all, so a large component is not paired with itself.
    """
    items = rest.join(sets, F.col("cls") == F.col("_id")).select("cls", "n", "c", F.explode("items").alias("item"))
    items = written(items, "minmax-items")
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = items.join(often, "item")
    # shingles of the prefix that are left after those that only this class has
    order = Window.partitionBy("cls").orderBy("df", "item")
    every = Window.partitionBy("cls")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1
    prefixes = (
        common.withColumn("_k", F.row_number().over(order))
        .withColumn("_alone", F.col("n") - F.count(F.lit(1)).over(every))
        .where(F.col("_k") <= prefix - F.col("_alone"))
        # what of the set lies from here on, this shingle included
        .select("item", "cls", "n", "c", (F.col("n") - F.col("_alone") - F.col("_k") + 1).alias("left"))
    )
    prefixes = written(prefixes, "minmax-prefixes")
    by_component = prefixes.groupBy("item", "c").agg(F.count(F.lit(1)).alias("_n"))
    main = by_component.groupBy("item").agg(
        F.max_by("c", F.struct("_n", "c")).alias("_main"), F.count(F.lit(1)).alias("_kinds")
    )
    main = main.where("_kinds > 1").select("item", "_main")
    minor = prefixes.join(main, "item").where("c <> _main")
    x = minor.select("item", F.col("cls").alias("_x"), F.col("n").alias("_nx"), F.col("c").alias("_cx"), F.col("left").alias("_lx"))
    y = prefixes.select("item", F.col("cls").alias("_y"), F.col("n").alias("_ny"), F.col("c").alias("_cy"), F.col("left").alias("_ly"))
    # the first shingle that two sets share has all their common shingles at or after it
    enough = F.lit(100 + percent) * F.least("_lx", "_ly") >= F.lit(percent) * (F.col("_nx") + F.col("_ny"))
    met = x.join(y, (x["item"] == y["item"]) & (x["_cx"] != y["_cy"]) & enough)
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
