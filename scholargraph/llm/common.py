"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholargraph.session import cut_lineage

#: Low 33 bits of monotonically_increasing_id: the row's place in its partition.
_ROW_MASK = (1 << 33) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read again."""
    return cut_lineage(df, name)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """In the block, a query's shuffle files go when it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Bits of one bitmap row (fixed by Spark's bitmap functions).
_BITMAP_BITS = 32768


def sieve(keys: DataFrame, cols: list[str], rows: int = 256) -> DataFrame:
    """A bitmap of ``rows`` x 32,768 bits (1 MB as set, whatever the input) in
    which the bit of every key of ``keys`` is set."""
    bit = F.pmod(F.xxhash64(*cols), F.lit(rows * _BITMAP_BITS))
    placed = keys.select(
        F.floor(bit / F.lit(_BITMAP_BITS)).alias("_bucket"), F.pmod(bit, F.lit(_BITMAP_BITS)).alias("_place")
    )
    return placed.groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_place)").alias("_bits"))


def sifted(df: DataFrame, bitmap: DataFrame, cols: list[str], rows: int = 256) -> DataFrame:
    """Adds ``_hit``: whether the bitmap has the row's key. Rows are tested
    where they are read; a key that is in the bitmap always hits, another one
    rarely does, so what follows must be exact by itself."""
    bit = F.pmod(F.xxhash64(*cols), F.lit(rows * _BITMAP_BITS))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("_place", F.lit(8)))), F.lit(2)) == 1
    names = df.columns
    return (
        df.withColumn("_bucket", F.floor(bit / F.lit(_BITMAP_BITS)))
        .withColumn("_place", F.pmod(bit, F.lit(_BITMAP_BITS)))
        # at most ``rows`` rows of 4 KB
        .join(F.broadcast(bitmap), "_bucket", "left")
        .select(*names, F.coalesce(F.col("_bits").isNotNull() & hit, F.lit(False)).alias("_hit"))
    )


def split_rows(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows that surely have no id in ``ids`` (its only column) and
    the rest, told apart in the scan: a join with ``ids`` need only shuffle the
    rest."""
    marked = sifted(df, sieve(ids, ids.columns), [id_col])
    return marked.where("not _hit").drop("_hit"), marked.where("_hit").drop("_hit")


def bits(keys: DataFrame, key: str, rows: int = 256) -> np.ndarray:
    """A bitmap of rows x 32,768 bits (1 MB as set) of the low bits of ``key``."""
    place = F.col(key).bitwiseAND(F.lit(rows * 32768 - 1))
    bitmap = (
        keys.select(F.shiftright(place, 15).alias("_bucket"), place.bitwiseAND(F.lit(32767)).alias("_place"))
        .groupBy("_bucket")
        .agg(F.expr("bitmap_construct_agg(_place)").alias("_bits"))
    )
    out = np.zeros((rows, 32768), dtype=bool)
    for r in bitmap.collect():  # at most ``rows`` rows of 4 KB
        out[r["_bucket"]] = np.unpackbits(np.frombuffer(r["_bits"], np.uint8), bitorder="little")
    return out.reshape(-1)


def running_totals(df: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """Each row's place and running sums in the total order ``order``.

    Rows are range-partitioned and sorted, written once, and summed inside
    their partition; a prefix sum over the per-partition totals (as many rows
    as partitions) gives what lies before the partition. Adds ``_row`` (from
    0) and ``_before_<c>`` for every c of ``sums``. No task gets more than its
    range, whatever the keys are, as long as ``order`` tells rows apart.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "running-totals")
    ranged = ranged.withColumn("_pid", F.shiftright("_m", 33))
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums],
    )
    inside = Window.partitionBy("_pid").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_before_{c}") for c in sums])
    # one row per partition: bounded by the partition count
    out = out.join(F.broadcast(offsets), "_pid")
    out = out.withColumn("_row", F.col("_n") + F.col("_m").bitwiseAND(F.lit(_ROW_MASK)))
    for c in sums:
        out = out.withColumn(f"_before_{c}", F.col(f"_before_{c}") + F.col(f"_t_{c}"))
    return out.drop("_pid", "_m", "_n", *[f"_t_{c}" for c in sums])


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal disjoint runs, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[first], ends[np.concatenate((first[1:], [True]))]


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, spans): the union of the rows (doc, start, end) of a document, as
    sorted disjoint runs array<struct<start, end>>. A document's own spans are
    gathered, not those of a key that documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = [0], [[], []]
            for row in batch.column(1):
                both = row.values.flatten()
                for part, joined in zip(parts, joined_spans(*(x.to_numpy() for x in both))):
                    part.append(joined)
                sizes.append(sizes[-1] + len(parts[0][-1]))
            flat = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)) for p in parts]
            runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs], ["doc", "spans"])

    place = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    gathered = spans.groupBy("doc").agg(F.collect_list(place).alias("a"))
    return gathered.mapInArrow(run, "doc long, spans array<struct<start:long,end:long>>")
