"""Exact dedup by progressive refinement: length, prefix hash, full hash."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import sieve, sifted, text_or_empty, written

#: Characters that do not count: the class [\x20\x09-\x0D].
_BLANK = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, _BLANK, "")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = 128,
    sieve_rows: int = 256,
    digest: bool = False,
) -> DataFrame:
    """Group rows whose texts are equal after deleting blanks; keep one of each.

    1. Length: rows whose normalised length no other row has are unique.
    2. Prefix: of the rest, rows whose (length, hash of the first ``prefix``
       characters) is single are unique.
    3. Full: only rows of surviving (length, prefix) groups have their whole
       text hashed (SHA-256) and grouped by it.

    The survivors reach the second scan as a bitmap of ``sieve_rows`` x 32,768
    bits (1 MB as set, whatever the input), so texts are filtered where they
    are read and never shuffled; a false hit costs one more hash and changes
    nothing, as step 3 is exact. Groups are counted by partial aggregation, so
    a group holding a third of all rows is combined before the shuffle.

    Of a group the row with the most code points in its original text, then
    the smallest id, stays. Returns ``id_col``, keep_id, group_size, kept; with
    ``digest`` also text_sha256 of the normalised text, for every row. Null
    texts count as empty, all empty texts are one group. Repeated rows with
    one id share one decision. Other columns are not read.
    """
    text = text_or_empty(text_col)
    base = df.select(
        F.col(id_col).alias("_id"),
        F.char_length(text).alias("_points"),
        normalised(text).alias("_norm"),
    ).withColumn("_len", F.char_length("_norm"))
    base = base.withColumn("_prefix", F.xxhash64(F.substring("_norm", 1, prefix)))

    keys = base.select("_len", "_prefix")
    pairs = keys.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    lengths = pairs.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    groups = pairs.join(lengths, "_len", "left_semi").where("_n > 1")

    full = F.sha2(F.encode("_norm", "UTF-8"), 256)
    scanned = sifted(base, sieve(groups, ["_len", "_prefix"], sieve_rows), ["_len", "_prefix"], sieve_rows).select(
        "_id", "_points", "_hit", (full if digest else F.when(F.col("_hit"), full)).alias("_full")
    )
    scanned = written(scanned, "exact-dedup")

    survivors = scanned.where("_hit")
    kept = survivors.groupBy("_full").agg(
        F.min_by("_id", F.struct(-F.col("_points"), F.col("_id"))).alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    grouped = survivors.join(kept, "_full").select("_id", "keep_id", "group_size", "_full")
    alone = scanned.where(~F.col("_hit")).select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_full"
    )
    out = grouped.unionByName(alone)
    cols = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    return out.select(*cols, *([F.col("_full").alias("text_sha256")] if digest else []))
