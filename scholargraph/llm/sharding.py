"""Contiguous shards of near-equal bytes from global prefix sums."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import running_totals, text_or_empty


def shard_by_bytes(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row of ``df`` into ``n_shards`` contiguous shards of near-equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows are
    put in the total order (text hash, id), so equal texts lie side by side and
    a hot source or a hot group spreads like anything else. Per-partition
    totals give every row the bytes before it; the global line is cut at
    ``n_shards`` equal targets and a row goes where its middle byte falls.
    A shard is therefore off its target by at most the largest row. A group of
    equal texts that is no larger than the largest row goes whole where its own
    middle falls, within the same bound; larger groups are cut like rows.

    Returns ``id_col``, size, text_crc32, shard (int), slot (place in the
    shard, gapless from 0). Texts never leave the scan: only sizes and hashes
    are shuffled. Null ids and repeated rows are dealt like others; an empty
    table gives no rows. Columns other than id and text are not read.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(text_col), "UTF-8")).alias("text_crc32"),
        F.xxhash64(text_or_empty(text_col)).alias("_h"),
    )
    placed = running_totals(rows, [F.col("_h"), F.col("_id")], ["size"])
    groups = placed.groupBy("_h").agg(F.min("_before_size").alias("_g_before"), F.sum("size").alias("_g_size"))
    total, largest = groups.agg(F.sum("_g_size")).first()[0] or 1, placed.agg(F.max("size")).first()[0] or 1
    whole = F.col("_g_size") <= F.lit(largest)
    # twice the middle byte keeps the arithmetic in integers
    middle = F.when(whole, 2 * F.col("_g_before") + F.col("_g_size")).otherwise(
        2 * F.col("_before_size") + F.col("size")
    )
    # decimal: the product passes 64 bits at petabyte totals
    cut = F.floor(middle.cast("decimal(38,0)") * F.lit(n_shards) / F.lit(2 * total).cast("decimal(38,0)"))
    placed = placed.join(groups, "_h").withColumn("shard", F.least(cut.cast("int"), F.lit(n_shards - 1)))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    # one row per shard: bounded by n_shards
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
