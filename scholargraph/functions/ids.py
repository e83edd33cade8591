"""Identifiers: stable hash ids and a distributed dense index."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_id(*cols) -> Column:
    """BIGINT id from the first 60 bits of md5 over the natural key.

    The same key always gives the same id, so re-runs reuse ids and two
    batches creating the same key agree without coordination. Keys are
    joined with a U+0001 separator.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    key = parts[0].cast("string") if len(parts) == 1 else F.concat_ws("\u0001", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def dense_index(df: DataFrame, order_cols: list, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order_cols``.

    Equivalent to ``row_number() OVER (ORDER BY ...)`` without moving every
    row into one task. Rows are range-partitioned on the order and sorted
    inside each partition; ``monotonically_increasing_id`` then encodes
    (partition index, position in partition) in one pass (adaptive
    coalescing only merges adjacent ranges, so the order holds). That
    result is written once to the shared checkpoint folder, so the
    per-partition counts and the numbering read the same rows; a prefix
    sum over the (few) counts gives each partition's offset.
    ``order_cols`` (names or sort expressions) must identify rows uniquely.
    """
    from scholargraph.session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()), "dense-index")
    low = (1 << 33) - 1
    ranged = ranged.withColumn("_pid", F.shiftright("_m", 33)).withColumn("_lrn", F.col("_m").bitwiseAND(F.lit(low)) + 1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_pid", "_off")
    # offsets has one row per partition: bounded by the partition count.
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_lrn")).cast("bigint"))
        .drop("_pid", "_lrn", "_off", "_m")
    )


def rank_within(df: DataFrame, group_cols: list[str], order: list, name: str = "rank") -> DataFrame:
    """``row_number()`` inside each group, for groups of any size.

    A window partitioned by the group sorts each whole group in one task;
    here a group holding a third of the rows is spread like any other: the
    rows get their position in the global (group, order) sort
    (``dense_index``) and the rank is that position minus the group's first
    position (a partial ``min`` per group). ``order`` must make rows unique
    inside a group.
    """
    idx = dense_index(df.dropna(subset=group_cols), [F.col(c).asc() for c in group_cols] + list(order), "_gidx")
    starts = idx.groupBy(*group_cols).agg(F.min("_gidx").alias("_start"))
    # a left join: the rows, whose written file may be tiny, are never broadcast
    return idx.join(starts, group_cols, "left").withColumn(name, F.col("_gidx") - F.col("_start") + 1).drop("_gidx", "_start")
