"""Join helpers: broadcast only behind a proven size bound."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest estimated (on-disk) size we broadcast; in memory it may be several times more.
BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df`` (an upper-bound style estimate
    from file sizes and operator statistics); no job is run. None when the
    estimate is not available (e.g. a remote session)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())
    except Exception:
        return None


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is at most ``max_bytes``.

    Above the bound (or without an estimate) no hint is given: adaptive
    execution measures the real size at runtime and either broadcasts
    (under ``spark.sql.adaptive.autoBroadcastJoinThreshold``) or keeps a
    shuffled sort-merge join, so nothing unbounded is ever shipped.
    """
    est = estimated_bytes(df)
    if est is not None and est <= max_bytes:
        return F.broadcast(df)
    return df


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as JSON, counted by a job. For batches of
    queries, whose size the optimizer does not know."""
    return df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def measured_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame | None:
    """``df`` to be broadcast if it is measured to have at most ``max_bytes``, else None."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else None


def sized_join(batch: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> Callable[[DataFrame], DataFrame]:
    """How tables with about one row per row of ``batch`` go into a join:
    broadcast if the batch is measured small, else sorted and merged. Either
    way the other side is not broadcast: a file's size says little of it."""
    if measured_bytes(batch) <= max_bytes:
        return F.broadcast
    return lambda df: df.hint("merge")
