"""Lookups by id and dimension tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.ids import stable_id
from scholargraph.functions.joins import bounded_broadcast


def lookup_by_id(table: DataFrame, ids: DataFrame, id_col: str = "id", value_col: str = "fullName") -> DataFrame:
    """F8: batch get by id with a status instead of exceptions.

    Output ``(id, status, n_matches, <value_col>)``: status is ``found``
    (one row), ``missing`` or ``ambiguous`` (several rows); the value is
    given only when found. The table is first cut to the requested ids by
    a semi join, so only matching rows are shuffled and counted.
    """
    req = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    hits = (
        table.join(bounded_broadcast(req), id_col, "left_semi")
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("n_matches"), F.max(value_col).alias("_v"))
    )
    j = req.join(hits, id_col, "left")
    n = F.coalesce(F.col("n_matches"), F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return j.select(
        id_col, status.alias("status"), n.alias("n_matches"), F.when(n == 1, F.col("_v")).alias(value_col)
    )


def build_dimension(entries: DataFrame, key: str, label: str, id_name: str = "dim_id") -> DataFrame:
    """Deduplicated dimension with a stable surrogate key.

    One row per natural key: smallest label, entry count, and an id
    hashed from the key (``stable_id``), so re-runs and separate batches
    give the same ids without a global numbering pass.
    """
    return (
        entries.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias(label), F.count(F.lit(1)).alias("n_entries"))
        .withColumn(id_name, stable_id(key))
    )
