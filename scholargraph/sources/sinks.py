"""Sinks: tables written to a new path, reports written as text."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet to a fresh path (swap paths afterwards; never overwrite an input)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(sections: DataFrame, path: str) -> None:
    """S6 sink: Markdown sections as text, ordered by (category, axis)."""
    ordered = sections.orderBy(F.col("category"), F.col("axis").asc_nulls_first())
    ordered.select("section").write.mode("errorifexists").text(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """S7 sink: one GeoJSON feature per line (newline-delimited GeoJSON)."""
    features.select("feature").write.mode("errorifexists").text(path)
