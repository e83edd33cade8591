"""Refresh organisation items from the structure register."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.text import strip_ws
from scholargraph.operators.graph import REFERENCED_BY, merge_statements, statements_frame
from scholargraph.sources.register import KEY, register_statements, scan_register


def enrich_structures(items: DataFrame, statements: DataFrame, register: DataFrame,
                      org_class: str = "foaf:Organization") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Organisation items with a reference, updated from the register.

    The item reference (trimmed) joins the latest register record of that
    number (S4); the record's fields become statements (P4) and are merged
    ``append_distinct`` (J6) into the item's statements. Returns
    ``(merged, status, counters)``: merged statements of updated items,
    ``status(item_id, status)`` with ``updated`` / ``skipped``, and the
    processed / updated / skipped counts (A7).
    """
    orgs = items.where(F.col("class") == org_class).select("item_id")
    refs = (
        statements.where((F.col("property") == REFERENCED_BY) & F.col("value").isNotNull())
        .join(orgs, "item_id", "left_semi")
        .groupBy("item_id")
        .agg(F.min(strip_ws("value")).alias(KEY))
    )
    latest = scan_register(register)
    new = register_statements(latest)
    upd = refs.join(new, KEY).select(
        "item_id", "property", "type",
        F.when(F.col("type") != "uri", F.col("value")).alias("value"),
        F.when(F.col("type") == "uri", F.col("value")).alias("uri"),
    )
    updated = upd.select("item_id").distinct()
    status = refs.select("item_id").join(updated.withColumn("_u", F.lit(1)), "item_id", "left").select(
        "item_id", F.when(F.col("_u").isNotNull(), "updated").otherwise("skipped").alias("status")
    )
    own = statements.join(updated, "item_id", "left_semi")
    merged = merge_statements(own, statements_frame(upd), "append_distinct")
    counters = status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("status").alias("counter"), "n"
    ).unionByName(status.agg(F.count(F.lit(1)).alias("n")).select(F.lit("processed").alias("counter"), "n"))
    return merged, status, counters
