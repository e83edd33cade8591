"""C1 as a stream: micro-batches of vote changes on a bucketed vote table.

A change meets its vote as the batches before have left it; the table keeps of
every vote who changed it last and when, so that a log gives the same table
however it is cut into batches, as long as they come in its order. A batch that
runs again after it was written changes nothing; one that died before is run
again on the table it began with.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scholargraph.operators.votes import vote_changes
from scholargraph.session import cut_lineage, ensure_checkpoint_dir
from scholargraph.streaming.buckets import BucketTable

VOTES = "vote_id bigint, person_id bigint, concept_id bigint, rank bigint, owner_id bigint, kind string, user_id bigint, day string"
CHANGES = "op string, vote_id bigint, person_id bigint, concept_id bigint, rank bigint, user_id bigint, day string, seq bigint"


def vote_store(spark: SparkSession, table_dir: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, table_dir, VOTES, ["vote_id"], buckets)


def apply_changes(store: BucketTable, changes: DataFrame, rules: DataFrame, person_labs: DataFrame,
                  batch: tuple[str, int] | None = None, errors_to: str | None = None) -> DataFrame | None:
    """Replay one batch of changes on the votes of the buckets it touches; the
    errors, or None if the batch is in already. ``errors_to``: a folder they are
    written to before the batch counts, so a batch that counts has its errors."""
    changes = cut_lineage(changes, "vote-changes")
    columns, errors = [c.split()[0] for c in VOTES.split(", ")], []

    def replayed(votes: DataFrame) -> DataFrame:
        decided, failed = vote_changes(votes, changes, rules, person_labs)
        if errors_to:
            failed.write.mode("overwrite").parquet(errors_to)
        errors.append(failed)
        return decided.select(*columns)

    return errors[0] if store.change(changes, replayed, batch) and errors else None


def start_votes(spark: SparkSession, log_dir: str, table_dir: str, rules: DataFrame, person_labs: DataFrame, checkpoint: str | None = None,
                max_files_per_trigger: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Start the availableNow stream over Parquet files of ``CHANGES`` in
    ``log_dir``, taken oldest first; errors go to ``<table>_errors/v=<batch>``."""
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "vote-changes")
    store = vote_store(spark, table_dir, buckets)

    def batch(df: DataFrame, number: int) -> None:
        apply_changes(store, df, rules, person_labs, (checkpoint, number), f"{table_dir.rstrip('/')}_errors/v={number}")

    reader = spark.readStream.schema(CHANGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(log_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
