"""Incremental person import: new JSON-lines files in a drop folder are
validated (S2) and upserted (S3) into a bucketed Parquet table.

The stream is ``readStream.text(drop_dir)`` with ``trigger(availableNow=True)``:
each run processes the files that arrived since the last one, then stops.
The checkpoint (in the shared folder named by ``spark.checkpoint.dir``
unless given) records which files were done, so a restarted or failed run
resumes exactly there. Each micro-batch rewrites the buckets that its ids fall
into (``BucketTable``) and makes the table's next version; versions are numbered
from those there are and not from the batch, so a new checkpoint goes on with
the table as it is. A batch that runs again after its version was written
changes nothing. Rejected lines go to ``<table>_rejects/v=<n>``, the counters of
a batch (A7) to ``<table>_counters/v=<n>``: they are observed in the job that
writes its lines, not counted again.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholargraph.session import ensure_checkpoint_dir
from scholargraph.sources.jsonl import split_lines
from scholargraph.streaming.buckets import BucketTable

TABLE = "id string, fullName string, data string, imported_at timestamp"


def person_store(spark: SparkSession, table_dir: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, table_dir, TABLE, ["id"], buckets)


def read_current(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The latest complete version of the person table, or None."""
    store = person_store(spark, table_dir)
    return store.read() if store.versions() else None


def merge_batch(spark: SparkSession, table_dir: str, batch: DataFrame, batch_id: int, source: str = "import", buckets: int = 64) -> None:
    """Validate one micro-batch of lines and upsert it into the person table.

    Later lines win: lines are ordered by batch, file, place of their block in
    the file, and row (which ascends within a block)."""
    store = person_store(spark, table_dir, buckets)
    if store.holds((source, batch_id)):
        return
    lines = batch.select(
        "value",
        F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col("_file").alias("file"), F.col("_block").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("seq"),
    )
    version = store.manifest()["version"] + 1
    valid, rejects, counters = split_lines(lines)
    side = table_dir.rstrip("/")
    rejects.write.mode("overwrite").parquet(f"{side}_rejects/v={version}")
    counters.write.mode("overwrite").parquet(f"{side}_counters/v={version}")
    store.upsert(valid.withColumn("imported_at", F.current_timestamp()), batch=(source, batch_id))


def start_import(spark: SparkSession, drop_dir: str, table_dir: str, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the availableNow stream; call ``.awaitTermination()`` on the result."""
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "person-import")
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(drop_dir).select("value", F.col("_metadata.file_path").alias("_file"),
                                          F.col("_metadata.file_block_start").alias("_block"))
    return (
        # a checkpoint numbers its batches, so it names them
        lines.writeStream.foreachBatch(lambda df, bid: merge_batch(spark, table_dir, df, bid, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
