"""Spark session and checkpoint-folder helpers."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int | None = None, app: str = "scholargraph") -> SparkSession:
    """Session tuned for the library: AQE on, UTC clock, no web UI.

    On a cluster the master, memory and number of shuffle partitions come from
    spark-submit; only the settings below are ours, and ``partitions`` if given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it. Only a local run, where driver and executors are one
    process, gets a scratch folder when it is unset; elsewhere executors would
    write to disks of their own, so that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sg-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
    except Exception:  # remote session: the folder is still used for written tables
        pass
    return conf_dir


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` once as a Parquet table in the shared checkpoint folder.

    Used where an expensive intermediate (e.g. tokenised texts) feeds
    several consumers: they all read the written table instead of
    recomputing it, and a lost executor does not send the work back to the
    scan. Unlike ``Dataset.checkpoint`` the plan runs once (no second pass
    to write the checkpoint), and the table is columnar and compressed.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


#: Folders of the intermediate tables that this process has written.
_WRITTEN: list[str] = []


class IntermediateTables:
    """Deletes, at the end of the block, the intermediate tables written in it.

    For use around a result that has been written somewhere else: what is
    built in the block must not be read afterwards. ``keep`` names a frame
    whose own table stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept, self.start = spark, set(), len(_WRITTEN)

    def __enter__(self) -> IntermediateTables:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept |= {p for p in _WRITTEN[self.start :] if any(p.rpartition("/")[2] in f for f in df.inputFiles()[:1])}
        return df

    def __exit__(self, *error) -> None:
        jvm = self.spark._jvm
        for path in [p for p in _WRITTEN[self.start :] if p not in self.kept]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            _WRITTEN.remove(path)


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def spread(df: DataFrame, min_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Re-spread a scan that has fewer splits than the cluster has cores.

    A single unsplittable file (one Parquet row group, a gzip dump) is read
    by one task; per-row work that follows (tokenising whole texts) would
    then run on one core. Large inputs already have many splits and are
    returned unchanged, so this never adds a shuffle at scale; so are
    small scans (under ``min_bytes``), where one task is enough.
    """
    from scholargraph.functions.joins import estimated_bytes

    try:
        size = estimated_bytes(df)
        if size is not None and size < min_bytes:
            return df
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() * 2 <= cores:
            return df.repartition(cores)
    except Exception:  # no RDD access (remote session): leave the scan as is
        pass
    return df
