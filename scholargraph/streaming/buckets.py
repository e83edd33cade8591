"""A keyed Parquet table in hash buckets, changed by rewriting the buckets that
a batch touches.

``<table>/data/v=<n>-<name>/bucket=<b>/`` holds what the job that made version n
wrote for bucket b; ``<table>/manifest/<n>.json`` says which of them each bucket
is at, and which batches are in. A version counts when its manifest is there; manifests are
created, never replaced, so of two writers of one version one fails. Folders
that no manifest names (a job that died) are never read.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph.operators.upsert import upsert_by_key
from scholargraph.session import cut_lineage


class BucketTable:
    """A table with columns ``schema`` (DDL) and one row per ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ------------------------------------------------------------ manifest

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [st.getPath().getName() for st in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the last one); an empty one before any."""
        done = self.versions()
        if version is None:
            if not done:
                return {"version": -1, "buckets": {}, "batches": {}, "count": self.buckets}
            version = done[-1]
        stream = self._fs.open(self._path(f"manifest/{version}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Write the manifest under a name of its own, then give it its name, which fails if it is taken."""
        name = f"manifest/{manifest['version']}.json"
        aside = self._path(f"manifest/.{manifest['version']}-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(aside, self._path(name)):
            raise RuntimeError(f"{self.path}: version {manifest['version']} was written by another job")

    # ---------------------------------------------------------------- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self._count())).cast("int")

    def _count(self) -> int:
        """The number of buckets stays as the table was begun."""
        return self.manifest()["count"]

    def _folders(self, manifest: dict, only: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(manifest["buckets"].items(), key=lambda x: int(x[0])) if only is None or int(b) in only]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the last one)."""
        return self._rows(self._folders(self.manifest(version)))

    def holds(self, batch: tuple[str, int] | None) -> bool:
        """Whether a batch (source, number) is in."""
        return batch is not None and self.manifest()["batches"].get(batch[0], -1) >= batch[1]

    def change(self, keys: DataFrame | None, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Apply ``change`` to the rows of all buckets that hold a key of
        ``keys`` (None: of all buckets).

        Other buckets keep their files. ``batch`` names a source and its number:
        a batch that is in already changes nothing (False). ``change`` gets the
        rows of the touched buckets and returns what they shall be; its keys
        must lie in them.
        """
        if self.holds(batch):
            return False
        manifest = self.manifest()
        touched = set(range(manifest["count"]))
        if keys is not None:  # at most as many numbers as there are buckets
            touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        version = manifest["version"] + 1
        name = f"{version}-{uuid.uuid4().hex[:8]}"
        filled: set[str] = set()
        if touched:
            out = change(self._rows(self._folders(manifest, touched))).withColumn("bucket", self._bucket())
            out.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/v={name}")
            folders = [st.getPath().getName() for st in self._fs.listStatus(self._path(f"data/v={name}"))]
            filled = {f[7:] for f in folders if f.startswith("bucket=")}
        buckets = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched} | {b: name for b in filled}
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"version": version, "buckets": buckets, "batches": batches, "count": manifest["count"]})
        return True

    def upsert(self, rows: DataFrame, seq: str = "seq", batch: tuple[str, int] | None = None, mode: str = "upsert") -> bool:
        """S3 on the buckets that ``rows`` touch: the latest row of a key wins,
        in ``rows`` by ``seq``, against the table always. ``truncate``: the
        table becomes the rows."""
        rows = cut_lineage(rows, "upsert-batch")  # its keys and its rows are read
        columns = self._rows([]).columns
        merge = lambda held: upsert_by_key(held.select(*columns), rows, self.key, seq, mode)
        return self.change(None if mode == "truncate" else rows, merge, batch)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data of the versions there are that none of the last ``keep``
        reads; what is deleted. What a job at work has written stays."""
        done = self.versions()
        used = {f for v in done[-keep:] for f in self._folders(self.manifest(v))}
        gone = []
        data = self._path("data")
        for version in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = version.getPath().getName()
            if not done or int(name[2:].split("-")[0]) > done[-1]:
                continue
            for bucket in self._fs.listStatus(version.getPath()):
                folder = f"{self.path}/data/{name}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and folder not in used:
                    self._fs.delete(bucket.getPath(), True)
                    gone.append(folder)
        return gone
