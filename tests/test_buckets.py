"""The bucketed table: only touched buckets are rewritten, versions count when their manifest is there."""
import os

import pytest
from pyspark.sql import functions as F

from scholargraph.streaming.buckets import BucketTable


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "id string, v string, seq int")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id string, v string", ["id"], 8)
    assert t.read().collect() == [] and t.versions() == []
    assert t.upsert(rows(spark, [(f"k{i}", "a") for i in range(200)]))
    before, at = files(tmp_path / "t"), dict(t.manifest()["buckets"])
    assert len(at) == 8
    assert t.upsert(rows(spark, [("k3", "b"), ("k3", "c")]))
    assert content(t.read()) == {f"k{i}": "a" for i in range(200)} | {"k3": "c"}
    now, after = t.manifest()["buckets"], files(tmp_path / "t")
    changed = [b for b in at if now[b] != at[b]]
    assert len(changed) == 1
    assert all(after[f] == m for f, m in before.items())  # nothing written is ever changed
    assert {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)} == set(changed)
    # the plan reads one folder per bucket, not the table's history
    assert len(t.read().inputFiles()) == 8
    gone = t.vacuum()
    assert len(gone) == 1 and content(t.read())["k3"] == "c" and content(t.read())["k4"] == "a"


def test_batches_count_once_and_truncate_replaces(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id string, v string", ["id"], 4)
    assert t.upsert(rows(spark, [("a", "1"), ("b", "1")]), batch=("s", 0))
    assert not t.upsert(rows(spark, [("a", "late")]), batch=("s", 0))
    assert t.upsert(rows(spark, [("a", "2")]), batch=("other", 0))
    assert content(t.read()) == {"a": "2", "b": "1"} and content(t.read(0)) == {"a": "1", "b": "1"}
    assert t.upsert(rows(spark, [("c", "3")]), mode="truncate")
    assert content(t.read()) == {"c": "3"}
    # opened again with another count, the table keeps its own
    assert content(BucketTable(spark, str(tmp_path / "t"), "id string, v string", ["id"], 16).read()) == {"c": "3"}
    assert t.upsert(rows(spark, [("d", "4")]).limit(0)) and content(t.read()) == {"c": "3"}


def test_a_dead_job_leaves_no_trace_and_a_second_writer_fails(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id string, v string", ["id"], 4)
    t.upsert(rows(spark, [("a", "1")]))

    def dies(held):
        return held.select("id", F.raise_error(F.lit("lost")).cast("string").alias("v"))

    with pytest.raises(Exception):
        t.change(rows(spark, [("a", "x")]), dies)
    assert content(t.read()) == {"a": "1"} and t.versions() == [0]

    def slow(held):
        BucketTable(spark, str(tmp_path / "t"), "id string, v string", ["id"], 4).upsert(rows(spark, [("b", "2")]))
        return held

    with pytest.raises(RuntimeError, match="another job"):
        t.change(rows(spark, [("a", "x")]), slow)
    assert content(t.read()) == {"a": "1", "b": "2"}
