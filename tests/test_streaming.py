"""The availableNow import picks up new files and upserts them."""
import json

from scholargraph.streaming.ingest import read_current, start_import


def _write(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def test_incremental_import(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    table = str(tmp_path / "table")
    ck = str(tmp_path / "ck")
    _write(drop / "a.jsonl", [{"id": "1", "fullName": "A"}, {"id": "2", "fullName": "B"}, "{broken", ""])
    start_import(spark, str(drop), table, ck).awaitTermination()
    first = {r["id"]: r["fullName"] for r in read_current(spark, table).collect()}
    assert first == {"1": "A", "2": "B"}
    _write(drop / "b.jsonl", [{"id": "2", "fullName": "B2"}, {"id": "3", "fullName": "C"}, {"id": "0", "fullName": "zero"}])
    start_import(spark, str(drop), table, ck).awaitTermination()
    second = {r["id"]: r["fullName"] for r in read_current(spark, table).collect()}
    assert second == {"1": "A", "2": "B2", "3": "C"}
    # nothing new: a rerun changes nothing
    start_import(spark, str(drop), table, ck).awaitTermination()
    assert {r["id"]: r["fullName"] for r in read_current(spark, table).collect()} == second


def test_one_file_per_batch_chains_versions(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for i, name in enumerate(["a", "b", "c"]):
        _write(drop / f"{name}.jsonl", [{"id": "k", "fullName": f"v{i}"}, {"id": name, "fullName": name}])
    table = str(tmp_path / "table")
    start_import(spark, str(drop), table, str(tmp_path / "ck"), max_files_per_trigger=1).awaitTermination()
    got = {r["id"]: r["fullName"] for r in read_current(spark, table).collect()}
    assert got == {"k": "v2", "a": "a", "b": "b", "c": "c"}


def test_a_new_checkpoint_goes_on_with_the_table(spark, tmp_path):
    drop, table = tmp_path / "drop", str(tmp_path / "table")
    drop.mkdir()
    _write(drop / "a.jsonl", [{"id": "1", "fullName": "A"}, "{broken"])
    start_import(spark, str(drop), table, str(tmp_path / "ck1")).awaitTermination()
    assert [r["reason"] for r in spark.read.parquet(f"{table}_rejects/v=0").collect()] == ["undecodable"]
    _write(drop / "b.jsonl", [{"id": "2", "fullName": "B"}])
    start_import(spark, str(drop), table, str(tmp_path / "ck2")).awaitTermination()
    assert {r["id"] for r in read_current(spark, table).collect()} == {"1", "2"}
