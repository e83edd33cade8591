"""Intermediate tables: where they go and when they are deleted."""
import os

import pytest

from scholargraph import session


def test_tables_of_a_block_are_deleted(spark):
    with session.IntermediateTables(spark) as tables:
        first = session.cut_lineage(spark.range(5), "first")
        kept = tables.keep(session.cut_lineage(first.where("id > 2"), "second"))
        gone = first.inputFiles()[0]
    assert sorted(r[0] for r in kept.collect()) == [3, 4]
    assert not os.path.exists(gone.removeprefix("file://"))


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return {"spark.master": self.master}.get(key, default)

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(type("Session", (), {"conf": Conf(master)})())
