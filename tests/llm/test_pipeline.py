"""The pipeline's stages and the registered queries over the smallest tables."""
import importlib
import os
import re

import pytest
from pyspark.sql import functions as F

from scholargraph.llm import queries
from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(n) for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert r["ok"], r


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = pipeline.documents(spark, SF)
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.written(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after and after <= before
        assert out.where("n_chars <> char_length(text)").count() == 0
        docs, before = out, after
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == before


def test_stages_keep_columns_with_names_of_the_operators(spark):
    """Columns called like what operators use inside keep their values."""
    pipeline = importlib.import_module("corpus_pipeline")
    clash = ["_text", "_id", "_hit", "_bits", "_spans", "score", "predicted", "removed", "spans", "doc", "a.b", "component_id", "kept"]
    docs = pipeline.documents(spark, SF).where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in clash])
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.written(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in clash), name
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)


def test_library_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "scholargraph")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "scholargraph.llm" not in open(os.path.join(folder, n), encoding="utf-8").read(), n
