"""Plan guards: no query pairs every row with every row."""
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from scholargraph.plans import catalog

SF = "/root/testdata/sf0.001"


def _check(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan, name
    assert "CartesianProduct" not in plan, name


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_or_nested_loop_join(spark, name, monkeypatch):
    """The plan of the result, and of every table written on the way to it."""
    parquet = DataFrameWriter.parquet

    def checked(self, *args, **kwargs):
        _check(self._df, name)
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", checked)
    _check(catalog.QUERIES[name](spark, SF), name)
