"""Dimension loads: ids stay, clashes of natural keys and of hashes are settled and reported."""
from scholargraph.operators.dimensions import load_dimension

ROWS = "ref string, label string"


def table(df):
    return {r["ref"]: (r["id"], r["label"], r["n_entries"]) for r in df.collect()}


def test_a_second_load_keeps_all_ids(spark):
    first = load_dimension(None, spark.createDataFrame([(f"k{i}", "a") for i in range(50)] + [(None, "x"), (" ", "x")], ROWS), "ref", ["label"])
    one = table(first.table)
    assert len(one) == 50 and len({v[0] for v in one.values()}) == 50 and first.clashes.collect() == []
    second = load_dimension(first.table, spark.createDataFrame([(f"k{i}", "b") for i in range(40, 70)] + [("k45", "c"), ("k45", None)], ROWS), "ref", ["label"])
    two = table(second.table)
    assert len(two) == 70 and all(two[k][0] == v[0] for k, v in one.items())
    assert two["k3"] == one["k3"] and two["k60"][1:] == ("b", 1) and two["k45"][2] == 3
    assert [tuple(r) for r in second.clashes.collect()] == [("k45", "attributes", "3")]


def test_equal_hashes_are_settled_and_reported(spark):
    """Ids of 6 bits: keys clash among themselves and with keys of an earlier load."""
    first = load_dimension(None, spark.createDataFrame([(f"k{i:02}", "a") for i in range(20)], ROWS), "ref", ["label"], bits=6)
    one = table(first.table)
    assert len({v[0] for v in one.values()}) == 20
    told = first.clashes.collect()
    assert told and all(r["reason"] == "id" and r["detail"] in one and r["detail"] != r["ref"] for r in told)
    second = load_dimension(first.table, spark.createDataFrame([(f"a{i:02}", "a") for i in range(15)] + [("k00", "z")], ROWS), "ref", ["label"], bits=6)
    two = table(second.table)
    assert len(two) == 35 and len({v[0] for v in two.values()}) == 35
    assert all(two[k][0] == v[0] for k, v in one.items()) and two["k00"][1] == "z"
    assert any(r["detail"].startswith("k") for r in second.clashes.collect())  # an older key has the id


def test_an_empty_load(spark):
    none = spark.createDataFrame([], ROWS)
    first = load_dimension(None, none, "ref", ["label"])
    assert first.table.collect() == [] and first.clashes.collect() == []
