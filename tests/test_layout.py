"""Bucketed statements: the merges read them where they lie."""
import uuid

import pytest

from scholargraph.operators import enrich as E
from scholargraph.operators import graph as G
from scholargraph.plans import q_graph as qg
from scholargraph.plans import q_network as qn
from scholargraph.plans.q_ingest import register_rows
from scholargraph.sources import layout as L

SF = "/root/testdata/sf0.001"
BUCKETS = 16


@pytest.fixture
def no_broadcast(spark):
    """Everything is too large to be sent to all, as it is at size."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", L.SUBSET_KEYS]
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def held(spark, statements, folder):
    name = f"st_{uuid.uuid4().hex}"
    return name, L.write_statements(statements, name, str(folder / name), BUCKETS)


@pytest.mark.parametrize("mode", ["replace", "append_distinct"])
def test_merges_leave_the_table_in_place(spark, tmp_path, no_broadcast, mode):
    old, new = qg.person_item_statements(spark, SF), qg.new_person_statements(spark, SF)
    name, table = held(spark, old, tmp_path)
    assert L.exchanged(table.groupBy("value").count(), name)  # the guard sees exchanges
    merged = G.merge_statements(table, L.deal(new, BUCKETS), mode)
    assert L.exchanged(merged, name) == []
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(merged) == rows(G.merge_statements(old, new, mode))


def test_person_statements_leave_the_table_in_place(spark, tmp_path, no_broadcast):
    name, table = held(spark, qg.person_item_statements(spark, SF), tmp_path)
    persons = L.deal(qg.person_records(spark, SF).selectExpr("id * 10 + 1 AS item_id", "person"), BUCKETS)
    assert L.exchanged(G.person_statements(persons, table), name) == []


def test_enrichment_leaves_the_table_in_place(spark, tmp_path, no_broadcast):
    statements = qn.org_statements(spark, SF)
    name, table = held(spark, statements, tmp_path)
    items, register = qn.org_items(spark, SF), register_rows(spark, SF)
    merged = E.enrich_structures(L.deal(items, BUCKETS), table, register, qn.ORG_CLASS)[0]
    # the references alone go to the register and back; the statements that are merged stay
    moved = [x for x in L.exchanged(merged, name) if "item_id" in x]
    assert moved == []
    rows = lambda df: sorted(map(str, df.select(*qg.STMT_OUT).collect()))
    assert rows(merged) == rows(E.enrich_structures(items, statements, register, qn.ORG_CLASS)[0])


def test_a_table_is_opened_again(spark, tmp_path, no_broadcast):
    old = qg.person_item_statements(spark, SF)
    name, table = held(spark, old, tmp_path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    n = table.count()
    L.drop_statements(spark, name)
    again = L.open_statements(spark, f"{name}_again", str(tmp_path / name), schema, BUCKETS)
    assert again.count() == n
    merged = G.merge_statements(again, L.deal(qg.new_person_statements(spark, SF), BUCKETS), "replace")
    assert L.exchanged(merged, f"{name}_again") == []
