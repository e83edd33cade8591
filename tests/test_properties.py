"""Randomised properties checked against plain-Python models."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scholargraph.operators import upsert
from scholargraph.operators import network as N

rows = st.lists(st.tuples(st.integers(0, 6), st.text("ab", max_size=2), st.integers(0, 50)), max_size=25,
                unique_by=lambda r: r[2])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=st.dictionaries(st.integers(0, 6), st.text("xy", max_size=2), max_size=5), batch=rows)
def test_upsert_matches_model_and_is_idempotent(spark, target, batch):
    t = spark.createDataFrame(sorted(target.items()), "id bigint, v string")
    b = spark.createDataFrame(batch, "id bigint, v string, seq bigint")
    once = upsert.upsert_by_key(t, b, ["id"], "seq")
    model = dict(target)
    for k, v, _ in sorted(batch, key=lambda r: r[2]):
        model[k] = v
    got = dict(once.collect())
    assert got == model
    assert dict(upsert.upsert_by_key(once, b, ["id"], "seq").collect()) == model


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=40), chunk=st.integers(1, 4))
def test_edges_match_pair_model(spark, pairs, chunk):
    eo = spark.createDataFrame(sorted(set(pairs)), "event_id bigint, org_id bigint")
    edges, _ = N.collaboration_edges(eo, chunk=chunk)
    model = {}
    by_event = {}
    for e, o in set(pairs):
        by_event.setdefault(e, set()).add(o)
    for e, orgs in by_event.items():
        for a in orgs:
            for b in orgs:
                if a < b:
                    model[(a, b)] = model.get((a, b), 0) + 1
    assert {(r["src"], r["dst"]): r["n_events"] for r in edges.collect()} == model
