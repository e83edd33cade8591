"""Graph operators on hand-made rows and their properties."""
from pyspark.sql import functions as F

from scholargraph.operators import graph as G
from scholargraph.operators import network as N
from scholargraph.operators import person_graph as pg

STMT = "item_id bigint, property string, type string, value string, uri string, label string, target_id bigint"


def test_merge_domains_rules(spark):
    rows = [
        (1, 1, "Physics", None, "k", 2), (1, 2, "physics", "P1", "k", 3), (1, 3, None, "Z", "k", 9),
        (1, 4, "PHYSICS", None, "k", 1), (1, 5, "Chem", "C1", "k", 6),
    ]
    d = spark.createDataFrame(rows, "person_id bigint, pos bigint, label string, code string, type string, count bigint")
    out = [r.asDict() for r in pg.merge_domains(d).orderBy("rank").collect()]
    assert [(o["label"], o["code"], o["count"]) for o in out] == [("Physics", "P1", 6), ("Chem", "C1", 6)]
    # equal counts: the first position wins the tie
    assert [o["rank"] for o in out] == [1, 2]
    total_in = sum(r[5] for r in rows if r[2] is not None)
    assert sum(o["count"] for o in out) == total_in


def test_group_publications_roles_first_seen(spark):
    rows = [(1, 1, "p", "T1", "2020", "B"), (1, 2, "p", "T2", "2021", "A"), (1, 3, "p", "T3", "2022", "B"), (1, 4, "q", "", "2020", "A"),
            (1, 5, "r", None, "2020", "A")]
    d = spark.createDataFrame(rows, "person_id bigint, pos bigint, publication string, title string, year string, role string")
    # an entry is untitled when its title is not set; an empty title is set
    out = {r["publication"]: r for r in pg.group_publications(d).collect()}
    assert set(out) == {"p", "q"} and out["q"]["title"] == ""
    assert out["p"]["title"] == "T1" and out["p"]["roles"] == ["B", "A"]


def test_resolve_orgs_prefix_and_exact(spark):
    st = spark.createDataFrame(
        [(10, G.REFERENCED_BY, "literal", "ED12", None, None, None), (11, G.REFERENCED_BY, "literal", "ED1_x", None, None, None),
         (12, G.REFERENCED_BY, "literal", "ED1", None, None, None)], STMT)
    s = spark.createDataFrame([("ED1", "One", []), ("ED12", "Twelve", []), ("X9", "Nine", ["lab"]), ("E%", "Pct", [])],
                              "structure_id string, label string, kinds array<string>")
    res, new = G.resolve_orgs(s, st)
    got = {r["structure_id"]: (r["item_id"], r["status"], r["org_type"]) for r in res.collect()}
    assert got["ED1"][:2] == (10, "found")  # oldest of ED12, ED1_x, ED1
    assert got["ED12"][:2] == (10, "found")
    assert got["X9"][1:] == ("created", "lab")
    assert got["E%"][1] == "created"  # wildcards are literal
    exact, _ = G.resolve_orgs(s, st, exact=True)
    assert {r["structure_id"]: r["item_id"] for r in exact.collect()}["ED1"] == 12
    assert new.where(F.col("item_id") == got["X9"][0]).count() == 3
    # found + created partition the input
    assert res.count() == s.count()


def test_resolve_concepts_tiers_and_single_creation(spark):
    tags = spark.createDataFrame(
        [("Graphs", "Q1", "wikidata"), ("Graphs", "Q1", "wikidata"), ("Logic", "L7", "scheme"), ("Art", None, None), ("Art", "A", None)],
        "label string, code string, type string")
    st = spark.createDataFrame([(5, G.PREF_LABEL, "literal", "Art", None, None, None)], STMT)
    res, new = G.resolve_concepts(tags, st)
    got = {(r["kind"], r["key"]): (r["item_id"], r["status"]) for r in res.collect()}
    assert got[("label", "Art")] == (5, "found")
    assert got[("uri", G.WIKIDATA_URL + "Q1")][1] == "created"
    assert got[("value", "scheme_L7")][1] == "created"
    assert len(got) == 3
    wid = got[("uri", G.WIKIDATA_URL + "Q1")][0]
    assert {r["property"] for r in new.where(F.col("item_id") == wid).collect()} == {G.TITLE, G.PREF_LABEL, G.REFERENCED_BY}


def test_merge_modes(spark):
    e = spark.createDataFrame([(1, "p", "literal", "a", None, None, None), (1, "u", "uri", None, "http://x", "x", None)], STMT)
    n = spark.createDataFrame([(1, "p", "literal", "a", None, None, None), (1, "p", "literal", "b", None, None, None),
                               (1, "p", "literal", "b", None, None, None), (1, "u", "uri", None, "http://x", "other", None)], STMT)
    rep = G.merge_statements(e, n, "replace")
    assert rep.count() == 4
    ad = G.merge_statements(e, n, "append_distinct")
    assert sorted((r["property"], r["value"], r["uri"]) for r in ad.collect()) == [
        ("p", "a", None), ("p", "b", None), ("u", None, "http://x")]
    again = G.merge_statements(ad, n, "append_distinct")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ad.collect()))
    assert G.merge_statements(e, n, "append").count() == 6


def test_filter_items_predicates(spark):
    items = spark.createDataFrame([(1, "c", None, "a"), (2, "c", None, "b"), (3, None, None, "c")],
                                  "item_id bigint, class string, template string, title string")
    st = spark.createDataFrame([(1, "s", "literal", "Open", None, None, None), (1, "l", "resource", None, None, None, 9),
                                (2, "s", "literal", "open", None, None, None), (3, "s", "literal", "Open", None, None, None)], STMT)
    out = G.filter_items(items, st, [G.Predicate("s", "eq", "Open"), G.Predicate("l", "links_to", 9)], cls="c")
    assert [r["item_id"] for r in out.collect()] == [1]
    out2 = G.filter_items(items, st, [G.Predicate("s", "contains", "OPE")])
    assert sorted(r["item_id"] for r in out2.collect()) == [1, 2, 3]


def test_edges_salting_is_exact(spark):
    rows = [(1, o) for o in range(30)] + [(2, 1), (2, 2), (3, 5)]
    eo = spark.createDataFrame(rows, "event_id bigint, org_id bigint")
    plain, _ = N.collaboration_edges(eo, chunk=10_000)
    salted, long = N.collaboration_edges(eo.repartition(7), chunk=4)
    a = sorted(map(tuple, plain.select("src", "dst", "n_events", "weight").collect()))
    b = sorted(map(tuple, salted.select("src", "dst", "n_events", "weight").collect()))
    assert a == b
    assert len(a) == 30 * 29 // 2
    assert all(s < d for s, d, *_ in a)
    assert dict(((s, d), n) for s, d, n, _ in a)[(1, 2)] == 2
    assert long.count() == sum(n for *_, n, _ in a)


def test_postal_address_drops_blank(spark):
    st = spark.createDataFrame([(1, G.STREET, "literal", " 1 rue A ", None, None, None), (1, G.POSTCODE, "literal", "0", None, None, None),
                                (1, G.TOWN, "literal", "  ", None, None, None)], STMT)
    assert G.postal_address(st).first()["address"] == "1 rue A, 0"


def test_link_keywords_is_one_aggregate_and_nulls_equal_nothing(spark):
    have = spark.createDataFrame([(1, 1, "p"), (1, 2, "other"), (None, 1, "p"), (2, 2, "p"), (1, 1, "q")], "person_id bigint, concept_id bigint, property string")
    req = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (3, None)], "person_id bigint, concept_id bigint")
    out = G.link_keywords(have, req, ["p", "q"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, "duplicate"), (1, 2, "added"), (None, 1, "added"), (3, None, "added")], key=str)
