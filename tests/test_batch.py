"""J7 on hand-made rows: one settling of ids for the whole batch, both routes, a second run."""
import json

from pyspark.sql import functions as F

from scholargraph import schemas
from scholargraph.operators import batch as B
from scholargraph.operators import canon
from scholargraph.operators import graph as G
from scholargraph.operators import search as S

STMT = "item_id bigint, property string, type string, value string, uri string, label string, target_id bigint"


def domain(label, code=None, kind="keyword", count=1):
    return {"label": {"default": label}, "code": code, "type": kind, "count": count}


def affiliation(sid, label):
    return {"structure": {"id": sid, "label": None if label is None else {"default": label}, "kind": ["lab"]}, "publicationsCount": 2, "startDate": "2001", "endDate": None}


PEOPLE = {
    1: {"fullName": "Ada Alpha", "topDomains": [domain("Maths", "Q1", "wikidata", 3), domain("maths", None, "keyword", 4), domain("Art")],
        "coContributors": [{"person": "2"}, {"person": "3"}, {"person": "4"}, {"person": "99"}],
        "affiliations": [affiliation("L1", "Lab one"), affiliation("L2", None)],
        "publications": [{"publication": "p1", "title": {"default": "First"}, "role": "author", "year": "2020"},
                         {"publication": "p1", "title": {"default": "Again"}, "role": "editor", "year": "2021"}]},
    2: {"fullName": "Bob Beta", "topDomains": [domain("Art"), domain("Maths", "Q1", "wikidata")], "coContributors": [{"person": "3"}],
        "affiliations": [affiliation("L1", "Lab one")]},
    3: {"fullName": "Cléo Gamma", "affiliations": [affiliation("L3", "Lab three")], "topDomains": [domain("Nowhere")]},
    4: {"fullName": "cleo gamma"},
}


def inputs(spark, extra=()):
    rows = [(i, json.dumps({"id": str(i), "firstName": "", "lastName": "x", **p})) for i, p in PEOPLE.items()]
    table = spark.createDataFrame(rows, "id bigint, data string")
    records = canon.decode_person_table(table).select(F.col("row_id").alias("id"), "person")
    items = spark.createDataFrame(
        [(10, "foaf:Person", "Ada Alpha"), (11, None, "bob beta"), (12, "foaf:Person", "Nobody"), (20, B.ORG_CLASS, "Lab one"), (21, B.ORG_CLASS, "No reference")],
        "item_id bigint, class string, title string")
    statements = spark.createDataFrame([
        (10, G.TITLE, "literal", "Ada Alpha", None, None, None), (10, B.HAS_CONCEPT, "resource", None, None, None, 777),
        (11, G.TITLE, "literal", "Bob Beta", None, None, None), (12, G.TITLE, "literal", "Nobody", None, None, None),
        (20, G.REFERENCED_BY, "literal", " L1", None, None, None), (30, G.PREF_LABEL, "literal", "Art", None, None, None), *extra], STMT)
    register = spark.createDataFrame([("L1", "Lab one", "LO", None, None, "1 rue A", None, None, 1)],
                                     ", ".join(f"{f} string" for f in schemas.REGISTER_FIELDS) + ", pos bigint")
    names = records.select("id", F.col("person.fullName").alias("name"))
    requested = spark.createDataFrame([(i,) for i in (10, 11, 12, 20, 21, 21, 404)], "item_id bigint")
    return requested, items, statements, names, B.person_tables(records), register, S.search_auto


def test_ids_are_settled_once_for_the_batch(spark):
    m = B.merge_batch(*inputs(spark))
    assert [r["item_id"] for r in m.missing.collect()] == [404]
    assert {tuple(r) for r in m.status.collect()} == {
        (10, "person", "updated"), (11, "person", "updated"), (12, "person", "skipped"), (20, "structure", "updated"), (21, "structure", "skipped")}
    created = {}
    for r in m.created.collect():
        created.setdefault(r["class"], []).append(r["item_id"])
    # Cléo Gamma and cleo gamma are one name; Q1 and L1 (its reference does not begin with the id), L3 are new
    assert {c: len(i) for c, i in created.items()} == {"foaf:Person": 1, "skos:Concept": 1, B.ORG_CLASS: 2}
    rows = m.statements.collect()
    cleo = created["foaf:Person"][0]
    link = lambda item, prop: sorted(r["target_id"] for r in rows if r["item_id"] == item and r["property"] == prop)
    assert link(10, B.CONTRIBUTORS) == sorted([11, cleo, cleo]) and link(11, B.CONTRIBUTORS) == [cleo]
    concept = created["skos:Concept"][0]
    assert link(10, B.HAS_CONCEPT) == sorted([30, concept])  # 777 is replaced
    assert link(11, B.HAS_CONCEPT) == sorted([30, concept])
    assert len(link(cleo, B.HAS_STRUCTURE)) == 1 and not link(cleo, B.HAS_CONCEPT)  # a created person brings its affiliations, nothing deeper
    assert link(10, B.HAS_STRUCTURE) == link(11, B.HAS_STRUCTURE) and len(link(10, B.HAS_STRUCTURE)) == 1
    assert [r["value"] for r in rows if r["property"] == B.PUBLICATIONS] == ["First"]
    assert {r["property"] for r in rows if r["item_id"] == 20} == {G.REFERENCED_BY, "foaf:surname", G.STREET}
    assert [r["property"] for r in rows if r["item_id"] == 12] == [G.TITLE]
    notes = {(r["item_id"], r["target_id"], r["value"], r["name"], r["annotation"]) for r in m.annotations.collect()}
    assert {(10, concept, None, B.RANK, "7"), (10, 30, None, B.RANK, "1"), (10, None, "First", B.DATE, "2020"), (10, None, "First", B.STATUS, "editor")} <= notes
    assert (10, link(10, B.HAS_STRUCTURE)[0], None, B.START, "2001") in notes and not any(n[3] == B.END for n in notes)


def test_a_second_run_creates_nothing(spark):
    first = B.merge_batch(*inputs(spark))
    rows = [tuple(r) for r in first.statements.select("item_id", "property", "type", "value", "uri", "label", "target_id").collect()]
    requested, items, _, *rest = inputs(spark)
    old = [(30, G.PREF_LABEL, "literal", "Art", None, None, None)]
    again = B.merge_batch(requested, items, spark.createDataFrame(rows + old, STMT), *rest)
    assert again.created.collect() == []
    links = lambda rs: sorted((r[0], r[1], r[6]) for r in rs if r[6] is not None)
    assert links([tuple(r) for r in again.statements.collect()]) == [x for x in links(rows) if x[0] in (10, 11)]


def test_an_empty_batch(spark):
    requested, *rest = inputs(spark)
    m = B.merge_batch(requested.limit(0), *rest)
    assert [df.count() for df in m] == [0, 0, 0, 0, 0]


def test_the_batch_is_looked_up_once(spark, tmp_path):
    """What was asked for is read to write the batch, and not again for every result."""
    requested, *rest = inputs(spark)
    requested.write.parquet(str(tmp_path / "asked"))
    m = B.merge_batch(spark.read.parquet(str(tmp_path / "asked")), *rest)
    for df in m:
        assert not any("/asked/" in f for f in df.inputFiles())
    assert [r["item_id"] for r in m.missing.collect()] == [404]
    assert m.status.count() == 5


def test_a_record_is_decoded_once(spark):
    table = spark.createDataFrame([(1, json.dumps({"id": "1", "firstName": "A", "fullName": "A B"}))], "id bigint, data string")
    records = canon.decode_person_table(table)
    assert records.first()["person"]["fullName"] == "A B"
    assert records._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_repeated_suppliers_count_their_lines_again(spark, tmp_path):
    """Line items are summed before they meet the supplier, with the figures of the join."""
    from scholargraph.plans import q_persons as qp

    tables = {
        "supplier": ([(1, "one"), (1, "one"), (2, "two"), (None, "none")], "s_suppkey bigint, s_name string"),
        "orders": ([(10, 7, "2001-01-01"), (11, None, "2001-01-01")], "o_orderkey bigint, o_custkey bigint, o_orderdate string"),
        "lineitem": ([(10, 1, 1, 1, 1.0, "A", "2001-02-03"), (10, 2, 1, 1, 1.0, "A", "2001-02-01"), (10, 3, 1, 2, 1.0, "A", None),
                      (10, 4, 1, 3, 1.0, "A", None), (10, 5, 1, None, 1.0, "A", None), (11, 1, 1, 2, 1.0, "A", None)],
                     "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.withColumns({c: F.to_date(c) for c in df.columns if c.endswith("date")}).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = qp.affiliation_entries(spark, str(tmp_path)).select("person_id", "structure_id", "structure_label", "publications_count", "start_date", "end_date")
    assert sorted(map(tuple, got.collect()), key=str) == [
        (7, "S1", "one", 4, "2001-02-01", "2001-02-03"), (7, "S2", "two", 1, None, None), (None, "S2", "two", 1, None, None)]
