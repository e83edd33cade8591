"""Hand-made rows for the ingest path: malformed lines, empty ids, spellings."""
import gzip
import json

from pyspark.sql import functions as F

from scholargraph import schemas  # noqa: F401
from scholargraph.operators import canon, upsert
from scholargraph.sources import jsonl
from scholargraph.sources import register as reg


def _lines(spark, rows):
    return spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, seq bigint")


BAD = ["", " \t ", '{"id": "1", "fullName": "A"', "null", "[]", "5", '{"fullName": "no id"}',
       '{"id": "", "fullName": "empty"}', '{"id": "0", "fullName": "zero"}']


def test_import_splits_valid_and_rejects(spark):
    good = ['{"id": "7", "fullName": "' + "x" * 600 + '"}', '  {"id": "8", "fullName": "Éva"}  ']
    valid, rejects = jsonl.import_persons(_lines(spark, BAD + good))
    v = {r["id"]: r["fullName"] for r in valid.collect()}
    assert set(v) == {"7", "8"}
    assert len(v["7"]) == 512 and v["8"] == "Éva"
    reasons = sorted(r["reason"] for r in rejects.collect())
    # blank lines are neither imported nor rejected
    assert len(reasons) == len(BAD) - 2
    assert reasons.count("undecodable") == 1


def test_read_lines_gzip_and_order(spark, tmp_path):
    p = tmp_path / "dump.jsonl.gz"
    with gzip.open(p, "wt") as f:
        for i in range(50):
            f.write(json.dumps({"id": "k", "fullName": f"v{i}"}) + "\n")
    lines = jsonl.read_lines(spark, str(p), partitions=4)
    valid, _ = jsonl.import_persons(lines)
    last = upsert.latest_per_key(valid, ["id"], "seq").collect()
    assert [r["fullName"] for r in last] == ["v49"]


def test_upsert_twice_equals_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id bigint, v string, seq bigint")
    once = upsert.upsert_by_key(target, batch, ["id"], "seq")
    twice = upsert.upsert_by_key(once, batch, ["id"], "seq")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert dict(once.collect()) == {1: "a", 2: "d", 3: "e"}
    assert dict(upsert.upsert_by_key(target, batch, ["id"], "seq", "truncate").collect()) == {2: "d", 3: "e"}


def test_features_reject_origin(spark):
    f = spark.createDataFrame([(1, 1.0, 2.0)], "item_id bigint, lat double, lng double")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 3.0, 4.0, 1)], "item_id bigint, lat double, lng double, seq bigint")
    out = {r["item_id"]: (r["lat"], r["lng"]) for r in upsert.upsert_features(f, pts, "seq").collect()}
    assert out == {1: (1.0, 2.0), 2: (3.0, 4.0)}


def test_canonical_person_spellings_and_envelope(spark):
    rows = [
        ('{"id": "1", "topDomains": [{"label": {"default": "A"}}], "top_domains": [{"label": {"default": "B"}}]}',),
        ('{"id": "2", "top_domains": [{"label": {"default": "B"}}]}',),
        ('{"_source": {"id": "3", "fullName": "C"}, "_score": 2.5}',),
        ('{"id": "4"}',),
    ]
    df = spark.createDataFrame(rows, "data string").withColumn("id", F.lit("x"))
    out = canon.decode_person_table(df).select("person.*").collect()
    by = {r["id"]: r for r in out}
    assert by["1"]["top_domains"][0]["label"]["default"] == "A"
    assert by["2"]["top_domains"][0]["label"]["default"] == "B"
    assert by["3"]["score"] == 2.5 and by["3"]["fullName"] == "C"
    assert by["4"]["firstName"] == "" and by["4"]["domains"] == []


def test_registry_document(spark):
    doc = json.dumps({
        "name": {"given-names": {"value": "Ana"}},
        "external-identifiers": {"external-identifier": [{"external-id-type": "doi", "external-id-value": "10/x"}]},
        "keywords": {"keyword": [{"content": ""}, {"content": "0"}, {"content": "graphs"}]},
    })
    p = canon.canonical_from_registry(spark.createDataFrame([("0000-1", doc)], "orcid string, doc string")).first()["person"]
    assert p["fullName"] == "Ana" and p["lastName"] == ""
    assert [(x["type"], x["url"]) for x in p["externalIds"]] == [("doi", "#"), ("orcid", "https://orcid.org/0000-1")]
    assert [d["label"]["default"] for d in p["top_domains"]] == ["graphs"]


def test_register_latest_and_statements(spark):
    rows = [
        (None, "x", "A", None, None, None, None, None, 1),
        ("", "x", "A", None, None, None, None, None, 2),
        ("K1", "old", "OLD", None, None, None, None, None, 3),
        ("K1", "new", "  NEW  ", "1990", '["a", "b"]', "   ", "75000", "Paris", 4),
    ]
    cols = ", ".join(f"{c} string" for c in schemas.REGISTER_FIELDS) + ", pos bigint"
    df = spark.createDataFrame(rows, cols)
    latest = reg.scan_register(df)
    assert [r["libelle"] for r in latest.collect()] == ["new"]
    st = {(r["property"], r["value"]) for r in reg.register_statements(latest).collect()}
    assert st == {("foaf:surname", "NEW"), ("dcterms:created", "1990"), ("schema:postalCode", "75000"),
                  ("schema:addressLocality", "Paris")}


def test_read_register_file(spark, tmp_path):
    p = tmp_path / "register.json"
    recs = [{"numero_national_de_structure": "A", "libelle": "first"}, {"numero_national_de_structure": "B", "libelle": "b"},
            {"numero_national_de_structure": "A", "libelle": "second", "site_web": ["x", "y"]}]
    p.write_text(json.dumps(recs))
    latest = {r["numero_national_de_structure"]: r for r in reg.scan_register(reg.read_register(spark, str(p))).collect()}
    assert latest["A"]["libelle"] == "second" and latest["B"]["libelle"] == "b"
    st = reg.register_statements(reg.scan_register(reg.read_register(spark, str(p))))
    assert st.where("property = 'foaf:workplaceHomepage'").count() == 0
