"""Search, votes and evaluation operators on hand-made rows."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from scholargraph.operators import evaluate as EV
from scholargraph.operators import search as S
from scholargraph.operators import votes as V


def _names(spark):
    return spark.createDataFrame([(1, "Jean-Pierre Dupont"), (2, "Jeanne Durand"), (3, "Pierre Jean"), (4, "Ève 100%_sure")],
                                 "id bigint, name string")


def _q(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, text string")


def test_prefix_all_words_required(spark):
    hits = S.search_prefix_all(_names(spark), _q(spark, [(1, "jean pier"), (2, "jean-pierre"), (3, "DUR"), (4, "zz"), (5, "  ")]), None)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got[1] == {1, 3}
    assert got[2] == {1, 3}
    assert got[3] == {2}
    assert 4 not in got and 5 not in got


def test_substring_literal_wildcards_and_accents(spark):
    hits = S.search_substring(_names(spark), _q(spark, [(1, "%_"), (2, "ev"), (3, "")]), None)
    got = {(r["query_id"], r["id"]) for r in hits.collect()}
    assert got == {(1, 4), (2, 4)}


def test_prefix_subset_of_ranked_for_full_words(spark):
    q = _q(spark, [(1, "durand"), (2, "pierre dupont")])
    a = {(r["query_id"], r["id"]) for r in S.search_prefix_all(_names(spark), q, None).collect()}
    docs = _names(spark).withColumnRenamed("name", "text")
    b = {(r["query_id"], r["id"]) for r in S.search_ranked(docs, q, None).collect()}
    assert a <= b


def test_leaf_search_ignores_numbers(spark):
    rows = spark.createDataFrame([(1, "a", (42, ["x42"])), (2, "b", (42, ["y"]))], "id bigint, t string, m struct<n:int, tags:array<string>>")
    got = {(r["query_id"], r["id"]) for r in S.search_fields(rows, _q(spark, [(1, "42")]), None, limit=None).collect()}
    assert got == {(1, 1)}


def test_suggest_skips_linked_and_short_terms(spark):
    titles = spark.createDataFrame([(i, f"ring {i:02d}") for i in range(15)], "id bigint, title string")
    req = spark.createDataFrame([(1, "ri"), (2, "r")], "person_id bigint, term string")
    linked = spark.createDataFrame([(1, 0), (1, 1), (1, 5)], "person_id bigint, id bigint")
    out = S.suggest(titles, req, linked, k=10).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] == [2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert all(r["person_id"] == 1 for r in out)


def test_scoreboard_last_rank_and_base(spark):
    vr = spark.createDataFrame([(10, 1, 7, 3, 5, 1), (10, 1, 7, 3, -2, 2), (11, 1, 7, 4, 4, 1), (12, 1, 8, 3, 9, 1)],
                               "vote_id bigint, person_id bigint, concept_id bigint, owner_id bigint, rank int, seq bigint")
    votes = V.last_rank(vr)
    links = spark.createDataFrame([(1, 7, "b", 1, 0), (1, 7, "a", 2, 3), (1, 9, "a", 3, 0)],
                                  "person_id bigint, concept_id bigint, property string, pos bigint, rank int")
    fl = V.first_link(links, ["a", "b"])
    allowed = spark.createDataFrame([(1,)], "person_id bigint")
    b = {r["concept_id"]: r for r in V.scoreboard(fl, votes, 3, allowed).collect()}
    assert b[7]["property"] == "a" and b[7]["rank_sum"] == -2 + 4 + 3 and b[7]["my_rank"] == -2 and b[7]["slot"] == 0
    assert b[9]["n_votes"] == 0 and b[9]["slot"] == 1 and b[9]["cls"] == "neg"
    assert 8 not in b


def test_access_rules_and_changes(spark):
    users = spark.createDataFrame([(1, "adm", "global_admin", []), (2, "rev", "reviewer", [5]), (3, "p3", "author", []), (4, "r", "researcher", [5])],
                                  "user_id bigint, name string, role string, labs array<bigint>")
    persons = spark.createDataFrame([(30, "p3", 6), (31, "x", 5)], "person_id bigint, account string, lab_id bigint")
    rules = V.access_rules(users, persons.select("person_id", "account"))
    ch = spark.createDataFrame(
        [("create", 100, 31, 1, 5, 2, 1), ("update", 100, 31, 1, 6, 4, 2), ("create", 101, 30, 1, 1, 3, 1),
         ("delete", 101, 30, 1, 1, 1, 2), ("create", 101, 30, 1, 7, 3, 3), ("create", 102, 30, 2, 1, 2, 1)],
        "op string, vote_id bigint, person_id bigint, concept_id bigint, rank bigint, user_id bigint, seq bigint").withColumn("day", F.lit("01/02/2024"))
    empty = spark.createDataFrame([], "vote_id bigint, person_id bigint, concept_id bigint, rank bigint, owner_id bigint")
    out = {r["vote_id"]: (r["rank"], r["owner_id"]) for r in V.vote_changes(empty, ch, rules, persons.select("person_id", "lab_id"))[0].collect()}
    assert out == {100: (5, 2), 101: (7, 3)}


def test_vote_changes_go_by_the_stored_vote(spark):
    """Rights come from the stored vote's person, whatever person a change claims;
    an update sets the rank alone; unknown ids are errors."""
    users = spark.createDataFrame([(1, "adm", "global_admin", []), (3, "p3", "author", [])], "user_id bigint, name string, role string, labs array<bigint>")
    persons = spark.createDataFrame([(30, "p3"), (31, "x")], "person_id bigint, account string")
    labs = spark.createDataFrame([], "person_id bigint, lab_id bigint")
    rules = V.access_rules(users, persons)
    stored = spark.createDataFrame([(1, 31, 5, 2, 9), (2, 30, 6, 1, 9)], "vote_id bigint, person_id bigint, concept_id bigint, rank bigint, owner_id bigint")
    ch = spark.createDataFrame(
        [("delete", 1, 30, 5, 0, 3, 1), ("update", 2, 31, 7, 4, 3, 2), ("update", 77, 30, 5, 1, 1, 3), ("create", 2, 30, 6, 9, 3, 4)],
        "op string, vote_id bigint, person_id bigint, concept_id bigint, rank bigint, user_id bigint, seq bigint").withColumn("day", F.lit("01/02/2024"))
    decided, errors = V.vote_changes(stored, ch, rules, labs)
    rows = {r["vote_id"]: r for r in decided.collect()}
    assert set(rows) == {1, 2} and rows[1]["kind"] is None
    assert tuple(rows[2])[:6] == (2, 30, 6, 4, 9, "update")
    assert {(r["vote_id"], r["op"]): r["reason"] for r in errors.collect()} == {
        (1, "delete"): "not allowed", (77, "update"): "unknown vote", (2, "create"): "vote exists"}
    concepts = spark.createDataFrame([(6, "Six")], "concept_id bigint, concept string")
    names = persons.select("person_id", F.col("account").alias("person"))
    titles = {r["vote_id"]: r["title"] for r in V.with_vote_titles(decided, concepts, names, users).collect()}
    assert titles == {1: None, 2: "Expertise -> Six = 4 - pour p3 fait par p3 le 01/02/2024"}


def test_administrators_edit_persons_without_a_lab(spark):
    users = spark.createDataFrame([(1, "adm", "global_admin", [])], "user_id bigint, name string, role string, labs array<bigint>")
    persons = spark.createDataFrame([(30, "a"), (31, "b")], "person_id bigint, account string")
    labs = spark.createDataFrame([(30, 6)], "person_id bigint, lab_id bigint")
    got = V.editable_persons(V.access_rules(users, persons), labs, persons, 1).collect()
    assert sorted(r[0] for r in got) == [30, 31]


def test_parse_and_axes(spark):
    good = '{"evaluations":[{"id":"1","name":"N","scores":{"arts":80,"care":40,"democratie":10,"transitions":0},"justification":"j"}]}'
    rows = [(1, 9, ["a", "b"], "```json\n" + good + "\n```"), (2, 9, [], good), (3, 9, ["a"], good[:30]),
            (4, 9, ["a"], '{"evaluations": []}'), (5, 9, ["a"], '{"x": 1}')]
    r = spark.createDataFrame(rows, "person_id bigint, agent_id bigint, axes array<string>, reply string")
    p = EV.parse_evaluations(r)
    st = {x["person_id"]: (x["status"], x["reason"]) for x in p.collect()}
    assert st[1] == ("ok", None) and st[2] == ("ok", None)
    assert st[3] == ("rejected", "undecodable") and st[4][1] == "empty evaluations" and st[5][1] == "no evaluations"
    sc = {(x["category"], x["axis"]): (x["total"], x["n_rows"], x["n_people"]) for x in EV.category_axis_scores(p).collect()}
    # person 2 has no axis and drops out; person 1 counts once per axis
    assert sc[("arts", None)] == (160, 2, 1)
    assert sc[("arts", "a")] == (80, 1, 1)
    bands = {(x["category"], x["band"]): x["n"] for x in EV.score_bands(p).collect()}
    assert bands[("arts", "high")] == 2 and bands[("care", "mid")] == 2


def test_ranked_search_takes_a_batch_of_any_size(spark):
    """10,001 distinct words in one batch, for the ranked and the given/family search."""
    docs = spark.range(300).selectExpr("id", "concat('w', id, ' common') AS text")
    queries = spark.range(10_001).selectExpr("id AS query_id", "concat('w', id) AS text")
    hits = {(r["query_id"], r["id"]) for r in S.search_ranked(docs, queries, 3).collect()}
    assert hits == {(i, i) for i in range(300)}
    names = docs.withColumnRenamed("text", "name")
    hits = {(r["query_id"], r["id"]) for r in S.search_given_family(names, queries, 3).collect()}
    assert hits == {(i, i) for i in range(300)}
    hits = {(r["query_id"], r["id"]) for r in S.search_substring(names, queries, None).collect()}
    assert (7, 7) in hits and (7, 70) in hits and (299, 299) in hits and not any(q > 299 for q, _ in hits)


def test_suggest_counts_links_of_the_term_only(spark):
    titles = spark.range(50).selectExpr("id", "concat(CASE WHEN id < 20 THEN 'alpha ' ELSE 'beta ' END, lpad(id, 3, '0')) AS title")
    linked = spark.range(50).selectExpr("7L AS person_id", "id").where("id >= 20 or id = 0")
    req = spark.createDataFrame([(7, "alpha"), (8, "beta")], "person_id long, term string")
    got = {(r["person_id"], r["rank"]): r["id"] for r in S.suggest(titles, req, linked, k=3).collect()}
    assert got == {(7, 1): 1, (7, 2): 2, (7, 3): 3, (8, 1): 20, (8, 2): 21, (8, 3): 22}


def _broadcast_scans(plan: str) -> list[str]:
    """Lines of file scans below a broadcast in a physical plan."""
    depth, out = None, []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-*("))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and "FileScan" in line:
            out.append(line)
    return out


@pytest.mark.parametrize("search", [S.search_substring, S.search_prefix_all, S.search_auto, lambda n, q, k: S.search_fields(n, q, limit=k)])
@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_searched_rows_are_never_broadcast(spark, tmp_path, monkeypatch, search, limit):
    """A name file of a few KB is no reason to ship its rows, n-grams or postings to every task."""
    from scholargraph.functions import joins

    spark.range(3000).selectExpr("id", "concat('ring bolt ', id % 7) AS name").write.parquet(str(tmp_path / "searched"))
    names = spark.read.parquet(str(tmp_path / "searched"))
    parquet, plans = DataFrameWriter.parquet, []

    def seen(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, *args, **kwargs)

    for f in (joins.measured_broadcast, joins.sized_join):
        monkeypatch.setattr(f, "__defaults__", (limit,))
    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    hits = search(names, _q(spark, [(1, "bolt 3"), (2, "ri"), (3, "bolt 3")]), 2)
    plans.append(hits._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert not [x for x in _broadcast_scans(plan) if "searched" in x or "word-postings" in x and "id:bigint" in x], plan
    got = {(r["query_id"], r["id"], r["total"]) for r in hits.collect()}
    assert {x for x in got if x[0] != 2} == {(q, i, 428 + (3 < 3000 % 7)) for q in (1, 3) for i in (3, 10)}


def test_deep_rank_does_not_broadcast_its_rows(spark):
    from scholargraph.functions.ids import rank_within

    rows = spark.range(5000).selectExpr("id % 3 AS g", "id")
    ranked = rank_within(rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS g, 1L AS id")), ["g"], [F.col("id").asc()])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # starts hold one row per group and are made by an aggregate
    for at, line in enumerate(plan.splitlines()):
        if "BroadcastExchange" in line:
            assert "Aggregate" in "".join(plan.splitlines()[at + 1 : at + 3]) or "Project" in plan.splitlines()[at + 1], plan
    assert "BuildLeft" not in plan, plan
    assert ranked.count() == 5000 and ranked.where("rank = 1").count() == 3


def test_queries_of_the_same_words_share_their_hits(spark):
    q = _q(spark, [(1, "jean pier"), (2, "Pier  JEAN"), (3, "jean"), (4, "zz"), (None, "jean"), (5, "dur"), (5, "jeanne")])
    got = {(r["query_id"], r["rank"], r["id"], r["total"]) for r in S.search_prefix_all(_names(spark), q, 1).collect()}
    assert {(1, 1, 1, 2), (2, 1, 1, 2), (5, 1, 2, 1)} <= got
    assert {x[0] for x in got} == {1, 2, 3, 5}


def test_suggest_meets_requests_by_rank(spark):
    """Requests of one term meet its titles on (term, rank), not each title of the term."""
    titles = spark.range(400).selectExpr("id", "concat('ring ', lpad(id, 4, '0')) AS title")
    req = spark.range(300).selectExpr("id AS person_id", "'ri' AS term")
    linked = spark.range(300).selectExpr("id AS person_id", "id % 5 AS id")
    out = S.suggest(titles, req, linked, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "<=" in x], plan
    got = {}
    for r in out.collect():
        got.setdefault(r["person_id"], []).append((r["rank"], r["id"]))
    assert all(sorted(v) == list(enumerate([i for i in range(4) if i != p % 5][:3], 1)) for p, v in got.items()) and len(got) == 300
