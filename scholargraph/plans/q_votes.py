"""Vote queries: last ranks, first links, scoreboards, permissions, change logs.

Bindings: events are rank values of votes (person = user, concept = k, owner =
one of three users per person, rank = floor(value) - 50, ordered by time and
event id); line items are keyword links of persons (supplier key) to concepts
(the last two digits of the part key; two properties by line parity, base rank =
line number - 4), so there are as many (person, concept) keys as the tables give; suppliers are users
(role by key % 5, two labs from the nation), customers are persons (lab =
nation, account by key); events after a cutoff are a create / update /
delete change log by user event_id % 10.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholargraph.operators import votes as V
from scholargraph.plans.q_ingest import CUTOFF
from scholargraph.plans.q_persons import LINE_POS_SQL, line_pos
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import values_sql
from scholargraph.session import ensure_checkpoint_dir
from scholargraph.streaming import votes as stream

KEYWORD_PROPS = ["dcterms:subject", "curation:keyword"]
EVALUATOR = 3
# Titles of concepts (accents and capitals exercise the locale sort).
CONCEPT_TITLES = ["Écologie", "economie", "Énergie", "art", "Zoologie", "éthique", "Biologie", "chimie", "Droit", "histoire"]
CONCEPTS = [(i, f"{CONCEPT_TITLES[i % 10]} {i}") for i in range(100)]


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def vote_ranks(spark, sf):
    """Events as rank values of votes; vote id = person-concept-owner."""
    e = table(spark, sf, "events")
    person, concept = F.col("user_id"), _k() % 100
    owner = F.col("user_id") % 8 * 3 + F.col("event_id") % 3
    return e.select(
        ((person * 1000 + concept) * 100 + owner).alias("vote_id"), person.alias("person_id"), concept.cast("bigint").alias("concept_id"),
        owner.alias("owner_id"), (F.floor("value") - 50).cast("int").alias("rank"), F.struct("ts", "event_id").alias("seq"),
    )


VOTES_SQL = """
  SELECT (user_id * 1000 + k) * 100 + user_id % 8 * 3 + event_id % 3 AS vote_id, user_id AS person_id, CAST(k AS BIGINT) AS concept_id,
         user_id % 8 * 3 + event_id % 3 AS owner_id, CAST(floor(value) - 50 AS INT) AS rank, ts, event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 100 AS k FROM events)
"""
LAST_SQL = f"""
  SELECT vote_id, person_id, concept_id, owner_id, CAST(rank AS BIGINT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({VOTES_SQL})) WHERE rn = 1
"""


@register("W2_last_rank", LAST_SQL)
def q_last_rank(spark, sf):
    """Each vote's last rank value."""
    return V.last_rank(vote_ranks(spark, sf))


def keyword_links(spark, sf):
    li = table(spark, sf, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    return li.select(
        F.col("l_suppkey").alias("person_id"), (F.col("l_partkey") % 100).alias("concept_id"),
        F.when(even, F.lit(KEYWORD_PROPS[0])).otherwise(F.lit(KEYWORD_PROPS[1])).alias("property"),
        line_pos().alias("pos"), (F.col("l_linenumber") - 4).alias("rank"),
    )


FIRST_SQL = f"""
  SELECT person_id, concept_id, property, CAST(base_rank AS BIGINT) AS base_rank FROM (
    SELECT l_suppkey AS person_id, l_partkey % 100 AS concept_id,
           CASE WHEN l_linenumber % 2 = 0 THEN '{KEYWORD_PROPS[0]}' ELSE '{KEYWORD_PROPS[1]}' END AS property,
           l_linenumber - 4 AS base_rank,
           row_number() OVER (PARTITION BY l_suppkey, l_partkey % 100
                              ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END, {LINE_POS_SQL}) AS rn
    FROM lineitem l) WHERE rn = 1
"""


@register("W3_first_link", FIRST_SQL)
def q_first_link(spark, sf):
    """The first keyword property linking each concept to each person."""
    return V.first_link(keyword_links(spark, sf), KEYWORD_PROPS)


# ------------------------------------------------------------ F14 access


def users(spark, sf):
    s = table(spark, sf, "supplier")
    r = F.col("s_suppkey") % 5
    role = F.when(r == 0, "global_admin").when(r.isin(1, 2), "reviewer").when(r == 3, "author").otherwise("researcher")
    return s.select(
        F.col("s_suppkey").alias("user_id"), F.concat(F.lit("acct"), F.col("s_suppkey").cast("string")).alias("name"),
        role.alias("role"),
        F.array(F.col("s_nationkey").cast("bigint"), ((F.col("s_nationkey") + 1) % 25).cast("bigint")).alias("labs"),
    )


def persons(spark, sf):
    c = table(spark, sf, "customer")
    lab = F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey").cast("bigint"))
    return c.select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("acct"), F.col("c_custkey").cast("string")).alias("account"),
                    lab.alias("lab_id"), F.col("c_name").alias("person"))


def person_labs(spark, sf):
    return persons(spark, sf).where("lab_id is not null").select("person_id", "lab_id")


USERS_SQL = """
  SELECT s_suppkey AS user_id, 'acct' || s_suppkey AS name,
         CASE s_suppkey % 5 WHEN 0 THEN 'global_admin' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'reviewer'
                            WHEN 3 THEN 'author' ELSE 'researcher' END AS role,
         CAST(s_nationkey AS BIGINT) AS lab1, CAST((s_nationkey + 1) % 25 AS BIGINT) AS lab2
  FROM supplier
"""
PERSONS_SQL = "SELECT c_custkey AS person_id, 'acct' || c_custkey AS account, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS lab, c_name AS person FROM customer"
F14_SQL = f"""
WITH u AS ({USERS_SQL}), p AS ({PERSONS_SQL})
SELECT user_id, 'all' AS scope, NULL::BIGINT AS lab_id, NULL::BIGINT AS person_id FROM u WHERE role IN ('global_admin', 'site_admin')
UNION ALL SELECT user_id, 'lab', lab1, NULL FROM u WHERE role = 'reviewer'
UNION ALL SELECT user_id, 'lab', lab2, NULL FROM u WHERE role = 'reviewer'
UNION ALL SELECT u.user_id, 'person', NULL, p.person_id FROM u JOIN p ON p.account = u.name WHERE u.role = 'author'
"""


@register("F14_access_matrix", F14_SQL)
def q_access(spark, sf):
    """Edit rules: admins all persons, reviewers their labs, authors their own record."""
    return V.access_rules(users(spark, sf), persons(spark, sf))


ALLOWED_SQL = f"""
  SELECT p.person_id FROM ({PERSONS_SQL}) p, ({USERS_SQL}) u
  WHERE u.user_id = {EVALUATOR} AND (u.role IN ('global_admin', 'site_admin')
        OR (u.role = 'reviewer' AND p.lab IN (u.lab1, u.lab2)) OR (u.role = 'author' AND p.account = u.name))
"""


def allowed_for(spark, sf, user_id, person_ids):
    rules = V.access_rules(users(spark, sf), persons(spark, sf))
    ok = V.editable_persons(rules, person_labs(spark, sf), persons(spark, sf), user_id)
    return person_ids.select("person_id").distinct().join(ok, "person_id", "left_semi")


# ------------------------------------------------------------ A3 board


def board(spark, sf, evaluator=EVALUATOR):
    links = V.first_link(keyword_links(spark, sf), KEYWORD_PROPS)
    votes = V.last_rank(vote_ranks(spark, sf))
    allowed = allowed_for(spark, sf, evaluator, links)
    return V.scoreboard(links, votes, evaluator, allowed)


BOARD_SQL = f"""
  WITH fl AS ({FIRST_SQL}), lv AS ({LAST_SQL}),
  v AS (SELECT lv.person_id, lv.concept_id, lv.vote_id, lv.owner_id, lv.rank FROM lv
        WHERE (person_id, concept_id) IN (SELECT (person_id, concept_id) FROM fl)
        UNION ALL SELECT person_id, concept_id, -1, 0, base_rank FROM fl WHERE base_rank <> 0),
  a AS (SELECT person_id, concept_id, sum(rank) AS rank_sum, count(*) AS n_votes,
               max(CASE WHEN owner_id = {EVALUATOR} THEN 1 ELSE 0 END) AS has_mine,
               arg_min(rank, vote_id) FILTER (WHERE owner_id = {EVALUATOR}) AS my_rank
        FROM v GROUP BY 1, 2),
  al AS ({ALLOWED_SQL})
  SELECT fl.person_id, fl.concept_id, fl.property, fl.base_rank,
         CAST(coalesce(a.rank_sum, 0) AS BIGINT) AS rank_sum,
         CASE WHEN coalesce(a.rank_sum, 0) > 0 THEN 'pos' ELSE 'neg' END AS cls,
         CASE WHEN coalesce(a.rank_sum, 0) > 0 THEN '+' ELSE '' END AS sign,
         CAST(coalesce(a.n_votes, 0) AS BIGINT) AS n_votes, CAST(coalesce(a.has_mine, 0) AS BIGINT) AS has_mine,
         CAST(coalesce(a.my_rank, 0) AS BIGINT) AS my_rank,
         CAST(CASE WHEN coalesce(a.has_mine, 0) = 0 AND fl.person_id IN (SELECT person_id FROM al) THEN 1 ELSE 0 END AS BIGINT) AS slot
  FROM fl LEFT JOIN a USING (person_id, concept_id)
"""


@register("A3_scoreboard", BOARD_SQL)
def q_scoreboard(spark, sf):
    """Summed expertise per linked (person, concept) for evaluator 3."""
    return board(spark, sf)


# An administrator without votes of their own: gets an empty slot everywhere.
LIST_EVALUATOR = 25
LIST_SQL = f"""
WITH fl AS ({FIRST_SQL}), u AS ({USERS_SQL}), p AS ({PERSONS_SQL}),
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({VOTES_SQL})) WHERE rn = 1),
al AS (SELECT p.person_id FROM p, u WHERE u.user_id = {LIST_EVALUATOR} AND (u.role IN ('global_admin', 'site_admin')
        OR (u.role = 'reviewer' AND p.lab IN (u.lab1, u.lab2)) OR (u.role = 'author' AND p.account = u.name))),
given AS (SELECT lv.person_id, lv.concept_id, lv.vote_id, CAST(lv.owner_id AS BIGINT) AS owner_id, strftime(lv.ts, '%d/%m/%Y') AS created,
                 CAST(lv.rank AS BIGINT) AS rank FROM lv JOIN fl USING (person_id, concept_id)),
linked AS (SELECT person_id, concept_id, NULL::BIGINT AS vote_id, 0::BIGINT AS owner_id, '-' AS created, base_rank AS rank FROM fl WHERE base_rank <> 0),
shown AS (SELECT *, CASE WHEN rank > 0 THEN 'pos' ELSE 'neg' END AS cls FROM (SELECT * FROM given UNION ALL SELECT * FROM linked)),
slots AS (SELECT person_id, concept_id, NULL::BIGINT, {LIST_EVALUATOR}::BIGINT, '-', 0::BIGINT, 'pos' FROM fl
          WHERE person_id IN (SELECT person_id FROM al)
            AND NOT EXISTS (SELECT 1 FROM given g WHERE g.person_id = fl.person_id AND g.concept_id = fl.concept_id AND g.owner_id = {LIST_EVALUATOR}))
SELECT s.person_id, s.concept_id, s.vote_id, s.owner_id, u.name AS owner_name, s.created, s.rank, s.cls,
       CASE WHEN s.rank > 0 THEN '+' ELSE '' END AS sign
FROM (SELECT * FROM shown UNION ALL SELECT * FROM slots) s LEFT JOIN u ON u.user_id = s.owner_id
"""


@register("A3_vote_list", LIST_SQL)
def q_vote_list(spark, sf):
    """The votes behind every linked (person, concept), with the empty slot of user 25."""
    created = F.date_format(F.col("seq.ts"), "dd/MM/yyyy")
    votes = vote_ranks(spark, sf).groupBy("vote_id").agg(
        F.max_by(F.struct("person_id", "concept_id", "owner_id", "rank", created.alias("created")), "seq").alias("_v")
    ).select("vote_id", "_v.*")
    return V.vote_list(board(spark, sf, LIST_EVALUATOR), votes, users(spark, sf), LIST_EVALUATOR)


def concept_titles(spark):
    return spark.createDataFrame(CONCEPTS, "concept_id bigint, title string")


TITLES_SQL = values_sql(CONCEPTS, ["concept_id", "title"])
F11_STATUSES = V.STATUSES
F11_TEXT = "o"
_COND = {"all": "TRUE", "todo": "has_mine = 0", "done": "has_mine = 1", "pos": "rank_sum > 0", "neg": "rank_sum <= 0"}
F11_SQL = "\nUNION ALL\n".join(
    f"""SELECT person_id, CAST(sum(CASE WHEN contains(lower(coalesce(t.title, '')), '{F11_TEXT}') AND {_COND[st]} THEN 1 ELSE 0 END) AS BIGINT) AS n_visible,
       CAST(count(*) AS BIGINT) AS n_total, '{st}' AS status
FROM ({BOARD_SQL}) b LEFT JOIN {TITLES_SQL} t USING (concept_id) GROUP BY person_id"""
    for st in F11_STATUSES
)


@register("F11_filter_scoreboard", F11_SQL)
def q_filter_board(spark, sf):
    """Visible/total keyword counts per person for text 'o' under each status."""
    return V.filter_scoreboard(board(spark, sf), concept_titles(spark), F11_TEXT)


W6_SQL = f"""
SELECT person_id, concept_id, title, rank_sum,
       row_number() OVER (PARTITION BY person_id ORDER BY strip_accents(lower(title)), concept_id) AS position
FROM ({BOARD_SQL}) b LEFT JOIN {TITLES_SQL} t USING (concept_id)
"""


@register("W6_sort_scoreboard", W6_SQL)
def q_sort_board(spark, sf):
    """Each person's keywords in French title order."""
    s = V.sort_scoreboard(board(spark, sf), concept_titles(spark), "title", True, "fr")
    return s.select("person_id", "concept_id", "title", "rank_sum", "position")


# ------------------------------------------------------------ C1 changes


def vote_events(spark, sf, before: bool):
    """Changes after the cutoff name a person of their own for updates and
    deletes; only the stored vote's person counts."""
    e = table(spark, sf, "events")
    cond = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    e = e.where(cond if before else ~cond)
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    person = F.col("user_id") if before else F.when(op == "create", F.col("user_id")).otherwise(F.col("event_id") % 100)
    return e.select(
        op.alias("op"), (F.col("user_id") * 10 + _k() % 10).alias("vote_id"), person.alias("person_id"),
        (_k() % 10).cast("bigint").alias("concept_id"), (F.floor("value") - 50).cast("bigint").alias("rank"),
        (F.col("event_id") % 10).alias("user_id"), F.date_format("ts", "dd/MM/yyyy").alias("day"), F.struct("ts", "event_id").alias("seq"),
    )


def _vote_events_sql(where: str) -> str:
    return f"""SELECT CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
         user_id * 10 + k AS vote_id, user_id AS person_id, CAST(k AS BIGINT) AS concept_id,
         CAST(floor(value) - 50 AS BIGINT) AS rank, event_id % 10 AS changer, strftime(ts, '%d/%m/%Y') AS day, ts, event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events) WHERE {where}"""


_MAY_EDIT = """u.role IN ('global_admin', 'site_admin') OR (u.role = 'reviewer' AND p.lab IN (u.lab1, u.lab2))
          OR (u.role = 'author' AND p.account = u.name)"""
C1_SQL = f"""
WITH pre AS ({_vote_events_sql(f"ts < TIMESTAMP '{CUTOFF}'")}),
target AS (SELECT vote_id, person_id, concept_id, rank, changer AS owner_id FROM (
    SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY ts DESC, event_id DESC) AS rn FROM pre) WHERE rn = 1),
ch AS ({_vote_events_sql(f"ts >= TIMESTAMP '{CUTOFF}'")}),
u AS ({USERS_SQL}), p AS ({PERSONS_SQL}), t AS (SELECT * FROM {values_sql(CONCEPTS, ["concept_id", "title"])}),
may AS (SELECT ch.* FROM ch JOIN u ON u.user_id = ch.changer LEFT JOIN p ON p.person_id = ch.person_id WHERE ch.op = 'create' AND ({_MAY_EDIT})),
inc AS (SELECT *, NULL::STRUCT(ts TIMESTAMP, e BIGINT) AS since, NULL::VARCHAR AS day FROM target
        UNION ALL SELECT vote_id, person_id, concept_id, rank, changer, {{'ts': ts, 'e': event_id}}, day FROM may),
met AS (SELECT ch.op, ch.vote_id, ch.rank, ch.changer, ch.day, {{'ts': ch.ts, 'e': ch.event_id}} AS moment, i.person_id,
               row_number() OVER (PARTITION BY ch.event_id ORDER BY i.since DESC NULLS LAST) AS rn
        FROM ch JOIN inc i USING (vote_id) WHERE ch.op <> 'create' AND (i.since IS NULL OR {{'ts': ch.ts, 'e': ch.event_id}} > i.since)),
ok AS (SELECT met.* FROM met JOIN u ON u.user_id = met.changer LEFT JOIN p ON p.person_id = met.person_id WHERE rn = 1 AND ({_MAY_EDIT})),
del AS (SELECT vote_id, max(moment) AS gone FROM ok WHERE op = 'delete' GROUP BY 1),
base AS (SELECT * FROM (SELECT inc.*, row_number() OVER (PARTITION BY inc.vote_id ORDER BY since NULLS FIRST) AS rn
         FROM inc LEFT JOIN del ON del.vote_id = inc.vote_id WHERE del.gone IS NULL OR inc.since > del.gone) WHERE rn = 1),
up AS (SELECT * FROM (SELECT ok.vote_id, ok.rank, ok.changer, ok.day, row_number() OVER (PARTITION BY ok.vote_id ORDER BY ok.moment DESC) AS rn
       FROM ok JOIN base b ON b.vote_id = ok.vote_id WHERE ok.op = 'update' AND (b.since IS NULL OR ok.moment > b.since)) WHERE rn = 1),
res AS (SELECT b.vote_id, b.person_id, b.concept_id, coalesce(up.rank, b.rank) AS rank, b.owner_id,
               CASE WHEN up.vote_id IS NOT NULL THEN 'update' WHEN b.since IS NOT NULL THEN 'create' END AS kind,
               CASE WHEN up.vote_id IS NOT NULL THEN up.changer WHEN b.since IS NOT NULL THEN b.owner_id END AS by_user, coalesce(up.day, b.day) AS day
        FROM base b LEFT JOIN up ON up.vote_id = b.vote_id)
SELECT res.vote_id, res.person_id, res.concept_id, res.rank, res.owner_id, res.kind, res.by_user AS user_id, res.day,
       CASE WHEN kind IS NOT NULL THEN printf(CASE kind WHEN 'create' THEN '{V.CREATED_TITLE}' ELSE '{V.UPDATED_TITLE}' END,
            coalesce(t.title, ''), res.rank, coalesce(p.person, ''), coalesce(u.name, ''), res.day) END AS title
FROM res LEFT JOIN t ON t.concept_id = res.concept_id LEFT JOIN p ON p.person_id = res.person_id LEFT JOIN u ON u.user_id = res.by_user
"""


def vote_target(spark, sf):
    """The votes before the cutoff, with their owners."""
    pre = vote_events(spark, sf, True)
    return pre.groupBy("vote_id").agg(
        F.max_by(F.struct("person_id", "concept_id", "rank", F.col("user_id").alias("owner_id")), "seq").alias("_v")
    ).select("vote_id", "_v.*")


def titled(spark, sf, decided):
    concepts = concept_titles(spark).withColumnRenamed("title", "concept")
    return V.with_vote_titles(decided, concepts, persons(spark, sf).select("person_id", "person"), users(spark, sf))


@register("C1_apply_vote_changes", C1_SQL)
def q_vote_changes(spark, sf):
    """Votes before the cutoff with the later create/update/delete changes applied, by the stored vote's rights."""
    rules = V.access_rules(users(spark, sf), persons(spark, sf))
    decided, _ = V.vote_changes(vote_target(spark, sf), vote_events(spark, sf, False), rules, person_labs(spark, sf))
    return titled(spark, sf, decided)


@register("C1_vote_changes_in_batches", C1_SQL)
def q_vote_changes_in_batches(spark, sf):
    """The same changes in two batches on a bucketed vote table: the log cut anywhere gives the one-shot result."""
    rules, labs = V.access_rules(users(spark, sf), persons(spark, sf)), person_labs(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/votes-{uuid.uuid4().hex}"
    store = stream.vote_store(spark, path, 16)
    target = vote_target(spark, sf).withColumns({"kind": F.lit(None).cast("string"), "user_id": F.lit(None).cast("bigint"), "day": F.lit(None).cast("string")})
    store.upsert(target.withColumn("seq", F.lit(0)))
    changes, middle = vote_events(spark, sf, False), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    stream.apply_changes(store, changes.where(F.col("seq.ts") < middle), rules, labs, ("log", 0))
    stream.apply_changes(store, changes.where(F.col("seq.ts") >= middle), rules, labs, ("log", 1))
    return titled(spark, sf, store.read())
