"""Search queries: names of parts, texts of documents, field and leaf search.

Bindings: part names are the person names searched (F1-F3, F7, F15, W1),
document texts the relevance corpus (F6, the F9 fallback), part fields and
nested event records the field/leaf search (F4, F5), and customers with the
parts they ordered the suggestion requests (F13). Query batches and terms
are fixed parameters of a call; the searched tables are whole.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.operators import search as S
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import fold_sql, toks_sql, values_sql

# Query batches: parameters of a search call (the searched tables are whole).
NAME_QUERIES = [
    (1, "sma bol", 0, 3), (2, "re", 0, 3), (3, "large an", 0, 3), (4, "zzz", 0, 3),
    (5, "Wid-Get", 0, 3), (6, "  ", 0, 3), (7, "r%", 0, 3), (8, "É", 0, 3),
    (9, "blue", 1, 2), (10, "ring small", 0, 3), (11, "bo", 2, 2), (12, "e", 0, 3),
    (13, "red_", 0, 3), (14, "rouge bolt", 0, 3),
]
NAME_QCOLS = ["query_id", "text", "page", "size"]
FIELD_QUERIES = [(1, "ring"), (2, "ECO"), (3, "brand#1"), (4, "x"), (5, "zz"), (6, "al")]
LEAF_QUERIES = [(1, "clic"), (2, "user 1"), (3, "k7"), (4, "42"), (5, "RROR")]
TEXT_QUERIES = [(1, "the ouen ndernt"), (2, "enier qui les"), (3, "and of zzzz"), (4, "Élan der die"), (5, "   ")]
GF_QUERIES = [(1, "small ring"), (2, "Red  Widget"), (3, "blue"), (4, "large anvil"), (5, "ring")]
FALLBACK_QUERIES = [(1, "sma bol"), (2, "zzz"), (3, "the ouen"), (4, "re"), (5, "qq")]
SUGGEST_TERMS = ["ri", "bolt", "Red", "g"]


def batch(spark, rows, cols=("query_id", "text")):
    types = {"query_id": "bigint", "text": "string", "page": "int", "size": "int"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {types[c]}" for c in cols))


def part_names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def doc_texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _out(df):
    return df.select("query_id", "total", "rank", "id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------- SQL parts

TRIM = "trim(text)"


def prefix_sql(q: str, names: str, k: int | None) -> str:
    lim = f"WHERE rank <= {k}" if k else ""
    return f"""
  (WITH q AS ({q}), n AS ({names}),
  post AS (SELECT tok, id, count(*) AS tf FROM (SELECT id, unnest({toks_sql('name')}) AS tok FROM n) GROUP BY ALL),
  qw AS (SELECT DISTINCT query_id, unnest({toks_sql('text')}) AS w FROM q),
  nw AS (SELECT query_id, count(*) AS n_words FROM qw GROUP BY 1),
  m AS (SELECT qw.query_id, qw.w, post.id, sum(post.tf) AS tf FROM qw JOIN post ON starts_with(post.tok, qw.w) GROUP BY ALL),
  df AS (SELECT query_id, w, count(*) AS df FROM m GROUP BY ALL),
  s AS (SELECT m.query_id, m.id, count(*) AS nm, round(sum(m.tf * ln((SELECT count(*) FROM n) / df.df)), 9) AS score
        FROM m JOIN df USING (query_id, w) GROUP BY ALL),
  ok AS (SELECT s.query_id, s.id, s.score FROM s JOIN nw USING (query_id) WHERE s.nm = nw.n_words),
  t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ok)
  SELECT query_id, CAST(total AS BIGINT) AS total, CAST(rank AS BIGINT) AS rank, id, score FROM t {lim})"""


def substring_sql(q: str, names: str, k: int | None) -> str:
    lim = f"WHERE rank <= {k}" if k else ""
    return f"""
  (WITH q AS ({q}), n AS ({names}),
  h AS (SELECT DISTINCT q.query_id, n.id FROM q JOIN n ON contains({fold_sql('n.name')}, {fold_sql('trim(q.text)')})
        WHERE trim(q.text) <> ''),
  t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM h)
  SELECT query_id, CAST(total AS BIGINT) AS total, CAST(rank AS BIGINT) AS rank, id, CAST(0.0 AS DOUBLE) AS score FROM t {lim})"""


def bm25_sql(q: str, docs: str, k: int | None) -> str:
    lim = f"WHERE rank <= {k}" if k else ""
    return f"""
  (WITH q AS ({q}), d0 AS ({docs}), d AS (SELECT id, {toks_sql('text')} AS toks FROM d0),
  st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
  qw AS (SELECT DISTINCT query_id, unnest({toks_sql('text')}) AS w FROM q),
  post AS (SELECT tok, id, count(*) AS tf, any_value(dl) AS dl
           FROM (SELECT id, len(toks) AS dl, unnest(toks) AS tok FROM d) WHERE tok IN (SELECT w FROM qw) GROUP BY ALL),
  dfs AS (SELECT tok, count(*) AS df FROM post GROUP BY 1),
  s AS (SELECT qw.query_id, post.id,
               round(sum(ln(1 + ((SELECT n FROM st) - dfs.df + 0.5) / (dfs.df + 0.5))
                     * (post.tf * 2.2 / (post.tf + 1.2 * (1 - 0.75 + 0.75 * post.dl / (SELECT avgdl FROM st))))), 9) AS score
        FROM qw JOIN post ON post.tok = qw.w JOIN dfs ON dfs.tok = qw.w GROUP BY ALL),
  t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
  SELECT query_id, CAST(total AS BIGINT) AS total, CAST(rank AS BIGINT) AS rank, id, score FROM t {lim})"""


PART_NAMES_SQL = "SELECT p_partkey AS id, p_name AS name FROM part"
DOC_TEXTS_SQL = "SELECT doc_id AS id, text FROM documents"
NQ = values_sql(NAME_QUERIES, NAME_QCOLS)
LONG = f"SELECT * FROM {NQ} WHERE length({TRIM}) >= 3"
SHORT = f"SELECT * FROM {NQ} WHERE length({TRIM}) < 3"


def _r6(inner: str) -> str:
    return f"SELECT query_id, total, rank, id, round(score, 6) AS score FROM {inner}"


@register("F1_search_prefix_all", _r6(prefix_sql(f"SELECT * FROM {NQ}", PART_NAMES_SQL, 3)))
def q_prefix_all(spark, sf):
    """Every query word prefixes a word of the part name; top 3 by tf-idf."""
    return _out(S.search_prefix_all(part_names(spark, sf), batch(spark, NAME_QUERIES, NAME_QCOLS), 3))


@register("F2_search_substring", _r6(substring_sql(f"SELECT * FROM {NQ}", PART_NAMES_SQL, 3)))
def q_substring(spark, sf):
    """The folded query is a substring of the part name; first 3 by id."""
    return _out(S.search_substring(part_names(spark, sf), batch(spark, NAME_QUERIES, NAME_QCOLS), 3))


F3_SQL = _r6(f"({prefix_sql(LONG, PART_NAMES_SQL, 3)} UNION ALL {substring_sql(SHORT, PART_NAMES_SQL, 3)})")


@register("F3_search_auto", F3_SQL)
def q_auto(spark, sf):
    """Prefix search from 3 characters, substring search below."""
    return _out(S.search_auto(part_names(spark, sf), batch(spark, NAME_QUERIES, NAME_QCOLS), 3))


W1_SQL = _r6(f"({prefix_sql(LONG, PART_NAMES_SQL, 1)} UNION ALL {substring_sql(SHORT, PART_NAMES_SQL, 1)})")


@register("W1_top_k_per_query", W1_SQL)
def q_top1(spark, sf):
    """The single best hit per query (the merge job's k = 1)."""
    return _out(S.search_auto(part_names(spark, sf), batch(spark, NAME_QUERIES, NAME_QCOLS), 1))


F15_SQL = f"""
SELECT h.query_id, h.total, h.rank, h.id, round(h.score, 6) AS score, q.page, q.size,
       CAST(ceil(h.total / q.size) AS BIGINT) AS n_pages
FROM ({prefix_sql(LONG, PART_NAMES_SQL, None)} UNION ALL {substring_sql(SHORT, PART_NAMES_SQL, None)}) h
JOIN {NQ} q USING (query_id)
WHERE h.rank > q.page * q.size AND h.rank <= (q.page + 1) * q.size
"""


@register("F15_paginate", F15_SQL)
def q_paginate(spark, sf):
    """Page ``page`` of ``size`` hits per query, with the page count."""
    qs = batch(spark, NAME_QUERIES, NAME_QCOLS)
    p = S.paginate(S.search_auto, part_names(spark, sf), qs)
    return p.select("query_id", "total", "rank", "id", F.round("score", 6).alias("score"),
                    F.col("page").cast("bigint").alias("page"), F.col("size").cast("bigint").alias("size"), "n_pages")


def _fields_sql(q: str, rows: str, pred: str, limit: int, offset: int) -> str:
    return f"""
WITH q AS ({q}), r AS ({rows}),
h AS (SELECT q.query_id, r.id FROM q JOIN r ON ({pred}) WHERE trim(q.text) <> ''),
t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
             row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM h)
SELECT query_id, CAST(total AS BIGINT) AS total, CAST(rank AS BIGINT) AS rank, id FROM t
WHERE rank > {offset} AND rank <= {offset + limit}
"""


def _lc(col: str) -> str:
    return f"contains(lower({col}), lower(trim(q.text)))"


F4_SQL = _fields_sql(
    values_sql(FIELD_QUERIES, ["query_id", "text"]),
    "SELECT p_partkey AS id, p_name, p_type, p_brand FROM part",
    " OR ".join(_lc(f"r.{c}") for c in ("p_name", "p_type", "p_brand")), 5, 0,
)


@register("F4_search_fields_any", F4_SQL)
def q_fields_any(spark, sf):
    """Case-insensitive substring in name, type or brand; total and first 5 by id."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_brand", "p_size")
    return S.search_fields(rows, batch(spark, FIELD_QUERIES), ["p_name", "p_type", "p_brand"], limit=5)


def event_records(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type"),
        F.struct(
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
            F.array(F.col("event_type"), F.concat(F.lit("k"), k.cast("string"))).alias("tags"),
            k.alias("k"),
            F.col("value").alias("value"),
        ).alias("meta"),
    )


F5_SQL = _fields_sql(
    values_sql(LEAF_QUERIES, ["query_id", "text"]),
    "SELECT event_id AS id, event_type, 'User ' || user_id AS name, 'k' || json_extract_string(props, '$.k') AS tag FROM events",
    " OR ".join(_lc(f"r.{c}") for c in ("event_type", "name", "tag")), 5, 2,
)


@register("F5_search_any_leaf", F5_SQL)
def q_any_leaf(spark, sf):
    """Substring in any string leaf of a nested event record (numbers never match)."""
    return S.search_fields(event_records(spark, sf), batch(spark, LEAF_QUERIES), None, limit=5, offset=2)


TQ = values_sql(TEXT_QUERIES, ["query_id", "text"])


@register("F6_search_ranked", _r6(bm25_sql(f"SELECT * FROM {TQ}", DOC_TEXTS_SQL, 3)))
def q_ranked(spark, sf):
    """Any-word match over whole document texts, top 3 by BM25."""
    return _out(S.search_ranked(doc_texts(spark, sf), batch(spark, TEXT_QUERIES), 3))


GQ = values_sql(GF_QUERIES, ["query_id", "text"])
_GF_SPLIT = "regexp_extract(trim({x}), '^(\\S*)\\s*(.*)$', {i})"


def _gf(x: str, i: int) -> str:
    return _GF_SPLIT.format(x=fold_sql(x), i=i)


F7_SQL = f"""
WITH q AS (SELECT query_id, text, {_gf('text', 1)} AS g, {_gf('text', 2)} AS f FROM {GQ}),
n AS (SELECT p_partkey AS id, {_gf('p_name', 1)} AS g, {_gf('p_name', 2)} AS f FROM part),
e AS (SELECT q.query_id, n.id FROM q JOIN n ON q.g = n.g AND q.f = n.f WHERE q.f <> ''),
et AS (SELECT query_id, CAST(count(*) OVER (PARTITION BY query_id) AS BIGINT) AS total,
              CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS BIGINT) AS rank, id, 1.0 AS score,
              'given_family' AS method FROM e QUALIFY rank <= 3),
r AS (SELECT *, 'ranked' AS method FROM {bm25_sql("SELECT query_id, text FROM q WHERE f = '' AND g <> ''", "SELECT p_partkey AS id, p_name AS text FROM part", 3)})
SELECT query_id, total, rank, id, round(score, 6) AS score, method FROM et
UNION ALL SELECT query_id, total, rank, id, round(score, 6) AS score, method FROM r
"""


@register("F7_search_given_family", F7_SQL)
def q_given_family(spark, sf):
    """Two words: given name and family name must match; one word: ranked search."""
    r = S.search_given_family(part_names(spark, sf), batch(spark, GF_QUERIES), 3)
    return r.select("query_id", "total", "rank", "id", F.round("score", 6).alias("score"), "method")


FQ = values_sql(FALLBACK_QUERIES, ["query_id", "text"])
F9_SQL = f"""
WITH p AS (
  {prefix_sql(f"SELECT * FROM {FQ} WHERE length(trim(text)) >= 3", PART_NAMES_SQL, 3)}
  UNION ALL {substring_sql(f"SELECT * FROM {FQ} WHERE length(trim(text)) < 3", PART_NAMES_SQL, 3)}),
s AS {bm25_sql(f"SELECT * FROM {FQ} WHERE query_id NOT IN (SELECT query_id FROM p)", DOC_TEXTS_SQL, 3)}
SELECT query_id, total, rank, id, round(score, 6) AS score, 'primary' AS source FROM p
UNION ALL SELECT query_id, total, rank, id, round(score, 6) AS score, 'secondary' AS source FROM s
"""


@register("F9_search_with_fallback", F9_SQL)
def q_fallback(spark, sf):
    """Part names first; queries without a hit are answered from document texts."""
    qs = batch(spark, FALLBACK_QUERIES)
    prim = S.search_auto(part_names(spark, sf), qs, 3)
    docs = doc_texts(spark, sf)
    r = S.with_fallback(prim, qs, lambda missed: S.search_ranked(docs, missed, 3))
    return r.select("query_id", "total", "rank", "id", F.round("score", 6).alias("score"), "source")


def suggest_inputs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    terms = F.try_element_at(F.array(*[F.lit(t) for t in SUGGEST_TERMS]), (F.col("c_custkey") % len(SUGGEST_TERMS) + 1).cast("int"))
    req = c.select(F.col("c_custkey").alias("person_id"), terms.alias("term"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    linked = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("person_id"), F.col("l_partkey").alias("id")
    ).distinct()
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return titles, req, linked


_TERM_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SUGGEST_TERMS))
F13_SQL = f"""
WITH req AS (SELECT c_custkey AS person_id, CASE c_custkey % {len(SUGGEST_TERMS)} {_TERM_CASE} END AS term FROM customer),
linked AS (SELECT DISTINCT o_custkey AS person_id, l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cand AS (SELECT r.person_id, r.term, p.p_partkey AS id, p.p_name AS title
         FROM req r JOIN part p ON contains(lower(p.p_name), lower(trim(r.term))) WHERE length(trim(r.term)) >= 2),
nl AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.person_id = cand.person_id AND l.id = cand.id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY person_id, term ORDER BY title, id) AS rank FROM nl)
SELECT person_id, term, CAST(rank AS BIGINT) AS rank, id, title FROM rk WHERE rank <= 10
"""


@register("F13_suggest", F13_SQL)
def q_suggest(spark, sf):
    """Ten part titles containing each customer's term, minus parts they already have."""
    titles, req, linked = suggest_inputs(spark, sf)
    return S.suggest(titles, req, linked, 10)
