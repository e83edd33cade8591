"""Graph queries: item filters, entity resolution, statement merges, cards.

Bindings: orders are items with status / priority / customer statements
(F10); customers with key % 3 != 0 have a person item (key*10+1, titled in
capitals for even keys; keys % 7 = 0 a second item of the same name) with
some family-name, identifier and reference statements; part types, brands
and sizes are domain tags of three tiers with existing concept items for a
subset of parts (J2); suppliers are structures with stored references
``S<key>-<nation>`` (J3); order lines give co-authors and keyword links.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholargraph.operators import canon
from scholargraph.operators import graph as G
from scholargraph.plans.q_ingest import person_table
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import fold_sql
from scholargraph.session import ensure_checkpoint_dir
from scholargraph.sources import layout


def _nul():
    return F.lit(None).cast("string")


def _stmt(df, item, prop, typ, value=None, uri=None, label=None, target=None):
    return df.select(
        item.alias("item_id"), F.lit(prop).alias("property"), F.lit(typ).alias("type"),
        (value if value is not None else _nul()).alias("value"), (uri if uri is not None else _nul()).alias("uri"),
        (label if label is not None else _nul()).alias("label"),
        (target if target is not None else F.lit(None).cast("bigint")).alias("target_id"),
    )


def srow(prop, typ, value=None, uri=None, label=None, when=None):
    """One statement of a row as a struct, or null when ``when`` is false."""
    st = F.struct(
        F.lit(prop).alias("property"), F.lit(typ).alias("type"),
        (value if value is not None else _nul()).cast("string").alias("value"),
        (uri if uri is not None else _nul()).cast("string").alias("uri"),
        (label if label is not None else _nul()).cast("string").alias("label"),
    )
    return st if when is None else F.when(when, st)


def long_statements(df, item, rows):
    """Unpivot a table into statements in one pass: ``inline`` of an array
    of per-row statement structs, conditional ones dropped (no union of
    one scan per property)."""
    arr = F.filter(F.array(*rows), lambda x: x.isNotNull())
    out = df.select(item.alias("item_id"), F.inline(arr))
    return out.withColumn("target_id", F.lit(None).cast("bigint"))


# ------------------------------------------------------------ person items
# Customers with key % 3 != 0 have an item (key*10+1); keys % 7 = 0 also a
# second item with the same name (key*10+2). Even keys are titled in capitals.


def person_items(spark, sf):
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    a = c.where(ck % 3 != 0).select((ck * 10 + 1).alias("item_id"), ck.alias("c_custkey"),
                                    F.when(ck % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("title"))
    b = c.where((ck % 3 != 0) & (ck % 7 == 0)).select((ck * 10 + 2).alias("item_id"), ck.alias("c_custkey"),
                                                      F.col("c_name").alias("title"))
    return a.unionByName(b).withColumn("class", F.lit("foaf:Person"))


def person_item_statements(spark, sf):
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    has = c.where(ck % 3 != 0)
    k = ck.cast("string")
    main = long_statements(has, ck * 10 + 1, [
        srow(G.TITLE, "literal", F.when(ck % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))),
        srow(G.FAMILY_NAME, "literal", F.col("c_mktsegment"), when=ck % 2 == 0),
        srow(G.IDENTIFIER, "literal", F.concat(F.lit("person:"), k), when=ck % 5 == 0),
        srow(G.REFERENCED_BY, "uri", uri=F.concat(F.lit("https://old.example/"), k), label=F.concat(F.lit("old:"), k), when=ck % 4 == 0),
    ])
    dup = long_statements(has.where(ck % 7 == 0), ck * 10 + 2, [srow(G.TITLE, "literal", F.col("c_name"))])
    return main.unionByName(dup)


PERSON_ITEMS_SQL = """
  SELECT c_custkey * 10 + 1 AS item_id, c_custkey,
         CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS title
  FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey * 10 + 2, c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 = 0
"""
PERSON_STMTS_SQL = f"""
  SELECT item_id, 'dcterms:title' AS property, 'literal' AS type, title AS value, NULL::VARCHAR AS uri, NULL::VARCHAR AS label
  FROM ({PERSON_ITEMS_SQL})
  UNION ALL SELECT c_custkey * 10 + 1, 'foaf:familyName', 'literal', c_mktsegment, NULL, NULL
    FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0
  UNION ALL SELECT c_custkey * 10 + 1, 'dcterms:identifier', 'literal', 'person:' || c_custkey, NULL, NULL
    FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0
  UNION ALL SELECT c_custkey * 10 + 1, 'dcterms:isReferencedBy', 'uri', NULL, 'https://old.example/' || c_custkey, 'old:' || c_custkey
    FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0
"""
STMT_OUT = ["item_id", "property", "type", "value", "uri", "label"]


# --------------------------------------------------------------- F10

F10_SQL = """
SELECT o_orderkey AS item_id, 'Order ' || o_orderkey AS title FROM orders
WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""


@register("F10_filter_items", F10_SQL)
def q_filter_items(spark, sf):
    """Open urgent orders of building-segment customers (class filter + 4 predicates)."""
    o = table(spark, sf, "orders")
    ok = F.col("o_orderkey")
    items = o.select(ok.alias("item_id"), F.when(ok % 10 == 0, _nul()).otherwise(F.lit("bibo:Document")).alias("class"),
                     _nul().alias("template"), F.concat(F.lit("Order "), ok.cast("string")).alias("title"))
    st = (
        _stmt(o, ok, "status", "literal", F.col("o_orderstatus"))
        .unionByName(_stmt(o, ok, "priority", "literal", F.col("o_orderpriority")))
        .unionByName(_stmt(o, ok, "customer", "resource", target=F.col("o_custkey")))
    )
    targets = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("item_id"))
    preds = [
        G.Predicate("status", "eq", "O"),
        G.Predicate("priority", "contains", "URGENT"),
        G.Predicate("customer", "links_to", targets=targets),
        G.Predicate("priority", "exists"),
    ]
    return G.filter_items(items, st, preds, cls="bibo:Document").select("item_id", "title")


# ---------------------------------------------------------------- J1

J1_SQL = f"""
WITH st AS ({PERSON_STMTS_SQL}),
m AS (SELECT {fold_sql('value')} AS k, min(item_id) AS item_id FROM st WHERE property = 'dcterms:title' GROUP BY 1)
SELECT c.c_custkey AS person_id, m.item_id FROM customer c LEFT JOIN m ON {fold_sql('c.c_name')} = m.k
"""


@register("J1_match_items_by_name", J1_SQL)
def q_match_items(spark, sf):
    """Each customer's existing person item by folded full name (smallest id)."""
    persons = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fullName"))
    return G.match_items_by_name(persons, person_item_statements(spark, sf))


# ---------------------------------------------------------------- J2


def concept_tags(spark, sf):
    p = table(spark, sf, "part")
    pk = F.col("p_partkey")
    return p.select(
        F.col("p_type").alias("label"),
        F.when(pk % 3 == 0, F.lit("wikidata")).when(pk % 3 == 1, F.lit("brand")).alias("type"),
        F.when(pk % 3 == 0, F.concat(F.lit("Q"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")).alias("code"),
    )


def concept_statements(spark, sf):
    p = table(spark, sf, "part").where((F.col("p_partkey") % 5 == 0) & (F.col("p_size") % 4 != 0))
    pk = F.col("p_partkey")
    item = pk + 500000
    w = _stmt(p.where(pk % 3 == 0), item, G.REFERENCED_BY, "uri",
              uri=F.concat(F.lit(G.WIKIDATA_URL + "Q"), F.col("p_size").cast("string")), label=F.lit("wikidata"))
    b = _stmt(p.where(pk % 3 == 1), item, G.REFERENCED_BY, "literal", F.concat(F.lit("brand_"), F.col("p_brand")))
    lab = _stmt(p.where(pk % 3 == 2), item, G.PREF_LABEL, "literal", F.col("p_type"))
    return w.unionByName(b).unionByName(lab)


def _hash_sql(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


J2_SQL = f"""
WITH t AS (
  SELECT p_type AS label,
         CASE p_partkey % 3 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'brand' END AS type,
         CASE WHEN p_partkey % 3 = 0 THEN 'Q' || p_size ELSE p_brand END AS code FROM part),
k AS (SELECT label,
             CASE WHEN type = 'wikidata' THEN 'uri' WHEN code IS NOT NULL AND type IS NOT NULL THEN 'value' ELSE 'label' END AS kind,
             CASE WHEN type = 'wikidata' THEN '{G.WIKIDATA_URL}' || code
                  WHEN code IS NOT NULL AND type IS NOT NULL THEN type || '_' || code ELSE label END AS key FROM t),
keys AS (SELECT kind, key, min(label) AS label FROM k WHERE key IS NOT NULL GROUP BY 1, 2),
p AS (SELECT * FROM part WHERE p_partkey % 5 = 0 AND p_size % 4 <> 0),
st AS (SELECT 'uri' AS kind, '{G.WIKIDATA_URL}Q' || p_size AS key, p_partkey + 500000 AS item_id FROM p WHERE p_partkey % 3 = 0
       UNION ALL SELECT 'value', 'brand_' || p_brand, p_partkey + 500000 FROM p WHERE p_partkey % 3 = 1
       UNION ALL SELECT 'label', p_type, p_partkey + 500000 FROM p WHERE p_partkey % 3 = 2),
f AS (SELECT kind, key, min(item_id) AS found_id FROM st GROUP BY 1, 2)
SELECT keys.kind, keys.key, keys.label,
       coalesce(f.found_id, {_hash_sql("keys.kind || chr(1) || keys.key")}) AS item_id,
       CASE WHEN f.found_id IS NULL THEN 'created' ELSE 'found' END AS status
FROM keys LEFT JOIN f USING (kind, key)
"""


@register("J2_resolve_concepts", J2_SQL)
def q_resolve_concepts(spark, sf):
    """Concept item per distinct domain key (Wikidata URI, type_code or label): found or created."""
    resolved, _new = G.resolve_concepts(concept_tags(spark, sf), concept_statements(spark, sf))
    return resolved


# ------------------------------------------------------------- J3 / P5


def structure_id_col():
    sk = F.col("s_suppkey")
    return F.when(sk % 9 == 0, F.concat(F.lit("ED"), sk.cast("string"))).otherwise(F.concat(F.lit("S"), sk.cast("string")))


STRUCTURE_ID_SQL = "CASE WHEN s_suppkey % 9 = 0 THEN 'ED' || s_suppkey ELSE 'S' || s_suppkey END"


def org_structures(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    s = table(spark, sf, "supplier")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        structure_id_col().alias("structure_id"), F.col("s_name").alias("label"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("university"))).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )


def org_ref_statements(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 4 != 0)
    ref = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("-"), F.col("s_nationkey").cast("string"))
    # later items hold older values, so the oldest value is not the smallest item
    return _stmt(s, F.col("s_suppkey") * 10 + 4, G.REFERENCED_BY, "literal", ref).withColumn("value_id", -F.col("item_id"))


J3_CORE_SQL = f"""
  s AS (SELECT DISTINCT {STRUCTURE_ID_SQL} AS structure_id, s_name AS label,
               CASE WHEN s_suppkey % 2 = 0 THEN 'university' END AS kind0
        FROM (SELECT DISTINCT l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey),
  refs AS (SELECT s_suppkey * 10 + 4 AS item_id, 'S' || s_suppkey || '-' || s_nationkey AS value
           FROM supplier WHERE s_suppkey % 4 <> 0),
  f AS (SELECT s.structure_id, max(refs.item_id) AS found_id FROM s JOIN refs ON starts_with(refs.value, s.structure_id) GROUP BY 1),
  j3 AS (SELECT s.structure_id, s.label,
                coalesce(f.found_id, {_hash_sql("'org' || chr(1) || s.structure_id")}) AS item_id,
                CASE WHEN f.found_id IS NULL THEN 'created' ELSE 'found' END AS status,
                CASE WHEN starts_with(s.structure_id, 'ED') THEN 'Ecole doctorale' ELSE coalesce(s.kind0, 'no') END AS org_type
         FROM s LEFT JOIN f USING (structure_id))
"""
J3_SQL = f"WITH {J3_CORE_SQL} SELECT * FROM j3"


@register("J3_resolve_orgs", J3_SQL)
def q_resolve_orgs(spark, sf):
    """Organisation item of each supplier structure id: oldest reference with that prefix, or created."""
    resolved, _new = G.resolve_orgs(org_structures(spark, sf), org_ref_statements(spark, sf))
    return resolved


P5_SQL = f"""
WITH {J3_CORE_SQL},
a AS (SELECT o.o_custkey AS person_id, {STRUCTURE_ID_SQL} AS structure_id,
             CASE WHEN s_suppkey % 22 = 0 THEN '' WHEN s_suppkey % 11 <> 0 THEN any_value(s_name) END AS label,
             count(*) AS publications_count, strftime(min(l_shipdate), '%Y-%m-%d') AS start_date,
             strftime(max(l_shipdate), '%Y-%m-%d') AS end_date
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier ON l.l_suppkey = s_suppkey
      GROUP BY o.o_custkey, s_suppkey)
SELECT a.person_id, a.structure_id, j3.item_id AS org_item_id, CAST(a.publications_count AS VARCHAR) AS publications_count,
       a.start_date, a.end_date
FROM a LEFT JOIN j3 USING (structure_id) WHERE a.label IS NOT NULL
"""


@register("P5_affiliation_statements", P5_SQL)
def q_affiliations(spark, sf):
    """Person-to-organisation links (with annotation values) for labelled affiliations."""
    from scholargraph.plans.q_persons import affiliation_entries

    from scholargraph.operators import person_graph as pg

    a = affiliation_entries(spark, sf)
    a = a.withColumn("structure_id", F.when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("ED"), F.col("l_suppkey").cast("string")))
                     .otherwise(F.col("structure_id")))
    a = a.withColumn("structure_label", F.when(F.col("l_suppkey") % 22 == 0, F.lit("")).when(F.col("l_suppkey") % 11 != 0, F.col("structure_label")))
    resolved, _ = G.resolve_orgs(org_structures(spark, sf), org_ref_statements(spark, sf))
    links = pg.affiliation_links(a, resolved.select("structure_id", "item_id"))
    return links.drop("pos")


# ---------------------------------------------------------------- J4

J4_SQL = f"""
WITH st AS ({PERSON_STMTS_SQL}),
co AS (SELECT DISTINCT o_custkey AS person_id, l_suppkey AS coauthor_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
known AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 0),
m AS (SELECT {fold_sql('value')} AS k, min(item_id) AS item_id FROM st WHERE property = 'dcterms:title' GROUP BY 1),
km AS (SELECT known.id, m.item_id FROM known LEFT JOIN m ON {fold_sql('known.c_name')} = m.k)
SELECT co.person_id, co.coauthor_id,
       CASE WHEN km.id IS NULL THEN 'unknown' WHEN km.item_id IS NOT NULL THEN 'linked' ELSE 'to_create' END AS status,
       km.item_id
FROM co LEFT JOIN km ON co.coauthor_id = km.id
"""


@register("J4_resolve_coauthors", J4_SQL)
def q_coauthors(spark, sf):
    """Co-contributors (suppliers as person ids) linked, to create, or unknown."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    co = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("person_id"), F.col("l_suppkey").alias("coauthor_id"))
    persons = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fullName"))
    return G.resolve_coauthors(co, persons, person_item_statements(spark, sf))


# ------------------------------------------------------------- J6 / P3


def new_person_statements(spark, sf):
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    k = ck.cast("string")
    return long_statements(c, ck * 10 + 1, [
        srow(G.TITLE, "literal", F.col("c_name")),
        srow(G.FAMILY_NAME, "literal", F.col("c_mktsegment")),
        srow(G.FAMILY_NAME, "literal", F.col("c_mktsegment"), when=ck % 11 == 0),
        srow(G.REFERENCED_BY, "uri", uri=F.concat(F.lit("https://orcid.org/"), k), label=F.concat(F.lit("orcid:"), k)),
        srow(G.IDENTIFIER, "literal", F.concat(F.lit("person:"), k), when=ck % 5 == 0),
    ])


NEW_STMTS_SQL = """
  SELECT c_custkey * 10 + 1 AS item_id, 'dcterms:title' AS property, 'literal' AS type, c_name AS value,
         NULL::VARCHAR AS uri, NULL::VARCHAR AS label FROM customer
  UNION ALL SELECT c_custkey * 10 + 1, 'foaf:familyName', 'literal', c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey * 10 + 1, 'foaf:familyName', 'literal', c_mktsegment, NULL, NULL FROM customer
    WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey * 10 + 1, 'dcterms:isReferencedBy', 'uri', NULL, 'https://orcid.org/' || c_custkey, 'orcid:' || c_custkey
    FROM customer
  UNION ALL SELECT c_custkey * 10 + 1, 'dcterms:identifier', 'literal', 'person:' || c_custkey, NULL, NULL FROM customer
    WHERE c_custkey % 5 = 0
"""
KEY_SQL = "CASE WHEN type = 'uri' THEN 'u:' || coalesce(uri, '') ELSE 'v:' || coalesce(value, '') END"

J6_REPLACE_SQL = f"""
WITH e AS ({PERSON_STMTS_SQL}), n AS ({NEW_STMTS_SQL})
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.item_id = e.item_id AND n.property = e.property)
UNION ALL SELECT * FROM n
"""
J6_APPEND_DISTINCT_SQL = f"""
WITH e AS ({PERSON_STMTS_SQL}), n AS ({NEW_STMTS_SQL}),
ek AS (SELECT DISTINCT item_id, property, {KEY_SQL} AS k FROM e)
SELECT * FROM e
UNION ALL SELECT DISTINCT n.* FROM n
WHERE NOT EXISTS (SELECT 1 FROM ek WHERE ek.item_id = n.item_id AND ek.property = n.property
                  AND ek.k = (CASE WHEN n.type = 'uri' THEN 'u:' || coalesce(n.uri, '') ELSE 'v:' || coalesce(n.value, '') END))
"""
J6_APPEND_SQL = f"WITH e AS ({PERSON_STMTS_SQL}), n AS ({NEW_STMTS_SQL}) SELECT * FROM e UNION ALL SELECT * FROM n"


def _merge(mode):
    def q(spark, sf):
        m = G.merge_statements(person_item_statements(spark, sf), new_person_statements(spark, sf), mode)
        return m.select(*STMT_OUT)

    q.__doc__ = f"Person item statements merged with new ones ({mode})."
    return q


register("J6_merge_replace", J6_REPLACE_SQL)(_merge("replace"))
register("J6_merge_append_distinct", J6_APPEND_DISTINCT_SQL)(_merge("append_distinct"))
register("J6_merge_append", J6_APPEND_SQL)(_merge("append"))


def laid_out(spark, statements, buckets: int):
    """Statements as a bucketed table of a name of its own."""
    name = f"statements_{uuid.uuid4().hex}"
    return layout.write_statements(statements, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}", buckets)


def _merge_laid_out(mode, buckets=16):
    def q(spark, sf):
        held = laid_out(spark, person_item_statements(spark, sf), buckets)
        return G.merge_statements(held, layout.deal(new_person_statements(spark, sf), buckets), mode).select(*STMT_OUT)

    q.__doc__ = f"The same merge ({mode}) with the stored statements in buckets of their item, read without an exchange."
    return q


register("J6_laid_out_replace", J6_REPLACE_SQL)(_merge_laid_out("replace"))
register("J6_laid_out_append_distinct", J6_APPEND_DISTINCT_SQL)(_merge_laid_out("append_distinct"))


def person_records(spark, sf):
    """Canonical persons of the (unique-id) person table."""
    d = canon.decode_person_table(person_table(spark, sf, repeat_ids=False))
    return d.select(F.col("row_id").cast("bigint").alias("id"), "person")


P3_SQL = f"""
WITH e AS ({PERSON_STMTS_SQL}), has AS (SELECT DISTINCT item_id, property FROM e),
c AS (SELECT c_custkey * 10 + 1 AS item_id, c_custkey, c_name, c_mktsegment FROM customer),
sc AS (SELECT item_id, 'dcterms:title' AS property, c_name AS value FROM c
       UNION ALL SELECT item_id, 'foaf:firstName', 'F' || c_custkey FROM c
       UNION ALL SELECT item_id, 'foaf:familyName', c_mktsegment FROM c
       UNION ALL SELECT item_id, 'dcterms:identifier', 'person:' || c_custkey FROM c WHERE c_custkey <> 0)
SELECT item_id, property, 'literal' AS type, value, NULL::VARCHAR AS uri, NULL::VARCHAR AS label FROM sc
WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.item_id = sc.item_id AND has.property = sc.property)
UNION ALL SELECT item_id, 'dcterms:isReferencedBy', 'uri', NULL, 'https://orcid.org/' || c_custkey,
                 'orcid:' || lpad(CAST(c_custkey AS VARCHAR), 16, '0') FROM c
"""


@register("P3_person_statements", P3_SQL)
def q_person_statements(spark, sf):
    """Statements of every decoded person for its item, only-if-absent for scalars."""
    recs = person_records(spark, sf).select((F.col("id") * 10 + 1).alias("item_id"), "person")
    return G.person_statements(recs, person_item_statements(spark, sf)).select(*STMT_OUT)


# --------------------------------------------------------------- J12

LINKS_SQL = """
  SELECT o_custkey AS person_id, l_partkey % 50 AS concept_id,
         CASE WHEN l_linenumber = 3 THEN 'other:prop' WHEN l_linenumber % 2 = 0 THEN 'dcterms:subject'
              ELSE 'foaf:topic_interest' END AS property, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
J12_SQL = f"""
WITH l AS ({LINKS_SQL}),
have AS (SELECT DISTINCT person_id, concept_id FROM l WHERE o_orderstatus = 'F' AND property IN ('dcterms:subject', 'foaf:topic_interest')),
req AS (SELECT DISTINCT person_id, concept_id FROM l WHERE o_orderstatus <> 'F')
SELECT req.person_id, req.concept_id,
       CASE WHEN have.person_id IS NULL THEN 'added' ELSE 'duplicate' END AS status
FROM req LEFT JOIN have USING (person_id, concept_id)
"""


@register("J12_link_keywords", J12_SQL)
def q_link_keywords(spark, sf):
    """Keyword links requested by open orders, added unless already linked by a keyword property."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ln = F.col("l_linenumber")
    prop = F.when(ln == 3, "other:prop").when(ln % 2 == 0, "dcterms:subject").otherwise("foaf:topic_interest")
    links = j.select(F.col("o_custkey").alias("person_id"), (F.col("l_partkey") % 50).alias("concept_id"),
                     prop.alias("property"), "o_orderstatus")
    have = links.where(F.col("o_orderstatus") == "F")
    req = links.where(F.col("o_orderstatus") != "F")
    return G.link_keywords(have, req, ["dcterms:subject", "foaf:topic_interest"])


# --------------------------------------------------------------- J14

J14_SQL = f"""
SELECT DISTINCT o_custkey * 10 + 1 AS item_id FROM orders
WHERE o_custkey * 10 + 1 NOT IN (SELECT item_id FROM ({PERSON_ITEMS_SQL}))
"""


@register("J14_missing_ids", J14_SQL)
def q_missing_ids(spark, sf):
    """Person item ids requested by orders that do not exist."""
    req = table(spark, sf, "orders").select((F.col("o_custkey") * 10 + 1).alias("item_id"))
    return G.missing_ids(req, person_items(spark, sf))
