"""A batch of person and organisation items merged whole.

Bindings: the graph holds the person items of ``q_graph`` (key*10+1 and
key*10+2), strangers that no person is called like (key*10+3), organisation
items of suppliers (key*10+4, the reference of every fourth one a register
number) and concept items of parts (key*10+5). Asked for are the items of
ordering customers, some of which do not exist, and of delivering suppliers.
Customers are the persons: domains, affiliations and publications come from
their order lines, co-authors from the parts of those lines (part key = customer
key, the keys beyond are unknown persons).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.operators import batch as B
from scholargraph.operators import graph as G
from scholargraph.operators import search as S
from scholargraph.plans import q_graph as qg
from scholargraph.plans import q_persons as qp
from scholargraph.plans.q_ingest import P4_SQL, register_rows
from scholargraph.plans.q_search import prefix_sql
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import fold_sql
from scholargraph.session import cut_lineage


def items(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    key = F.col("c_custkey")
    strangers = c.where(key % 11 == 0).select(
        (key * 10 + 3).alias("item_id"), F.concat(F.lit("Nobody "), key.cast("string")).alias("title"), F.lit(None).cast("string").alias("class")
    )
    orgs = s.select((F.col("s_suppkey") * 10 + 4).alias("item_id"), F.col("s_name").alias("title"), F.lit(B.ORG_CLASS).alias("class"))
    return qg.person_items(spark, sf).drop("c_custkey").unionByName(strangers).unionByName(orgs)


def requested(spark, sf):
    ids = table(spark, sf, "orders").select(F.explode(F.array(*[F.col("o_custkey") * 10 + i for i in (1, 2, 3)])).alias("item_id"))
    return ids.unionByName(table(spark, sf, "lineitem").select((F.col("l_suppkey") * 10 + 4).alias("item_id")))


def graph_statements(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    key, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    half = F.floor(key / 2).cast("string")
    ref = F.when(key % 4 == 0, F.concat(F.lit("S"), half, F.lit(" "))).otherwise(F.concat(F.lit("S"), text, F.lit("-"), F.col("s_nationkey").cast("string")))
    orgs = qg.long_statements(s, key * 10 + 4, [
        qg.srow(G.REFERENCED_BY, "literal", ref, when=key % 8 != 7),
        qg.srow("dcterms:created", "literal", (F.col("s_nationkey") + 1950).cast("string")),
    ])
    part, brand = F.col("p_partkey"), F.col("p_brand")
    concepts = qg.long_statements(p.where(part % 5 == 0), part * 10 + 5, [
        qg.srow(G.REFERENCED_BY, "uri", uri=F.concat(F.lit(G.WIKIDATA_URL), brand), label=F.lit("wikidata"), when=(part % 3 == 0) & (F.col("p_size") % 4 != 0)),
        qg.srow(G.REFERENCED_BY, "literal", F.concat(F.lit("keyword_"), brand), when=(part % 3 == 1) & (F.col("p_size") % 4 != 0)),
        qg.srow(G.PREF_LABEL, "literal", F.col("p_type"), when=part % 3 == 2),
    ])
    return qg.person_item_statements(spark, sf).unionByName(orgs).unionByName(concepts)


def persons(spark, sf):
    size = table(spark, sf, "part").select("p_partkey", "p_size")
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("wikidata")).when(F.col("p_size") % 3 == 1, F.lit("keyword"))
    lines = cut_lineage(qp.order_lines(spark, sf), "order-lines")  # read by every list of a person
    domains = qp.domain_entries(spark, sf, lines).drop("type").join(size, F.col("pos.l_partkey") == F.col("p_partkey")).withColumn("type", kind)
    affiliations = qp.affiliation_entries(spark, sf, lines)
    key = F.col("l_suppkey")
    affiliations = affiliations.withColumns({
        "structure_id": F.when(key % 9 == 0, F.concat(F.lit("ED"), key.cast("string"))).otherwise(F.col("structure_id")),
        "structure_label": F.when(key % 11 != 0, F.col("structure_label")),
        "kinds": F.when(key % 2 == 0, F.array(F.lit("university"))).otherwise(F.array().cast("array<string>")),
    })
    return B.PersonTables(
        qg.person_records(spark, sf),
        domains.select("person_id", "pos", "label", "code", "type", "count"),
        lines.select(F.col("o_custkey").alias("person_id"), F.col("l_partkey").alias("coauthor_id")),
        affiliations,
        qp.publication_entries(spark, sf, lines),
    )


def merged(spark, sf) -> B.Merge:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return B.merge_batch(requested(spark, sf), items(spark, sf), graph_statements(spark, sf), names, persons(spark, sf), register_rows(spark, sf), S.search_auto)


NULLS = "NULL::VARCHAR AS uri, NULL::VARCHAR AS label"
CORE_SQL = f"""
items AS (
  SELECT item_id, title, 'foaf:Person' AS class FROM ({qg.PERSON_ITEMS_SQL})
  UNION ALL SELECT c_custkey * 10 + 3, 'Nobody ' || c_custkey, NULL FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT s_suppkey * 10 + 4, s_name, 'foaf:Organization' FROM supplier),
req AS (SELECT DISTINCT o_custkey * 10 + i AS item_id FROM orders, (VALUES (1), (2), (3)) AS v(i)
        UNION SELECT l_suppkey * 10 + 4 FROM lineitem),
batch AS (SELECT * FROM items WHERE item_id IN (SELECT item_id FROM req)),
others AS (SELECT * FROM batch WHERE class IS DISTINCT FROM 'foaf:Organization'),
orgs AS (SELECT * FROM batch WHERE class = 'foaf:Organization'),
st AS (
  SELECT item_id, property, type, value, uri, label FROM ({qg.PERSON_STMTS_SQL})
  UNION ALL SELECT s_suppkey * 10 + 4, 'dcterms:isReferencedBy', 'literal',
         CASE WHEN s_suppkey % 4 = 0 THEN 'S' || (s_suppkey // 2) || ' ' ELSE 'S' || s_suppkey || '-' || s_nationkey END, NULL, NULL
    FROM supplier WHERE s_suppkey % 8 <> 7
  UNION ALL SELECT s_suppkey * 10 + 4, 'dcterms:created', 'literal', CAST(s_nationkey + 1950 AS VARCHAR), NULL, NULL FROM supplier
  UNION ALL SELECT p_partkey * 10 + 5, 'dcterms:isReferencedBy', 'uri', NULL, '{G.WIKIDATA_URL}' || p_brand, 'wikidata'
    FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 0 AND p_size % 4 <> 0
  UNION ALL SELECT p_partkey * 10 + 5, 'dcterms:isReferencedBy', 'literal', 'keyword_' || p_brand, NULL, NULL
    FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 1 AND p_size % 4 <> 0
  UNION ALL SELECT p_partkey * 10 + 5, 'skos:prefLabel', 'literal', p_type, NULL, NULL FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 2),
hits AS {prefix_sql("SELECT item_id AS query_id, title AS text FROM others", "SELECT c_custkey AS id, c_name AS name FROM customer", 1)},
h AS (SELECT query_id AS item_id, id AS person_id FROM hits),
co AS (SELECT DISTINCT o_custkey AS person_id, l_partkey AS coauthor_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON c_custkey = l_partkey WHERE o_custkey IN (SELECT person_id FROM h)),
named AS (SELECT {fold_sql('value')} AS k, min(item_id) AS item_id FROM st WHERE property = 'dcterms:title' GROUP BY 1),
settled AS (SELECT co.*, coalesce(n.item_id, {qg._hash_sql("'person' || chr(1) || 'name:' || " + fold_sql('c_name'))}) AS target, n.item_id IS NULL AS made
            FROM co JOIN customer ON c_custkey = coauthor_id LEFT JOIN named n ON n.k = {fold_sql('c_name')}),
people AS (SELECT * FROM h UNION ALL SELECT DISTINCT target, coauthor_id FROM settled WHERE made),
d AS (SELECT d.*, CASE p.p_size % 3 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'keyword' END AS type
      FROM ({qp.DOMAINS_SQL}) d JOIN part p ON p.p_partkey = d.pos.l_partkey WHERE label IS NOT NULL AND person_id IN (SELECT person_id FROM h)),
ds AS (SELECT person_id, lower(label) AS k, CAST(sum(cnt) AS BIGINT) AS count, arg_min({{'l': label, 't': type}}, pos) AS f,
              arg_max(code, pos) FILTER (WHERE code IS NOT NULL) AS code FROM d GROUP BY 1, 2),
tags AS (SELECT person_id, count, f.l AS label, f.t AS type, code,
                CASE WHEN f.t = 'wikidata' THEN 'uri' WHEN code IS NOT NULL AND f.t IS NOT NULL THEN 'value' ELSE 'label' END AS kind,
                CASE WHEN f.t = 'wikidata' THEN '{G.WIKIDATA_URL}' || code
                     WHEN code IS NOT NULL AND f.t IS NOT NULL THEN f.t || '_' || code ELSE f.l END AS key FROM ds),
keys AS (SELECT kind, key, arg_min({{'label': label, 'code': code, 'type': type}}, (label, coalesce(code, ''), coalesce(type, ''))) AS t
         FROM tags WHERE key IS NOT NULL GROUP BY 1, 2),
stk AS (SELECT 'uri' AS kind, uri AS key, item_id FROM st WHERE property = 'dcterms:isReferencedBy' AND uri IS NOT NULL
        UNION ALL SELECT 'value', value, item_id FROM st WHERE property = 'dcterms:isReferencedBy' AND value IS NOT NULL
        UNION ALL SELECT 'label', value, item_id FROM st WHERE property = 'skos:prefLabel'),
cf AS (SELECT kind, key, min(item_id) AS found FROM stk GROUP BY 1, 2),
concepts AS (SELECT keys.*, found IS NULL AS made, coalesce(found, {qg._hash_sql("keys.kind || chr(1) || keys.key")}) AS item_id
             FROM keys LEFT JOIN cf USING (kind, key)),
dl AS (SELECT h.item_id, c.item_id AS target, tags.count FROM h JOIN tags USING (person_id) JOIN concepts c USING (kind, key)),
a AS (SELECT o.o_custkey AS person_id, {qg.STRUCTURE_ID_SQL} AS structure_id, any_value(s_name) AS label,
             CASE WHEN s_suppkey % 2 = 0 THEN 'university' END AS kind0, count(*) AS n,
             strftime(min(l_shipdate), '%Y-%m-%d') AS start_date, strftime(max(l_shipdate), '%Y-%m-%d') AS end_date
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier ON l.l_suppkey = s_suppkey
      WHERE s_suppkey % 11 <> 0 AND o.o_custkey IN (SELECT person_id FROM people) GROUP BY o.o_custkey, s_suppkey),
sid AS (SELECT structure_id, min(label) AS label, any_value(kind0) AS kind0 FROM a GROUP BY 1),
ofound AS (SELECT sid.structure_id, min(st.item_id) AS found FROM sid JOIN st
           ON st.property = 'dcterms:isReferencedBy' AND starts_with(st.value, sid.structure_id) GROUP BY 1),
ro AS (SELECT sid.*, found IS NULL AS made, coalesce(found, {qg._hash_sql("'org' || chr(1) || sid.structure_id")}) AS item_id,
              CASE WHEN starts_with(structure_id, 'ED') THEN 'Ecole doctorale' ELSE coalesce(kind0, 'no') END AS org_type
       FROM sid LEFT JOIN ofound USING (structure_id)),
al AS (SELECT p.item_id, ro.item_id AS target, n, start_date, end_date FROM people p JOIN a USING (person_id) JOIN ro USING (structure_id)),
pe AS ({qp.PUBS_SQL}), pt AS (SELECT * FROM pe WHERE title IS NOT NULL AND person_id IN (SELECT person_id FROM h)),
pf AS (SELECT h.item_id, publication, arg_min(title, pos) AS title, arg_min(year, pos) AS year FROM pt JOIN h USING (person_id) GROUP BY 1, 2),
pr AS (SELECT DISTINCT h.item_id, publication, role FROM pt JOIN h USING (person_id)),
own AS (SELECT * FROM st WHERE item_id IN (SELECT item_id FROM others)),
has AS (SELECT DISTINCT item_id, property FROM own),
pp AS (SELECT p.item_id, c.* FROM people p JOIN customer c ON c.c_custkey = p.person_id),
sc AS (SELECT item_id, 'dcterms:title' AS property, c_name AS value FROM pp
       UNION ALL SELECT item_id, 'foaf:firstName', 'F' || c_custkey FROM pp
       UNION ALL SELECT item_id, 'foaf:familyName', c_mktsegment FROM pp
       UNION ALL SELECT item_id, 'dcterms:identifier', 'person:' || c_custkey FROM pp WHERE c_custkey <> 0),
new AS (
  SELECT item_id, property, 'literal' AS type, value, {NULLS}, NULL::BIGINT AS target_id FROM sc
  WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.item_id = sc.item_id AND has.property = sc.property)
  UNION ALL SELECT item_id, 'dcterms:isReferencedBy', 'uri', NULL, 'https://orcid.org/' || c_custkey,
                   'orcid:' || lpad(CAST(c_custkey AS VARCHAR), 16, '0'), NULL FROM pp
  UNION ALL SELECT item_id, '{B.HAS_CONCEPT}', 'resource', NULL, NULL, NULL, target FROM dl
  UNION ALL SELECT h.item_id, '{B.CONTRIBUTORS}', 'resource', NULL, NULL, NULL, target FROM h JOIN settled USING (person_id)
  UNION ALL SELECT item_id, '{B.HAS_STRUCTURE}', 'resource', NULL, NULL, NULL, target FROM al
  UNION ALL SELECT item_id, '{B.PUBLICATIONS}', 'literal', title, NULL, NULL, NULL FROM pf),
refs AS (SELECT item_id, min(trim(value)) AS k FROM st WHERE property = 'dcterms:isReferencedBy' AND value IS NOT NULL
         AND item_id IN (SELECT item_id FROM orgs) GROUP BY 1),
reg AS ({P4_SQL}),
upd AS (SELECT refs.item_id, reg.property, reg.type, CASE WHEN reg.type <> 'uri' THEN reg.value END AS value,
               CASE WHEN reg.type = 'uri' THEN reg.value END AS uri, NULL::VARCHAR AS label
        FROM refs JOIN reg ON reg.numero_national_de_structure = refs.k),
oo AS (SELECT * FROM st WHERE item_id IN (SELECT item_id FROM upd))
"""
J7_SQL = f"""
WITH {CORE_SQL}
SELECT *, NULL::BIGINT AS target_id FROM own WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.item_id = own.item_id AND new.property = own.property)
UNION ALL SELECT * FROM new
UNION ALL SELECT item_id, property, 'literal', t.label, NULL, NULL, NULL FROM concepts, (VALUES ('dcterms:title'), ('skos:prefLabel')) AS v(property) WHERE made
UNION ALL SELECT item_id, 'dcterms:isReferencedBy', 'uri', NULL, '{G.WIKIDATA_URL}' || t.code, 'wikidata', NULL FROM concepts WHERE made AND t.type = 'wikidata'
UNION ALL SELECT item_id, 'dcterms:isReferencedBy', 'literal', t.type || '_' || t.code, NULL, NULL, NULL
  FROM concepts WHERE made AND t.type IS NOT NULL AND t.code IS NOT NULL
UNION ALL SELECT item_id, 'dcterms:title', 'literal', label, NULL, NULL, NULL FROM ro WHERE made
UNION ALL SELECT item_id, 'dcterms:type', 'literal', org_type, NULL, NULL, NULL FROM ro WHERE made
UNION ALL SELECT item_id, 'dcterms:isReferencedBy', 'literal', structure_id, NULL, NULL, NULL FROM ro WHERE made
UNION ALL SELECT *, NULL FROM oo
UNION ALL SELECT DISTINCT u.*, NULL FROM upd u WHERE NOT EXISTS (
  SELECT 1 FROM oo WHERE oo.item_id = u.item_id AND oo.property = u.property AND oo.type = u.type
    AND coalesce(oo.value, '') = coalesce(u.value, '') AND coalesce(oo.uri, '') = coalesce(u.uri, ''))
"""
J7_BESIDE_SQL = f"""
WITH {CORE_SQL}
SELECT 'missing' AS part, item_id, NULL::VARCHAR AS property, NULL::BIGINT AS target_id, NULL::VARCHAR AS value, NULL::VARCHAR AS name, NULL::VARCHAR AS annotation
FROM req WHERE item_id NOT IN (SELECT item_id FROM items)
UNION ALL SELECT 'status', item_id, NULL, NULL, CASE WHEN item_id IN (SELECT item_id FROM h) THEN 'updated' ELSE 'skipped' END, 'person', NULL FROM others
UNION ALL SELECT 'status', item_id, NULL, NULL, CASE WHEN item_id IN (SELECT item_id FROM upd) THEN 'updated' ELSE 'skipped' END, 'structure', NULL FROM orgs
UNION ALL SELECT 'created', item_id, NULL, NULL, NULL, '{B.CONCEPT_CLASS}', NULL FROM concepts WHERE made
UNION ALL SELECT 'created', item_id, NULL, NULL, NULL, '{B.ORG_CLASS}', NULL FROM ro WHERE made
UNION ALL SELECT DISTINCT 'created', target, NULL, NULL::BIGINT, NULL, '{B.PERSON_CLASS}', NULL FROM settled WHERE made
UNION ALL SELECT 'annotation', item_id, '{B.HAS_CONCEPT}', target, NULL, '{B.RANK}', CAST(count AS VARCHAR) FROM dl
UNION ALL SELECT 'annotation', item_id, '{B.HAS_STRUCTURE}', target, NULL, name, v FROM (
  SELECT item_id, target, unnest(['{B.RANK}', '{B.START}', '{B.END}']) AS name, unnest([CAST(n AS VARCHAR), start_date, end_date]) AS v FROM al)
UNION ALL SELECT 'annotation', item_id, '{B.PUBLICATIONS}', NULL, title, '{B.DATE}', year FROM pf
UNION ALL SELECT 'annotation', item_id, '{B.PUBLICATIONS}', NULL, title, '{G.REFERENCED_BY}', CAST(publication AS VARCHAR) FROM pf
UNION ALL SELECT 'annotation', item_id, '{B.PUBLICATIONS}', NULL, title, '{B.STATUS}', role FROM pr JOIN pf USING (item_id, publication)
"""


@register("J7_merge_batch", J7_SQL)
def q_merge_batch(spark, sf):
    """All statements after the merge of the batch, created and refreshed items included."""
    return merged(spark, sf).statements.select(*qg.STMT_OUT, "target_id")


@register("J7_merge_batch_beside", J7_BESIDE_SQL)
def q_merge_batch_beside(spark, sf):
    """What the merge gives beside the statements: annotations, created items, the status of every item, missing ids."""
    m = merged(spark, sf)
    cols = {"part": "string", "item_id": "bigint", "property": "string", "target_id": "bigint", "value": "string", "name": "string", "annotation": "string"}
    rows = [
        m.missing.withColumn("part", F.lit("missing")),
        m.status.select(F.lit("status").alias("part"), "item_id", F.col("status").alias("value"), F.col("route").alias("name")),
        m.created.select(F.lit("created").alias("part"), "item_id", F.col("class").alias("name")),
        m.annotations.withColumn("part", F.lit("annotation")),
    ]
    out = None
    for df in rows:
        df = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])
        out = df if out is None else out.unionByName(df)
    return out
