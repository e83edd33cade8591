"""Queries for ingest: dumps, upserts, register, person tables, dimensions.

Bindings: events become JSON lines of a person dump (see ``dump_lines``:
blank, whitespace-only, non-object, empty/zero/missing ids, long names,
every id ending in 7 cut in half); events keyed by user before and after
a cutoff are a table and its update batch; supplier x nation is the
structure register; customers are the person table (JSON column, both
spellings of top domains, search envelope, repeated ids); pages and labels
are registry documents; part brands are a dimension.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholargraph import schemas
from scholargraph.operators import canon, graph, lookup, upsert
from scholargraph.plans.registry import register, table
from scholargraph.session import ensure_checkpoint_dir
from scholargraph.sources import jsonl
from scholargraph.sources import register as reg
from scholargraph.streaming.buckets import BucketTable

CUTOFF = "2024-01-20 00:00:00"

# ------------------------------------------------------------- dump lines


def dump_lines(spark, sf):
    """Events as JSON lines: blank, whitespace, '5', empty/zero/missing ids,
    long names, and every id ending in 7 cut in half (undecodable)."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    eid = F.col("event_id")
    idt = (
        F.when(eid % 100 == 21, F.lit(""))
        .when(eid % 100 == 31, F.lit("0"))
        .otherwise(F.floor(eid / 3).cast("bigint").cast("string"))
    )
    name = F.when(eid % 100 == 42, F.repeat(F.lit("Name"), 150)).otherwise(F.concat(F.lit("User "), F.col("user_id").cast("string")))
    tail = F.concat(F.lit('"fullName": "'), name, F.lit('", "kind": "'), F.col("event_type"), F.lit('", "k": '), k, F.lit("}"))
    js = F.when(eid % 100 == 61, F.concat(F.lit("{"), tail)).otherwise(F.concat(F.lit('{"id": "'), idt, F.lit('", '), tail))
    e = e.select(eid, js.alias("js"))
    line = (
        F.when(eid % 50 == 13, F.lit(""))
        .when(eid % 50 == 23, F.lit(" \t "))
        .when(eid % 100 == 55, F.lit("5"))
        .when(eid % 10 == 7, F.expr("substring(js, 1, length(js) div 2)"))
        .otherwise(F.col("js"))
    )
    return e.select(line.alias("value"), eid.alias("seq"))


LINES_SQL = """
  WITH b AS (
    SELECT event_id, event_type, json_extract_string(props, '$.k') AS k,
           CASE WHEN event_id % 100 = 21 THEN '' WHEN event_id % 100 = 31 THEN '0'
                ELSE CAST(event_id // 3 AS VARCHAR) END AS idt,
           CASE WHEN event_id % 100 = 42 THEN repeat('Name', 150) ELSE 'User ' || user_id END AS nm
    FROM events),
  j AS (
    SELECT event_id,
           CASE WHEN event_id % 100 = 61 THEN '{' ELSE '{"id": "' || idt || '", ' END
           || '"fullName": "' || nm || '", "kind": "' || event_type || '", "k": ' || k || '}' AS js
    FROM b)
  SELECT event_id AS seq,
         CASE WHEN event_id % 50 = 13 THEN '' WHEN event_id % 50 = 23 THEN ' ' || chr(9) || ' '
              WHEN event_id % 100 = 55 THEN '5'
              WHEN event_id % 10 = 7 THEN substr(js, 1, length(js) // 2) ELSE js END AS value
  FROM j
"""
TRIM_SQL = "trim(value, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"

S1_SQL = f"""
WITH l AS ({LINES_SQL}), t AS (SELECT seq, {TRIM_SQL} AS line FROM l)
SELECT seq, json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.fullName') AS fullName
FROM t WHERE line <> '' AND json_valid(line)
"""


@register("S1_scan_jsonl", S1_SQL)
def q_scan_jsonl(spark, sf):
    """Decodable dump lines with their id and name."""
    s = jsonl.scan_jsonl(dump_lines(spark, sf))
    return s.select("seq", F.col("rec.id").alias("id"), F.col("rec.fullName").alias("fullName"))


S2_SQL = f"""
WITH l AS ({LINES_SQL}), t AS (SELECT seq, {TRIM_SQL} AS line FROM l),
v AS (SELECT seq, json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.fullName') AS fn
      FROM t WHERE line <> '' AND json_valid(line))
SELECT seq, id, substr(fn, 1, 512) AS fullName FROM v WHERE id IS NOT NULL AND id NOT IN ('', '0')
"""


@register("S2_import_persons", S2_SQL)
def q_import_persons(spark, sf):
    """Valid person rows of the dump (rejects go to a side output)."""
    valid, _ = jsonl.import_persons(dump_lines(spark, sf))
    return valid.select("seq", "id", "fullName")


# ---------------------------------------------------------------- upserts


def keyed_events(spark, sf, before: bool):
    e = table(spark, sf, "events")
    cond = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    e = e.where(cond if before else ~cond)
    return e.select(
        F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("kind"), "value",
        F.struct("ts", "event_id").alias("seq"),
    )


def _latest_sql(where: str) -> str:
    return f"""SELECT id, event_id, kind, value FROM (
      SELECT user_id AS id, event_id, event_type AS kind, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE {where}) WHERE rn = 1"""


S3_SQL = f"""
WITH t AS ({_latest_sql(f"ts < TIMESTAMP '{CUTOFF}'")}),
b AS ({_latest_sql(f"ts >= TIMESTAMP '{CUTOFF}'")})
SELECT * FROM t WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b
"""


@register("S3_upsert_by_key", S3_SQL)
def q_upsert_by_key(spark, sf):
    """Per user, the table before the cutoff upserted with the later events."""
    target = upsert.latest_per_key(keyed_events(spark, sf, True), ["id"], "seq").drop("seq")
    batch = keyed_events(spark, sf, False)
    return upsert.upsert_by_key(target, batch, ["id"], "seq")


@register("S3_bucketed_upsert", S3_SQL)
def q_bucketed_upsert(spark, sf):
    """The same upsert on a bucketed table: begun with the earlier events, changed
    by the later ones in two batches, each rewriting the buckets it touches."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/user-events-{uuid.uuid4().hex}"
    store = BucketTable(spark, path, "id bigint, event_id bigint, kind string, value double", ["id"], 16)
    store.upsert(keyed_events(spark, sf, True))
    later = keyed_events(spark, sf, False)
    middle = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    store.upsert(later.where(F.col("seq.ts") < middle), batch=("events", 0))
    store.upsert(later.where(F.col("seq.ts") >= middle), batch=("events", 1))
    return store.read()


def event_points(spark, sf, before: bool):
    e = table(spark, sf, "events")
    cond = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    e = e.where(cond if before else ~cond)
    zero = F.col("event_id") % 13 == 0
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("item_id"),
        F.when(zero, F.lit(0.0)).otherwise(F.col("value") % 90).alias("lat"),
        F.when(zero, F.lit(0.0)).otherwise(k - 50).alias("lng"),
        F.struct("ts", "event_id").alias("seq"),
    )


def _points_sql(where: str) -> str:
    return f"""SELECT item_id, lat, lng FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS rn FROM (
        SELECT user_id AS item_id, ts, event_id,
               CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE value % 90 END AS lat,
               CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 END AS lng
        FROM events WHERE {where}) WHERE NOT (lat = 0 AND lng = 0)) WHERE rn = 1"""


J10_SQL = f"""
WITH t AS ({_points_sql(f"ts < TIMESTAMP '{CUTOFF}'")}),
b AS ({_points_sql(f"ts >= TIMESTAMP '{CUTOFF}'")})
SELECT * FROM t WHERE item_id NOT IN (SELECT item_id FROM b) UNION ALL SELECT * FROM b
"""


@register("J10_upsert_features", J10_SQL)
def q_upsert_features(spark, sf):
    """One point per user: earlier points upserted with later ones, (0,0) rejected."""
    before = event_points(spark, sf, True)
    before = before.where(~((F.col("lat") == 0) & (F.col("lng") == 0)))
    target = upsert.latest_per_key(before, ["item_id"], "seq").drop("seq")
    return upsert.upsert_features(target, event_points(spark, sf, False), "seq")


# ---------------------------------------------------------------- register


def register_rows(spark, sf):
    """The structure register: suppliers with their nation as address.
    Keys repeat (two suppliers per key); some are empty or null."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    sk = F.col("s_suppkey")
    key = (
        F.when(sk % 10 == 9, F.lit(""))
        .when(sk % 10 == 8, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("S"), F.floor(sk / 2).cast("bigint").cast("string")))
    )
    return j.select(
        key.alias(reg.KEY),
        F.col("s_name").alias("libelle"),
        F.when(sk % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" SG"), sk.cast("string"), F.lit(" "))).alias("sigle"),
        (F.lit(1950) + F.col("n_nationkey")).cast("string").alias("annee_de_creation"),
        F.when(sk % 5 == 0, F.lit(None).cast("string"))
        .when(sk % 5 == 1, F.lit('["https://a.example.org", "https://b.example.org"]'))
        .otherwise(F.concat(F.lit("https://s"), sk.cast("string"), F.lit(".example.org"))).alias("site_web"),
        F.concat(sk.cast("string"), F.lit(" rue "), F.col("n_name")).alias("adresse"),
        F.lpad((F.col("n_nationkey") * 1000).cast("string"), 5, "0").alias("code_postal"),
        F.col("n_name").alias("commune"),
        sk.alias("pos"),
    )


REGISTER_SQL = """
  SELECT CASE WHEN s_suppkey % 10 = 9 THEN '' WHEN s_suppkey % 10 = 8 THEN NULL
              ELSE 'S' || (s_suppkey // 2) END AS numero_national_de_structure,
         s_name AS libelle,
         CASE WHEN s_suppkey % 7 = 0 THEN '   ' ELSE ' SG' || s_suppkey || ' ' END AS sigle,
         CAST(1950 + n_nationkey AS VARCHAR) AS annee_de_creation,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL
              WHEN s_suppkey % 5 = 1 THEN '["https://a.example.org", "https://b.example.org"]'
              ELSE 'https://s' || s_suppkey || '.example.org' END AS site_web,
         s_suppkey || ' rue ' || n_name AS adresse,
         lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0') AS code_postal,
         n_name AS commune, s_suppkey AS pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
REGISTER_LATEST_SQL = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY numero_national_de_structure ORDER BY pos DESC) AS rn
    FROM ({REGISTER_SQL}) WHERE numero_national_de_structure IS NOT NULL AND numero_national_de_structure <> '')
  WHERE rn = 1
"""


@register("S4_scan_register", REGISTER_LATEST_SQL)
def q_scan_register(spark, sf):
    """The register with the last record of each key."""
    return reg.scan_register(register_rows(spark, sf))


P4_SQL = f"""
WITH r AS ({REGISTER_LATEST_SQL}),
l AS (
  SELECT numero_national_de_structure, 'foaf:surname' AS property, 'literal' AS type, sigle AS raw FROM r
  UNION ALL SELECT numero_national_de_structure, 'dcterms:created', 'literal', annee_de_creation FROM r
  UNION ALL SELECT numero_national_de_structure, 'foaf:workplaceHomepage', 'uri', site_web FROM r
  UNION ALL SELECT numero_national_de_structure, 'schema:address', 'literal', adresse FROM r
  UNION ALL SELECT numero_national_de_structure, 'schema:postalCode', 'literal', code_postal FROM r
  UNION ALL SELECT numero_national_de_structure, 'schema:addressLocality', 'literal', commune FROM r)
SELECT numero_national_de_structure, property, type, {TRIM_SQL.replace('value', 'raw')} AS value
FROM l WHERE raw IS NOT NULL AND raw <> '' AND NOT (starts_with(trim(raw), '[') AND json_valid(raw))
  AND {TRIM_SQL.replace('value', 'raw')} <> ''
"""


@register("P4_register_statements", P4_SQL)
def q_register_statements(spark, sf):
    """Typed statements from the latest register records."""
    return reg.register_statements(reg.scan_register(register_rows(spark, sf)))


# ---------------------------------------------------------- person table


def person_table(spark, sf, repeat_ids: bool = True):
    """Customers as a person table: id, full name and the JSON record.
    Even keys spell ``topDomains``, odd ``top_domains``; keys ending in 3
    come in a search envelope; keys ending in 49 repeat the previous id."""
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    s = lambda x: x.cast("string")
    base = F.concat(
        F.lit('{"id": "'), s(ck), F.lit('", "firstName": "F'), s(ck), F.lit('", "lastName": "'), F.col("c_mktsegment"),
        F.lit('", "fullName": "'), F.col("c_name"), F.lit('", "'),
        F.when(ck % 2 == 0, F.lit("topDomains")).otherwise(F.lit("top_domains")),
        F.lit('": [{"label": {"default": "'), F.col("c_mktsegment"), F.lit('"}, "code": "N'), s(F.col("c_nationkey")),
        F.lit('", "type": "nation", "count": '), s(ck % 7 + 1),
        F.lit('}, {"label": {"default": "R'), s(F.col("c_nationkey") % 5), F.lit('"}, "type": "region", "count": 1}], '),
        F.lit('"externalIds": [{"type": "orcid", "id": "'), F.lpad(s(ck), 16, "0"), F.lit('", "url": "https://orcid.org/'), s(ck),
        F.lit('"}], "publicationsCount": '), s(ck % 13), F.lit("}"),
    )
    data = F.when(ck % 10 == 3, F.concat(F.lit('{"_source": '), base, F.lit(', "_score": '), s(ck % 10), F.lit(".5}"))).otherwise(base)
    rid = F.when((ck % 50 == 49) & F.lit(repeat_ids), s(ck - 1)).otherwise(s(ck))
    return c.select(rid.alias("id"), F.col("c_name").alias("fullName"), data.alias("data"))


S5_SQL = """
WITH c AS (
  SELECT c_custkey, c_name, c_mktsegment, c_nationkey,
         CASE WHEN c_custkey % 50 = 49 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS row_id
  FROM customer)
SELECT row_id, CAST(c_custkey AS VARCHAR) AS id,
       CASE WHEN c_custkey % 10 = 3 THEN CAST(c_custkey % 10 AS DOUBLE) + 0.5 ELSE 0.0 END AS score,
       'F' || c_custkey AS firstName, c_mktsegment AS lastName, c_name AS fullName,
       CAST(2 AS BIGINT) AS n_top_domains, c_mktsegment AS top_label, 'N' || c_nationkey AS top_code,
       CAST(1 AS BIGINT) AS n_external_ids, 'https://orcid.org/' || c_custkey AS external_url,
       CAST(0 AS BIGINT) AS n_publications, CAST(0 AS BIGINT) AS n_domains
FROM c
"""


@register("S5_decode_person_table", S5_SQL)
def q_decode_person_table(spark, sf):
    """Person table rows decoded into canonical persons (P1), flattened."""
    d = canon.decode_person_table(person_table(spark, sf))
    p = F.col("person")
    return d.select(
        "row_id", p["id"].alias("id"), p["score"].alias("score"), p["firstName"].alias("firstName"),
        p["lastName"].alias("lastName"), p["fullName"].alias("fullName"),
        F.size(p["top_domains"]).alias("n_top_domains"),
        F.get(p["top_domains"], 0)["label"]["default"].alias("top_label"),
        F.get(p["top_domains"], 0)["code"].alias("top_code"),
        F.size(p["externalIds"]).alias("n_external_ids"),
        F.get(p["externalIds"], 0)["url"].alias("external_url"),
        F.size(p["publications"]).alias("n_publications"),
        F.size(p["domains"]).alias("n_domains"),
    )


F8_SQL = """
WITH t AS (
  SELECT CASE WHEN c_custkey % 50 = 49 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS id,
         c_name AS fullName FROM customer),
req AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders
        UNION SELECT CAST(o_custkey + 2000000 AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'),
h AS (SELECT id, count(*) AS n, max(fullName) AS fn FROM t GROUP BY id)
SELECT req.id, CASE WHEN h.n IS NULL THEN 'missing' WHEN h.n = 1 THEN 'found' ELSE 'ambiguous' END AS status,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n_matches, CASE WHEN h.n = 1 THEN h.fn END AS fullName
FROM req LEFT JOIN h USING (id)
"""


@register("F8_lookup_by_id", F8_SQL)
def q_lookup_by_id(spark, sf):
    """Batch lookup of the ordering customers' ids, plus ids that do not exist."""
    o = table(spark, sf, "orders")
    req = o.select(F.col("o_custkey").cast("string").alias("id")).unionByName(
        o.where(F.col("o_orderstatus") == "P").select((F.col("o_custkey") + 2000000).cast("string").alias("id"))
    )
    return lookup.lookup_by_id(person_table(spark, sf), req)


# ------------------------------------------------------ registry documents


def registry_docs(spark, sf):
    """Registry documents built from pages (url as external id) and labels
    (keywords); some lack a family name, a URL or keywords."""
    p = table(spark, sf, "pages").select("page_id", "url")
    lb = table(spark, sf, "labels")
    j = p.join(lb, p.page_id == lb.doc_id, "left")
    pid = F.col("page_id")
    s = lambda x: x.cast("string")
    doc = F.concat(
        F.lit('{"name": {"given-names": {"value": "G'), s(pid), F.lit('"}'),
        F.when(pid % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(', "family-name": {"value": "Fam'), s(pid), F.lit('"}'))),
        F.lit('}, "external-identifiers": {"external-identifier": [{"external-id-type": "url", "external-id-value": "'),
        F.col("url"), F.lit('"'),
        F.when(pid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "external-id-url": {"value": "'), F.col("url"), F.lit('"}'))),
        F.lit("}]}"),
        F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(
            F.concat(
                F.lit(', "keywords": {"keyword": [{"content": "'),
                F.when(F.col("quality") == 1, F.lit("quality")).otherwise(F.lit("")),
                F.lit('"}, {"content": "'),
                F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("0")),
                F.lit('"}]}'),
            )
        ),
        F.lit("}"),
    )
    return j.select(s(pid).alias("orcid"), doc.alias("doc"))


P2_SQL = """
SELECT CAST(page_id AS VARCHAR) AS registry_id, 'orcid:' || page_id AS id,
       'G' || page_id AS firstName,
       CASE WHEN page_id % 7 = 0 THEN '' ELSE 'Fam' || page_id END AS lastName,
       trim('G' || page_id || ' ' || CASE WHEN page_id % 7 = 0 THEN '' ELSE 'Fam' || page_id END) AS fullName,
       'url|' || url || '|' || CASE WHEN page_id % 5 = 0 THEN '#' ELSE url END
         || ';orcid|' || page_id || '|https://orcid.org/' || page_id AS external_ids,
       concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS domains
FROM pages LEFT JOIN labels ON page_id = doc_id
"""


@register("P2_canonical_from_registry", P2_SQL)
def q_canonical_from_registry(spark, sf):
    """Canonical persons from registry documents, flattened."""
    d = canon.canonical_from_registry(registry_docs(spark, sf))
    p = F.col("person")
    return d.select(
        "registry_id", p["id"].alias("id"), p["firstName"].alias("firstName"), p["lastName"].alias("lastName"),
        p["fullName"].alias("fullName"),
        F.array_join(F.transform(p["externalIds"], lambda x: F.concat_ws("|", x["type"], x["id"], x["url"])), ";").alias("external_ids"),
        F.array_join(F.transform(p["top_domains"], lambda x: x["label"]["default"]), ",").alias("domains"),
    )


S8_SQL = """
SELECT ('0x' || substr(md5(p_brand), 1, 15))::BIGINT AS dim_id, p_brand, min(p_type) AS p_type,
       CAST(count(*) AS BIGINT) AS n_entries
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
"""


@register("S8_build_dimension", S8_SQL)
def q_build_dimension(spark, sf):
    """Domain dimension: one row per brand code, stable hashed id."""
    return lookup.build_dimension(table(spark, sf, "part"), "p_brand", "p_type")


P1_SQL = f"""
WITH l AS ({LINES_SQL}), t AS (SELECT seq, {TRIM_SQL} AS line FROM l)
SELECT seq, coalesce(json_extract_string(line, '$.id'), '') AS id, CAST(0.0 AS DOUBLE) AS score, items.item_id, '' AS firstName, '' AS lastName,
       coalesce(json_extract_string(line, '$.fullName'), '') AS fullName, CAST(0 AS BIGINT) AS n_top_domains,
       CAST(0 AS BIGINT) AS n_external_ids, CAST(0 AS BIGINT) AS n_affiliations, '[]' AS awards
FROM t LEFT JOIN (SELECT 'user ' || c_custkey AS k, min(c_custkey) AS item_id FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1) items
       ON items.k = lower(json_extract_string(line, '$.fullName'))
WHERE line <> '' AND json_valid(line)
"""


@register("P1_canonical_person", P1_SQL)
def q_canonical_person(spark, sf):
    """Canonical 13-field records of every decodable dump line (defaults filled)."""
    s = jsonl.scan_jsonl(dump_lines(spark, sf), schemas.PERSON_OR_ENVELOPE)
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0")
    titles = c.select(F.col("c_custkey").alias("item_id"), F.lit(graph.TITLE).alias("property"), F.concat(F.lit("User "), F.col("c_custkey").cast("string")).alias("value"))
    names = s.select(F.col("seq").alias("id"), F.col("rec.fullName").alias("fullName"))
    found = graph.match_items_by_name(names, titles).where("item_id is not null").select(F.col("person_id").alias("seq"), F.array("item_id").alias("items"))
    p = canon.canonical_person(F.col("rec"), items=F.col("items")).alias("p")
    c = s.join(found, "seq", "left").select("seq", p)
    return c.select(
        "seq", "p.id", "p.score", F.try_element_at("p.items", F.lit(1)).alias("item_id"), "p.firstName", "p.lastName", "p.fullName",
        F.size("p.top_domains").alias("n_top_domains"), F.size("p.externalIds").alias("n_external_ids"),
        F.size("p.affiliations").alias("n_affiliations"), "p.awards",
    )
