"""Network and places queries over suppliers as organisations.

Bindings: suppliers are organisation items with acronym, creation year,
web site, street / postcode / town (some missing or blank), register
reference and lat/long properties for two thirds of them; suppliers with
key % 10 != 0 have a point; one marker (two for key % 6 = 0) for key % 3 =
0; the gazetteer is nation centres plus street rows (and near-duplicates)
of even suppliers; orders not in status P are events whose line items link
their suppliers (A4).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.operators import enrich as E
from scholargraph.operators import graph as G
from scholargraph.operators import network as N
from scholargraph.operators import places as P
from scholargraph.plans.q_graph import STMT_OUT, long_statements, srow
from scholargraph.plans.q_ingest import P4_SQL, register_rows
from scholargraph.plans.q_ingest import S2_SQL
from scholargraph.plans.q_ingest import dump_lines
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import fold_sql
from scholargraph.session import cut_lineage
from scholargraph.sources import jsonl

ORG_CLASS = "foaf:Organization"
NETWORK_TEXT = "nation_1"


def supplier_nation(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey)


def org_items(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("title"), F.lit(ORG_CLASS).alias("class")
    )


def org_statements(spark, sf):
    """Statements of every supplier's organisation item, in one pass over
    supplier x nation (some properties absent by rule)."""
    j = supplier_nation(spark, sf)
    sk = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    half = s(F.floor(sk / 2).cast("bigint"))
    ref = F.when(sk % 4 == 0, F.concat(F.lit(" S"), half, F.lit(" "))).otherwise(F.concat(F.lit("S"), half))
    return long_statements(j, sk, [
        srow("foaf:surname", "literal", F.concat(F.lit("SG"), s(sk)), when=sk % 7 != 0),
        srow("dcterms:created", "literal", s(F.col("s_nationkey") + 1950)),
        srow("foaf:workplaceHomepage", "uri", uri=F.concat(F.lit("https://s"), s(sk), F.lit(".example.org")), when=sk % 5 != 0),
        srow(G.STREET, "literal", F.concat(s(sk), F.lit(" rue "), F.col("n_name")), when=sk % 4 != 1),
        srow(G.POSTCODE, "literal", F.lpad(s(F.col("n_nationkey") * 1000), 5, "0"), when=sk % 6 != 2),
        srow(G.TOWN, "literal", F.when(sk % 6 == 0, F.lit("  ")).otherwise(F.col("n_name"))),
        srow(G.REFERENCED_BY, "literal", ref, when=sk % 6 != 5),
        srow(P.LAT_PROP, "literal", s(F.col("s_nationkey") * 2 + 1), when=sk % 3 != 2),
        srow(P.LNG_PROP, "literal", s(F.col("s_nationkey") * 4 - 100), when=sk % 3 != 2),
    ])


ORG_STMTS_SQL = """
  SELECT s_suppkey AS item_id, 'foaf:surname' AS property, 'literal' AS type, 'SG' || s_suppkey AS value,
         NULL::VARCHAR AS uri, NULL::VARCHAR AS label FROM sn WHERE s_suppkey % 7 <> 0
  UNION ALL SELECT s_suppkey, 'dcterms:created', 'literal', CAST(s_nationkey + 1950 AS VARCHAR), NULL, NULL FROM sn
  UNION ALL SELECT s_suppkey, 'foaf:workplaceHomepage', 'uri', NULL, 'https://s' || s_suppkey || '.example.org', NULL FROM sn WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT s_suppkey, 'schema:address', 'literal', s_suppkey || ' rue ' || n_name, NULL, NULL FROM sn WHERE s_suppkey % 4 <> 1
  UNION ALL SELECT s_suppkey, 'schema:postalCode', 'literal', lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0'), NULL, NULL FROM sn WHERE s_suppkey % 6 <> 2
  UNION ALL SELECT s_suppkey, 'schema:addressLocality', 'literal', CASE WHEN s_suppkey % 6 = 0 THEN '  ' ELSE n_name END, NULL, NULL FROM sn
  UNION ALL SELECT s_suppkey, 'dcterms:isReferencedBy', 'literal',
                   CASE WHEN s_suppkey % 4 = 0 THEN ' S' || (s_suppkey // 2) || ' ' ELSE 'S' || (s_suppkey // 2) END, NULL, NULL
            FROM sn WHERE s_suppkey % 6 <> 5
  UNION ALL SELECT s_suppkey, 'geo:lat', 'literal', CAST(s_nationkey * 2 + 1 AS VARCHAR), NULL, NULL FROM sn WHERE s_suppkey % 3 <> 2
  UNION ALL SELECT s_suppkey, 'geo:long', 'literal', CAST(s_nationkey * 4 - 100 AS VARCHAR), NULL, NULL FROM sn WHERE s_suppkey % 3 <> 2
"""
SN = "sn AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
TRIM6 = "trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


def _trim(x):
    return TRIM6.format(x=x)


P7_CORE = f"""
  p7 AS (SELECT item_id, street, postcode, town,
                nullif(concat_ws(', ', CASE WHEN {_trim('street')} <> '' THEN {_trim('street')} END,
                                       CASE WHEN {_trim('postcode')} <> '' THEN {_trim('postcode')} END,
                                       CASE WHEN {_trim('town')} <> '' THEN {_trim('town')} END), '') AS address
         FROM (SELECT item_id, min(CASE WHEN property = 'schema:address' THEN value END) AS street,
                      min(CASE WHEN property = 'schema:postalCode' THEN value END) AS postcode,
                      min(CASE WHEN property = 'schema:addressLocality' THEN value END) AS town
               FROM ost WHERE property IN ('schema:address', 'schema:postalCode', 'schema:addressLocality') GROUP BY 1))
"""
P7_SQL = f"WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE} SELECT * FROM p7"


@register("P7_postal_address", P7_SQL)
def q_postal_address(spark, sf):
    """Street, postcode and town of every organisation joined into one address."""
    return G.postal_address(org_statements(spark, sf))


def points(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 10 != 0)
    return s.select(
        F.col("s_suppkey").alias("item_id"),
        (F.col("s_nationkey") * 2.5 - 30 + F.col("s_suppkey") % 7).alias("lat"),
        (F.col("s_nationkey") * 5.0 - 60 - F.col("s_suppkey") % 3).alias("lng"),
    )


POINTS_SQL = """SELECT s_suppkey AS item_id, CAST(s_nationkey * 2.5 - 30 + s_suppkey % 7 AS DOUBLE) AS lat,
       CAST(s_nationkey * 5.0 - 60 - s_suppkey % 3 AS DOUBLE) AS lng FROM supplier WHERE s_suppkey % 10 <> 0"""


def gazetteer(spark, sf):
    n = table(spark, sf, "nation")
    town = n.select(
        F.lit(None).cast("string").alias("street"), F.lpad((F.col("n_nationkey") * 1000).cast("string"), 5, "0").alias("postcode"),
        F.upper("n_name").alias("town"), (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_nationkey") * 3.0 - 80).alias("lng"),
        F.concat(F.col("n_name"), F.lit(" centre")).alias("label"),
    )
    j = supplier_nation(spark, sf)
    sk = F.col("s_suppkey")
    pc = F.lpad((F.col("n_nationkey") * 1000).cast("string"), 5, "0")
    st = j.where(sk % 2 == 0).select(
        F.concat(sk.cast("string"), F.lit(" Rue "), F.col("n_name")).alias("street"), pc.alias("postcode"),
        F.col("n_name").alias("town"), (F.col("n_nationkey") * 2.0 + (sk % 8) * 0.25).alias("lat"),
        (F.col("n_nationkey") * 3.0 - 80).alias("lng"), F.concat(F.lit("street "), sk.cast("string")).alias("label"),
    )
    dup = j.where(sk % 4 == 0).select(
        F.concat(sk.cast("string"), F.lit("  rue "), F.col("n_name")).alias("street"), pc.alias("postcode"),
        F.col("n_name").alias("town"), (F.col("n_nationkey") * 2.0 - 1.0).alias("lat"),
        (F.col("n_nationkey") * 3.0 - 80).alias("lng"), F.concat(F.lit("dup "), sk.cast("string")).alias("label"),
    )
    return town.unionByName(st).unionByName(dup)


GAZ_SQL = f"""
  SELECT NULL::VARCHAR AS street, lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0') AS postcode, upper(n_name) AS town,
         n_nationkey * 2.0 AS lat, n_nationkey * 3.0 - 80 AS lng, n_name || ' centre' AS label FROM nation
  UNION ALL SELECT s_suppkey || ' Rue ' || n_name, lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0'), n_name,
         n_nationkey * 2.0 + (s_suppkey % 8) * 0.25, n_nationkey * 3.0 - 80, 'street ' || s_suppkey FROM sn WHERE s_suppkey % 2 = 0
  UNION ALL SELECT s_suppkey || '  rue ' || n_name, lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0'), n_name,
         n_nationkey * 2.0 - 1.0, n_nationkey * 3.0 - 80, 'dup ' || s_suppkey FROM sn WHERE s_suppkey % 4 = 0
"""


def _norm(x: str) -> str:
    return f"regexp_replace({_trim(fold_sql(x))}, '\\s+', ' ', 'g')"


GEO_CORE = f"""
  gz AS ({GAZ_SQL}),
  a AS (SELECT item_id, lower({_trim('street')}) AS raw, {_norm('street')} AS st, {_norm('postcode')} AS pc, {_norm('town')} AS tw FROM p7),
  g AS (SELECT lower({_trim('street')}) AS graw, {_norm('street')} AS st, {_norm('postcode')} AS pc, {_norm('town')} AS tw,
               CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, label FROM gz),
  full_m AS (SELECT * FROM (
      SELECT a.item_id, g.lat, g.lng, g.label, 'street' AS level,
             row_number() OVER (PARTITION BY a.item_id ORDER BY levenshtein(a.raw, g.graw), g.label, g.lat, g.lng) AS rn
      FROM a JOIN g ON a.st = g.st AND a.pc = g.pc AND a.tw = g.tw WHERE a.st <> '' AND g.st <> '') WHERE rn = 1),
  towns AS (SELECT pc, tw, arg_min(lat, (label, lat, lng)) AS lat, arg_min(lng, (label, lat, lng)) AS lng, min(label) AS label
            FROM g WHERE st IS NULL OR st = '' GROUP BY 1, 2),
  town_m AS (SELECT a.item_id, towns.lat, towns.lng, towns.label, 'town' AS level FROM a JOIN towns ON a.pc = towns.pc AND a.tw = towns.tw
             WHERE a.item_id NOT IN (SELECT item_id FROM full_m)),
  geo AS (SELECT item_id, lat, lng, label, level FROM full_m UNION ALL SELECT * FROM town_m)
"""
J9_SQL = f"WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE}, {GEO_CORE} SELECT * FROM geo"


def geocoded(spark, sf):
    addr = G.postal_address(org_statements(spark, sf))
    return P.geocode(addr, gazetteer(spark, sf))


@register("J9_geocode_by_gazetteer", J9_SQL)
def q_geocode(spark, sf):
    """Organisation addresses to points: exact street key first, else the town centre."""
    return geocoded(spark, sf)


# Streets of towns are part names with a number; an address is a part's street,
# misspelt by its key: one letter less, two others, one more, cut to two
# characters, or none that exists. Every third part's street is not in the gazetteer.


def town_streets(spark, sf):
    key = F.col("p_partkey")
    town = key % 40
    return table(spark, sf, "part").select(
        key, F.concat(F.col("p_name"), F.lit(" "), (key % 97).cast("string")).alias("street"),
        F.lpad((town * 100).cast("string"), 5, "0").alias("postcode"), F.concat(F.lit("Town "), town.cast("string")).alias("town"),
    )


def street_gazetteer(spark, sf):
    s, key = town_streets(spark, sf), F.col("p_partkey")
    place = lambda street: s.select(
        street.alias("street"), "postcode", "town", (key % 180 / 4.0 - 20).alias("lat"), (key % 90 * 1.0).alias("lng"), F.concat(F.lit("place "), key.cast("string")).alias("label"), key.alias("_k"))
    full = place(F.when(key % 19 == 0, F.substring("street", 1, 2)).otherwise(F.upper("street"))).where(F.col("_k") % 3 != 0)
    return full.unionByName(place(F.lit("")).where((F.col("_k") < 35))).drop("_k")


def misspelt_addresses(spark, sf):
    s, key, st = town_streets(spark, sf), F.col("p_partkey"), F.col("street")
    end = F.char_length(st)
    written = (
        F.when(key % 19 == 0, F.substring(st, 1, 3))
        .when(key % 17 == 0, F.lit("nowhere at all"))
        .when(key % 4 == 1, F.concat(F.substring(st, 1, 2), F.substring(st, F.lit(4), end)))
        .when(key % 4 == 2, F.concat(F.lit("x"), F.substring(st, F.lit(2), F.lit(3)), F.lit("y"), F.substring(st, F.lit(6), end)))
        .when(key % 4 == 3, F.concat(st, F.lit("0")))
        .otherwise(st)
    )
    return s.select(key.alias("item_id"), written.alias("street"), "postcode", "town")


STREETS_SQL = f"""
  ts AS (SELECT p_partkey, p_name || ' ' || (p_partkey % 97) AS street, lpad(CAST(p_partkey % 40 * 100 AS VARCHAR), 5, '0') AS postcode,
                'Town ' || (p_partkey % 40) AS town FROM part),
  gz AS (SELECT {_norm("CASE WHEN p_partkey % 19 = 0 THEN left(street, 2) ELSE upper(street) END")} AS st, postcode, town,
                CAST(p_partkey % 180 / 4.0 - 20 AS DOUBLE) AS lat, CAST(p_partkey % 90 AS DOUBLE) AS lng, 'place ' || p_partkey AS label
         FROM ts WHERE p_partkey % 3 <> 0
         UNION ALL SELECT '', postcode, town, CAST(p_partkey % 180 / 4.0 - 20 AS DOUBLE), CAST(p_partkey % 90 AS DOUBLE), 'place ' || p_partkey FROM ts WHERE p_partkey < 35),
  ma AS (SELECT p_partkey AS item_id, postcode, town, street AS full_street, {_norm("""CASE WHEN p_partkey % 19 = 0 THEN left(street, 3) WHEN p_partkey % 17 = 0 THEN 'nowhere at all'
                WHEN p_partkey % 4 = 1 THEN left(street, 2) || substr(street, 4)
                WHEN p_partkey % 4 = 2 THEN 'x' || substr(street, 2, 3) || 'y' || substr(street, 6)
                WHEN p_partkey % 4 = 3 THEN street || '0' ELSE street END""")} AS st FROM ts),
  pairs AS (SELECT item_id, levenshtein(ma.st, gz.st) AS edits, label, lat, lng FROM ma JOIN gz USING (postcode, town) WHERE gz.st <> ''),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY edits, label, lat, lng) AS rn FROM pairs WHERE edits <= 2) WHERE rn = 1),
  centre AS (SELECT postcode, town, arg_min({{'lat': lat, 'lng': lng, 'label': label}}, (label, lat, lng)) AS c FROM gz WHERE st = '' GROUP BY 1, 2),
  placed AS (SELECT item_id, lat, lng, label, CASE WHEN edits = 0 THEN 'street' ELSE 'near' END AS level FROM best
             UNION ALL SELECT item_id, c.lat, c.lng, c.label, 'town' FROM ma JOIN centre USING (postcode, town) WHERE item_id NOT IN (SELECT item_id FROM best))
"""


@register("J9_near_streets", f"WITH {STREETS_SQL} SELECT * FROM placed")
def q_near_streets(spark, sf):
    """Misspelt addresses to the nearest street of their town within two edits, else the town's point."""
    return P.geocode(misspelt_addresses(spark, sf), street_gazetteer(spark, sf), max_edits=2)


J9_COMPARE_SQL = f"""
WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE}, {GEO_CORE},
have AS (SELECT item_id, lat + CASE WHEN item_id % 3 = 0 THEN 0.0001 WHEN item_id % 3 = 1 THEN 0.5 ELSE 0 END AS clat, lng AS clng
         FROM geo WHERE item_id % 4 <> 3 UNION ALL SELECT s_suppkey, 1.5, 2.5 FROM supplier WHERE s_suppkey NOT IN (SELECT item_id FROM geo)),
j AS (SELECT s.s_suppkey AS item_id, p7.address, p7.address IS NOT NULL AS asked, geo.lat, geo.lng, geo.label, have.clat, have.clng, have.item_id IS NOT NULL AS has_feature
      FROM supplier s LEFT JOIN p7 ON p7.item_id = s.s_suppkey LEFT JOIN geo ON geo.item_id = s.s_suppkey LEFT JOIN have ON have.item_id = s.s_suppkey),
hv AS (SELECT *, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2) AS h FROM j),
d AS (SELECT *, 2 * {P.EARTH_RADIUS} * asin(sqrt(CASE WHEN h > 1 THEN 1.0 ELSE h END)) AS m FROM hv)
SELECT item_id, address, CASE WHEN asked THEN lat END AS lat, CASE WHEN asked THEN lng END AS lng, CASE WHEN asked THEN label END AS label,
       clat AS current_lat, clng AS current_lng, has_feature, CASE WHEN asked THEN CAST(round(m) AS BIGINT) END AS metres,
       CASE WHEN NOT asked THEN 'no address' WHEN lat IS NULL THEN 'no result' WHEN m IS NULL THEN 'new' WHEN m <= 50 THEN 'same' ELSE 'moved' END AS status
FROM d
"""


@register("J9_compare_points", J9_COMPARE_SQL)
def q_compare_points(spark, sf):
    """What geocoding proposes for every organisation beside the point it has: same, moved, new, or nothing found."""
    geo = cut_lineage(geocoded(spark, sf), "proposed-points")
    key = F.col("item_id")
    off = F.when(key % 3 == 0, 0.0001).when(key % 3 == 1, 0.5).otherwise(0.0)
    orgs = org_items(spark, sf)
    have = geo.where(key % 4 != 3).select("item_id", (F.col("lat") + off).alias("lat"), "lng")
    have = have.unionByName(orgs.join(geo.select("item_id"), "item_id", "left_anti").select("item_id", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng")))
    out = P.compare_points(orgs, G.postal_address(org_statements(spark, sf)), geo, have)
    return out.withColumn("metres", F.round("metres").cast("bigint"))


def markers(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 3 == 0)
    sk = F.col("s_suppkey")
    a = s.select((sk * 10 + 1).alias("marker_id"), sk.alias("item_id"), (F.col("s_nationkey") + 0.25).alias("lat"),
                 (-F.col("s_nationkey") - 0.5).alias("lng"))
    b = s.where(sk % 6 == 0).select((sk * 10 + 2).alias("marker_id"), sk.alias("item_id"), (F.col("s_nationkey") + 0.75).alias("lat"),
                                   (-F.col("s_nationkey") - 0.75).alias("lng"))
    return a.unionByName(b)


J8_SQL = f"""
WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE}, {GEO_CORE},
mk AS (SELECT s_suppkey AS item_id, s_nationkey + 0.25 AS lat, -s_nationkey - 0.5 AS lng FROM supplier WHERE s_suppkey % 3 = 0),
pr AS (SELECT item_id, CAST(min(CASE WHEN property = 'geo:lat' THEN value END) AS DOUBLE) AS plat,
              CAST(min(CASE WHEN property = 'geo:long' THEN value END) AS DOUBLE) AS plng
       FROM ost WHERE property IN ('geo:lat', 'geo:long') GROUP BY 1),
j AS (SELECT s.s_suppkey AS item_id, mk.lat AS mlat, mk.lng AS mlng, pr.plat, pr.plng, p7.address, geo.lat AS glat, geo.lng AS glng
      FROM supplier s LEFT JOIN mk ON mk.item_id = s.s_suppkey LEFT JOIN pr ON pr.item_id = s.s_suppkey
      LEFT JOIN p7 ON p7.item_id = s.s_suppkey LEFT JOIN geo ON geo.item_id = s.s_suppkey),
r AS (SELECT item_id,
             CASE WHEN mlat IS NOT NULL THEN mlat WHEN plat IS NOT NULL AND plng IS NOT NULL THEN plat ELSE glat END AS lat,
             CASE WHEN mlat IS NOT NULL THEN mlng WHEN plat IS NOT NULL AND plng IS NOT NULL THEN plng ELSE glng END AS lng,
             CASE WHEN mlat IS NOT NULL THEN 'marker' WHEN plat IS NOT NULL AND plng IS NOT NULL THEN 'property'
                  WHEN glat IS NOT NULL THEN 'geocode' WHEN address IS NOT NULL AND trim(address) <> '' THEN 'address' END AS source,
             address FROM j)
SELECT * FROM r WHERE source IS NOT NULL
"""


def resolved_points(spark, sf):
    st = org_statements(spark, sf)
    addr = G.postal_address(st)
    return P.resolve_coordinates(org_items(spark, sf), markers(spark, sf), st, addr, P.geocode(addr, gazetteer(spark, sf)))


@register("J8_resolve_coordinates", J8_SQL)
def q_resolve_coordinates(spark, sf):
    """One point per organisation: first marker, else lat/long properties, else geocoded address."""
    return resolved_points(spark, sf)


A6_SQL = f"""
WITH x AS ({J8_SQL}), p AS (SELECT * FROM x WHERE lat IS NOT NULL AND lng IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n_points, min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng,
       CASE WHEN count(*) = 1 THEN min(lat) END AS center_lat, CASE WHEN count(*) = 1 THEN min(lng) END AS center_lng FROM p
"""


@register("A6_bounds", A6_SQL)
def q_bounds(spark, sf):
    """Bounding box of the resolved organisation points."""
    return N.bounds(resolved_points(spark, sf))


# ----------------------------------------------------------------- A4


def event_orgs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    person = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    members = li.select(F.col("l_suppkey").alias("org_id"), person.alias("person_id"))
    contrib = li.select(F.col("l_orderkey").alias("event_id"), person.alias("person_id"))
    events = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("event_id"))
    located = points(spark, sf).select(F.col("item_id").alias("org_id"))
    return N.event_orgs(members, contrib, events, located)


EO_SQL = """
  eo AS (SELECT DISTINCT c.event_id, m.org_id
         FROM (SELECT l_orderkey AS event_id, l_orderkey * 100 + l_linenumber AS person_id FROM lineitem) c
         JOIN (SELECT l_suppkey AS org_id, l_orderkey * 100 + l_linenumber AS person_id FROM lineitem) m USING (person_id)
         WHERE c.event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
           AND m.org_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)),
  edges AS (SELECT a.org_id AS src, b.org_id AS dst, CAST(count(*) AS BIGINT) AS n_events,
                   CAST(least(count(*) + 1, 6) AS BIGINT) AS weight, min(a.event_id) AS first_event, max(a.event_id) AS last_event
            FROM eo a JOIN eo b ON a.event_id = b.event_id AND a.org_id < b.org_id GROUP BY 1, 2)
"""
A4_SQL = f"WITH {EO_SQL} SELECT * FROM edges"


def edges(spark, sf):
    return N.collaboration_edges(event_orgs(spark, sf))[0]


@register("A4_collaboration_edges", A4_SQL)
def q_edges(spark, sf):
    """Pairs of located suppliers sharing orders, with event counts and display weight."""
    return edges(spark, sf).select("src", "dst", "n_events", "weight", "first_event", "last_event")


# ----------------------------------------------------------------- J15


def members(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("org_id"), F.col("o_custkey").alias("person_id"))


def cards(spark, sf):
    st = org_statements(spark, sf)
    persons = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"))
    return G.org_cards(org_items(spark, sf).select("item_id", "title"), st, points(spark, sf), members(spark, sf), persons)


J15_SQL = f"""
WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE},
pv AS (SELECT item_id, min(CASE WHEN property = 'foaf:surname' THEN coalesce(value, uri) END) AS acronym,
              min(CASE WHEN property = 'dcterms:created' THEN coalesce(value, uri) END) AS created,
              min(CASE WHEN property = 'foaf:workplaceHomepage' THEN coalesce(value, uri) END) AS site_web
       FROM ost GROUP BY 1),
m AS (SELECT DISTINCT l_suppkey AS org_id, o_custkey AS person_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mt AS (SELECT m.org_id, m.person_id, c.c_name AS member_title,
              row_number() OVER (PARTITION BY m.org_id ORDER BY c.c_name, m.person_id) AS rn
       FROM m JOIN customer c ON c.c_custkey = m.person_id),
ml AS (SELECT org_id, count(*) AS n_members,
              string_agg(member_title, '; ' ORDER BY rn) FILTER (WHERE rn <= 20) AS members,
              string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS member_ids
       FROM mt GROUP BY 1),
pt AS ({POINTS_SQL})
SELECT s.s_suppkey AS item_id, s.s_name AS title, pt.lat, pt.lng, pv.acronym, pv.created, pv.site_web, p7.address,
       CAST(coalesce(ml.n_members, 0) AS BIGINT) AS n_members, ml.members, ml.member_ids
FROM supplier s JOIN pt ON pt.item_id = s.s_suppkey LEFT JOIN pv ON pv.item_id = s.s_suppkey
LEFT JOIN p7 ON p7.item_id = s.s_suppkey LEFT JOIN ml ON ml.org_id = s.s_suppkey
"""


@register("J15_org_cards", J15_SQL)
def q_org_cards(spark, sf):
    """Card of every located organisation with its first 20 members by name."""
    c = cards(spark, sf)
    return c.select(
        "item_id", "title", "lat", "lng", "acronym", "created", "site_web", "address", "n_members",
        F.array_join("members", "; ").alias("members"),
        F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ",").alias("member_ids"),
    )


F12_SQL = f"""
WITH {SN}, ost AS ({ORG_STMTS_SQL}), {P7_CORE}, {EO_SQL},
pv AS (SELECT item_id, min(CASE WHEN property = 'foaf:surname' THEN value END) AS acronym FROM ost GROUP BY 1),
pt AS ({POINTS_SQL}),
o AS (SELECT s.s_suppkey AS item_id, s.s_name AS title, pv.acronym, p7.address FROM supplier s JOIN pt ON pt.item_id = s.s_suppkey
      LEFT JOIN pv ON pv.item_id = s.s_suppkey LEFT JOIN p7 ON p7.item_id = s.s_suppkey),
k AS (SELECT item_id FROM o WHERE coalesce(contains(lower(title), '{NETWORK_TEXT}'), false)
         OR coalesce(contains(lower(acronym), '{NETWORK_TEXT}'), false) OR coalesce(contains(lower(address), '{NETWORK_TEXT}'), false)),
ke AS (SELECT * FROM edges WHERE src IN (SELECT item_id FROM k) AND dst IN (SELECT item_id FROM k))
SELECT src, dst, n_events, weight, (SELECT CAST(count(*) AS BIGINT) FROM k) AS kept_orgs,
       (SELECT CAST(count(*) AS BIGINT) FROM o) AS total_orgs, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS total_edges
FROM ke
"""


@register("F12_filter_network", F12_SQL)
def q_filter_network(spark, sf):
    """Edges between organisations matching 'nation_1', with kept/total counts."""
    st = org_statements(spark, sf)
    acr = G.pivot_values(st, {"foaf:surname": "acronym"})
    addr = G.postal_address(st).select("item_id", "address")
    located = org_items(spark, sf).select("item_id", "title").join(points(spark, sf).select("item_id"), "item_id", "left_semi")
    c = located.join(acr, "item_id", "left").join(addr, "item_id", "left")
    marked = N.mark_network(c, NETWORK_TEXT)
    e = cut_lineage(edges(spark, sf), "edges")
    ke = N.filter_network(marked, e)
    # all counts from one pass over each frame
    orgs = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept")).select(F.struct("total", "kept").alias("n")).scalar()
    n_edges = e.select(F.count(F.lit(1))).scalar()
    return ke.select("src", "dst", "n_events", "weight", orgs["kept"].alias("kept_orgs"), orgs["total"].alias("total_orgs"), n_edges.alias("total_edges"))


# Titles with what JSON must escape: quotes, a backslash, a line break.
S7_SQL = f"""
WITH {EO_SQL}, pt AS ({POINTS_SQL}),
o AS (SELECT s.s_suppkey AS item_id, s.s_name || CASE s.s_suppkey % 4 WHEN 0 THEN ' "A"' WHEN 1 THEN ' \\ b' WHEN 2 THEN chr(10) || 'c' ELSE '' END AS title,
             pt.lat, pt.lng FROM supplier s JOIN pt ON pt.item_id = s.s_suppkey),
ev AS (SELECT src, dst, string_agg('Event "' || event_id || '"', '|' ORDER BY event_id) AS titles FROM (
         SELECT a.org_id AS src, b.org_id AS dst, a.event_id,
                row_number() OVER (PARTITION BY a.org_id, b.org_id ORDER BY a.event_id) AS k
         FROM eo a JOIN eo b ON a.event_id = b.event_id AND a.org_id < b.org_id) WHERE k <= 3 GROUP BY 1, 2)
SELECT e.src, e.dst, 'LineString' AS geometry, a.lng AS lng1, a.lat AS lat1, b.lng AS lng2, b.lat AS lat2,
       a.title AS from_title, b.title AS to_title, e.weight, e.n_events AS events, ev.titles
FROM edges e JOIN o a ON a.item_id = e.src JOIN o b ON b.item_id = e.dst JOIN ev ON ev.src = e.src AND ev.dst = e.dst
"""
FEATURE = (
    "geometry struct<type: string, coordinates: array<array<double>>>, "
    "properties struct<`from`: string, `to`: string, weight: bigint, events: bigint, titles: array<string>>"
)


@register("S7_edges_geojson", S7_SQL)
def q_geojson(spark, sf):
    """One GeoJSON LineString per collaboration edge, read back from its JSON text."""
    k = F.col("item_id") % 4
    suffix = F.when(k == 0, ' "A"').when(k == 1, " \\ b").when(k == 2, "\nc").otherwise("")
    pts = points(spark, sf).join(org_items(spark, sf), "item_id").withColumn("title", F.concat("title", suffix))
    e, pairs = N.collaboration_edges(event_orgs(spark, sf))
    titled = pairs.withColumn("title", F.concat(F.lit('Event "'), F.col("event_id").cast("string"), F.lit('"')))
    f = N.edges_geojson(e, titled, pts, 3).withColumn("f", F.from_json("feature", FEATURE))
    c, p = F.col("f.geometry.coordinates"), F.col("f.properties")
    return f.select(
        "src", "dst", F.col("f.geometry.type").alias("geometry"), c[0][0].alias("lng1"), c[0][1].alias("lat1"), c[1][0].alias("lng2"), c[1][1].alias("lat2"),
        p["from"].alias("from_title"), p["to"].alias("to_title"), p["weight"].alias("weight"), p["events"].alias("events"),
        F.array_join(p["titles"], "|").alias("titles"),
    )


# ----------------------------------------------------------------- J5 / A7

J5_SQL = f"""
WITH {SN}, ost AS ({ORG_STMTS_SQL}),
refs AS (SELECT item_id, min({_trim('value')}) AS k FROM ost WHERE property = 'dcterms:isReferencedBy' AND value IS NOT NULL GROUP BY 1),
new AS ({P4_SQL}),
upd AS (SELECT refs.item_id, new.property, new.type, CASE WHEN new.type <> 'uri' THEN new.value END AS value,
               CASE WHEN new.type = 'uri' THEN new.value END AS uri, NULL::VARCHAR AS label
        FROM refs JOIN new ON new.numero_national_de_structure = refs.k),
own AS (SELECT * FROM ost WHERE item_id IN (SELECT item_id FROM upd)),
ek AS (SELECT DISTINCT item_id, property, CASE WHEN type = 'uri' THEN 'u:' || coalesce(uri, '') ELSE 'v:' || coalesce(value, '') END AS k FROM own)
SELECT * FROM own
UNION ALL SELECT DISTINCT * FROM upd u WHERE NOT EXISTS (
  SELECT 1 FROM ek WHERE ek.item_id = u.item_id AND ek.property = u.property
    AND ek.k = CASE WHEN u.type = 'uri' THEN 'u:' || coalesce(u.uri, '') ELSE 'v:' || coalesce(u.value, '') END)
"""


def enriched(spark, sf):
    return E.enrich_structures(org_items(spark, sf), org_statements(spark, sf), register_rows(spark, sf), ORG_CLASS)


@register("J5_enrich_structures", J5_SQL)
def q_enrich(spark, sf):
    """Organisation statements refreshed from the register (append-distinct merge)."""
    return enriched(spark, sf)[0].select(*STMT_OUT)


A7_SQL = f"""
WITH v AS ({S2_SQL}),
l AS (SELECT seq, {_trim('value')} AS line FROM ({__import__('scholargraph.plans.q_ingest', fromlist=['LINES_SQL']).LINES_SQL}))
SELECT 'import' AS job, 'imported' AS counter, CAST(count(*) AS BIGINT) AS n FROM v
UNION ALL SELECT 'import', 'skipped', CAST(count(*) AS BIGINT) FROM l WHERE line <> '' AND seq NOT IN (SELECT seq FROM v)
UNION ALL SELECT 'enrich', counter, CAST(n AS BIGINT) FROM (
  WITH {SN}, ost AS ({ORG_STMTS_SQL}),
  refs AS (SELECT item_id, min({_trim('value')}) AS k FROM ost WHERE property = 'dcterms:isReferencedBy' AND value IS NOT NULL GROUP BY 1),
  new AS ({P4_SQL}),
  st AS (SELECT refs.item_id, CASE WHEN refs.item_id IN (SELECT refs.item_id FROM refs JOIN new ON new.numero_national_de_structure = refs.k)
                                   THEN 'updated' ELSE 'skipped' END AS status FROM refs)
  SELECT status AS counter, count(*) AS n FROM st GROUP BY 1 UNION ALL SELECT 'processed', count(*) FROM st)
"""


@register("A7_run_counters", A7_SQL)
def q_counters(spark, sf):
    """Import counters (imported / skipped lines) and enrichment counters."""
    _, _, counters = jsonl.split_lines(dump_lines(spark, sf))  # observed by the job that writes the lines
    imp = counters.withColumn("job", F.lit("import"))
    enr = enriched(spark, sf)[2].withColumn("job", F.lit("enrich"))
    return imp.unionByName(enr).select("job", "counter", "n")
