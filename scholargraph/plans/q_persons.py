"""Queries over person records: ranked domains, publications, affiliations.

Bindings: a customer is a person; each line item of their orders is one
domain entry (label = part type, lower-cased on even line numbers, none for
part sizes divisible by 25; code = brand on every third line), one
publication entry (publication = order, role = return flag, year of the
order date, untitled first line of every fifth order) and one affiliation
(structure = supplier). The position of an entry is the unique
(order, line number, part, supplier) of its line item.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.operators import person_graph as pg
from scholargraph.plans.registry import register, table

# ---------------------------------------------------------------- bindings

# (l_orderkey, l_linenumber, l_partkey, l_suppkey) is unique in lineitem;
# it is the position of an entry wherever "first" or "last" matters.
def line_pos():
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


LINE_POS_SQL = "{'l_orderkey': l.l_orderkey, 'l_linenumber': l.l_linenumber, 'l_partkey': l.l_partkey, 'l_suppkey': l.l_suppkey}"


def order_lines(spark, sf):
    """Every line item beside its order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    return li.join(o, li.l_orderkey == o.o_orderkey)


def domain_entries(spark, sf, lines=None):
    """Domains of each customer: one entry per line item of their orders
    (``lines``: ``order_lines`` that are written already)."""
    lines = order_lines(spark, sf) if lines is None else lines
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    j = lines.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("o_custkey").alias("person_id"),
        line_pos().alias("pos"),
        F.when(F.col("p_size") % 25 == 0, F.lit(None).cast("string"))
        .when(F.col("l_linenumber") % 2 == 0, F.lower("p_type"))
        .otherwise(F.col("p_type"))
        .alias("label"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")).alias("code"),
        F.lit("keyword").alias("type"),
        F.floor("l_quantity").cast("bigint").alias("count"),
    )


DOMAINS_SQL = f"""
  SELECT o.o_custkey AS person_id, {LINE_POS_SQL} AS pos,
         CASE WHEN p.p_size % 25 = 0 THEN NULL
              WHEN l.l_linenumber % 2 = 0 THEN lower(p.p_type) ELSE p.p_type END AS label,
         CASE WHEN l.l_linenumber % 3 = 0 THEN p.p_brand END AS code,
         CAST(floor(l.l_quantity) AS BIGINT) AS cnt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey
"""

A1_SQL = f"""
WITH d AS ({DOMAINS_SQL}),
g AS (
  SELECT person_id, lower(label) AS k, CAST(sum(cnt) AS BIGINT) AS count,
         arg_min(label, pos) AS label,
         arg_max(code, pos) FILTER (WHERE code IS NOT NULL) AS code,
         min(pos) AS first_pos
  FROM d WHERE label IS NOT NULL GROUP BY person_id, lower(label))
SELECT person_id,
       row_number() OVER (PARTITION BY person_id ORDER BY count DESC, first_pos) AS rank,
       label, code, count
FROM g
"""


@register("A1_merge_domains", A1_SQL)
def q_merge_domains(spark, sf):
    """Ranked, case-merged domains of every customer."""
    return pg.merge_domains(domain_entries(spark, sf)).drop("type", "first_pos")


def publication_entries(spark, sf, lines=None):
    """Publications of each customer: one entry per line item of an order."""
    j = order_lines(spark, sf) if lines is None else lines
    return j.select(
        F.col("o_custkey").alias("person_id"),
        line_pos().alias("pos"),
        F.col("o_orderkey").alias("publication"),
        F.when((F.col("l_linenumber") == 1) & (F.col("o_orderkey") % 5 == 0), F.lit(""))
        .otherwise(F.concat(F.lit("Publication "), F.col("o_orderkey").cast("string"), F.lit(" part "), F.col("l_linenumber").cast("string")))
        .alias("title"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.col("l_returnflag").alias("role"),
    )


PUBS_SQL = f"""
  SELECT o.o_custkey AS person_id, {LINE_POS_SQL} AS pos, o.o_orderkey AS publication,
         CASE WHEN l.l_linenumber = 1 AND o.o_orderkey % 5 = 0 THEN ''
              ELSE 'Publication ' || o.o_orderkey || ' part ' || l.l_linenumber END AS title,
         CAST(year(o.o_orderdate) AS VARCHAR) AS year, l.l_returnflag AS role
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

A2_SQL = f"""
WITH p AS ({PUBS_SQL}), t AS (SELECT * FROM p WHERE title IS NOT NULL),
f AS (SELECT person_id, publication, arg_min(title, pos) AS title, arg_min(year, pos) AS year
      FROM t GROUP BY 1, 2),
r AS (SELECT person_id, publication, role, min(pos) AS rpos FROM t GROUP BY 1, 2, 3),
ra AS (SELECT person_id, publication, string_agg(role, ',' ORDER BY rpos) AS roles FROM r GROUP BY 1, 2)
SELECT f.person_id, f.publication, f.title, f.year, ra.roles
FROM f JOIN ra USING (person_id, publication)
"""


@register("A2_group_publications", A2_SQL)
def q_group_publications(spark, sf):
    """Publications per customer with first title/year and first-seen roles."""
    g = pg.group_publications(publication_entries(spark, sf))
    return g.select("person_id", "publication", "title", "year", F.array_join("roles", ",").alias("roles"))


def affiliation_entries(spark, sf, lines=None):
    """Affiliations of each customer: the suppliers of their line items. The
    line items are summed before they meet the supplier's name."""
    lines = order_lines(spark, sf) if lines is None else lines
    s = table(spark, sf, "supplier").groupBy("s_suppkey").agg(F.first("s_name").alias("structure_label"), F.count(F.lit(1)).alias("_rows"))
    j = lines.groupBy(F.col("o_custkey").alias("person_id"), F.col("l_suppkey")).agg(
        F.min(line_pos()).alias("pos"),
        F.count(F.lit(1)).alias("_lines"),
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("end_date"),
    )
    return j.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "person_id", "l_suppkey", "pos", "structure_label", (F.col("_lines") * F.col("_rows")).alias("publications_count"),
        "start_date", "end_date", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("structure_id"),
    )


def external_id_entries(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return c.where(F.col("c_custkey") % 4 != 0).select(
        F.col("c_custkey").alias("person_id"),
        F.lit(1).alias("pos"),
        F.lit("orcid").alias("type"),
        F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("id"),
    )


P6_SQL = f"""
WITH d AS ({DOMAINS_SQL}),
g AS (SELECT person_id, lower(label) AS k, sum(cnt) AS count, arg_min(label, pos) AS label, min(pos) AS first_pos
      FROM d WHERE label IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT person_id, label, row_number() OVER (PARTITION BY person_id ORDER BY count DESC, first_pos) AS rank FROM g),
dom AS (SELECT person_id,
               string_agg(label, ', ' ORDER BY rank) FILTER (WHERE rank <= 10)
                 || CASE WHEN count(*) > 2 THEN ' ...' ELSE '' END AS domains_text,
               count(*) AS n_domains
        FROM rk GROUP BY 1),
a AS (SELECT o.o_custkey AS person_id, l.l_suppkey, min({LINE_POS_SQL}) AS pos, any_value(s.s_name) AS label
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
      GROUP BY 1, 2),
ar AS (SELECT person_id, label, row_number() OVER (PARTITION BY person_id ORDER BY pos) AS rn FROM a),
aff AS (SELECT person_id, string_agg(label, ', ' ORDER BY rn) AS affiliations_text FROM ar WHERE rn <= 2 GROUP BY 1),
reg AS (SELECT c_custkey AS person_id, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS registry_id
        FROM customer WHERE c_custkey % 4 <> 0),
people AS (SELECT person_id FROM aff UNION SELECT person_id FROM dom UNION SELECT person_id FROM reg)
SELECT people.person_id, aff.affiliations_text, dom.domains_text, CAST(dom.n_domains AS BIGINT) AS n_domains, reg.registry_id
FROM people LEFT JOIN aff USING (person_id) LEFT JOIN dom USING (person_id) LEFT JOIN reg USING (person_id)
"""


@register("P6_display_summary", P6_SQL)
def q_display_summary(spark, sf):
    """One summary line per customer: first 2 suppliers, first 10 ranked domains."""
    ranked = pg.merge_domains(domain_entries(spark, sf)).select("person_id", "rank", "label")
    aff = affiliation_entries(spark, sf).select("person_id", "pos", F.col("structure_label").alias("label"))
    return pg.display_summary(aff, ranked, external_id_entries(spark, sf))
