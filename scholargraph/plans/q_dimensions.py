"""Dimension tables in two loads.

Bindings: parts are domain mentions (code = brand, label = type), order lines
are mentions of structures (ref = structure id of the supplier, its name in
capitals on every seventh line) and customers are authors (two of them with
one ref where the key ends in 50). The first load has the mentions with an even
key, the second all: ids of the first are kept.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.operators.dimensions import Loaded, load_dimension
from scholargraph.plans.q_graph import STRUCTURE_ID_SQL, structure_id_col
from scholargraph.plans.registry import register, table
from scholargraph.session import cut_lineage

ATTRIBUTES = {"domain": ("code", ["label"]), "structure": ("ref", ["label"]), "author": ("ref", ["firstname", "lastname"])}


def mentions(spark, sf, kind: str):
    if kind == "domain":
        return table(spark, sf, "part").select(F.col("p_partkey").alias("_k"), F.col("p_brand").alias("code"), F.col("p_type").alias("label"))
    if kind == "structure":
        lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        label = F.when(F.col("l_linenumber") % 7 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
        return lines.select(F.col("s_suppkey").alias("_k"), structure_id_col().alias("ref"), label.alias("label"))
    key = F.col("c_custkey")
    ref = F.when(key % 100 == 50, key - 1).otherwise(key).cast("string")
    return table(spark, sf, "customer").select(key.alias("_k"), ref.alias("ref"), F.concat(F.lit("F"), key.cast("string")).alias("firstname"), F.col("c_mktsegment").alias("lastname"))


def loads(spark, sf, kind: str) -> Loaded:
    key, attributes = ATTRIBUTES[kind]
    rows = mentions(spark, sf, kind)
    first = load_dimension(None, rows.where(F.col("_k") % 2 == 0).drop("_k"), key, attributes)
    return load_dimension(cut_lineage(first.table, f"{kind}-table"), rows.drop("_k"), key, attributes)


MENTIONS_SQL = {
    "domain": "SELECT p_brand AS code, p_type AS label FROM part",
    "structure": f"SELECT {STRUCTURE_ID_SQL} AS ref, CASE WHEN l_linenumber % 7 = 0 THEN upper(s_name) ELSE s_name END AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "author": "SELECT CAST(CASE WHEN c_custkey % 100 = 50 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS ref, 'F' || c_custkey AS firstname, c_mktsegment AS lastname FROM customer",
}


def _table_sql(kind: str) -> str:
    key, attributes = ATTRIBUTES[kind]
    least = "min({" + ", ".join(f"'{a}': {a}" for a in attributes) + "})"
    columns = ", ".join(f"a.{a} AS {a}" for a in attributes)
    return f"""SELECT ('0x' || substr(md5({key}), 1, 15))::BIGINT AS id, {key}, {columns}, CAST(n AS BIGINT) AS n_entries
FROM (SELECT {key}, {least} AS a, count(*) AS n FROM ({MENTIONS_SQL[kind]}) GROUP BY 1)"""


def _table(kind: str):
    def q(spark, sf):
        return loads(spark, sf, kind).table

    q.__doc__ = f"The {kind} table after two loads; ids of the first load stay."
    return q


for _kind in ATTRIBUTES:
    register(f"S8_{_kind}_table", _table_sql(_kind))(_table(_kind))

CLASHES_SQL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS dimension, {key} AS key, 'attributes' AS reason, CAST(count(DISTINCT ({', '.join(attributes)})) AS VARCHAR) AS detail
FROM ({MENTIONS_SQL[kind]}) GROUP BY 2 HAVING count(DISTINCT ({', '.join(attributes)})) > 1"""
    for kind, (key, attributes) in ATTRIBUTES.items()
)


@register("S8_dimension_clashes", CLASHES_SQL)
def q_clashes(spark, sf):
    """Natural keys that a load gives several attributes (no two keys share a 60-bit id here)."""
    out = None
    for kind, (key, _) in ATTRIBUTES.items():
        c = loads(spark, sf, kind).clashes.select(F.lit(kind).alias("dimension"), F.col(key).alias("key"), "reason", "detail")
        out = c if out is None else out.unionByName(c)
    return out
