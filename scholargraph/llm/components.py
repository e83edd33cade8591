"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; a component's name is its
    smallest node.

    Large-star and small-star steps in turn: every node points its larger
    neighbours, then its smaller ones, at its smallest neighbour, until nothing
    changes (a number of rounds that grows with the logarithm of the longest
    chain). Minima are partial aggregates, so a node with very many links is
    combined before the shuffle; each round is written to the shared folder.
    """
    links = links.where(F.col(a) != F.col(b))
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("_m"))
        smaller = larger.join(least, "u")
        smaller = smaller.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            least.select("u", F.col("_m").alias("v"))
        )
        links = written(smaller.distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
