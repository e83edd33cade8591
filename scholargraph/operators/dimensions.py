"""Domain, structure and author tables whose ids stay over loads."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.text import is_blank
from scholargraph.operators.batch import PersonTables
from scholargraph.session import cut_lineage

#: Bits of an id, as in ``stable_id``.
ID_BITS = 60


def dimension_entries(persons: PersonTables) -> dict[str, DataFrame]:
    """What persons say of domains ``(code, label)``, structures ``(ref,
    label)`` and authors ``(ref, firstname, lastname)``, one row per mention."""
    p = F.col("person")
    return {
        "domain": persons.domains.select("code", "label"),
        "structure": persons.affiliations.select(F.col("structure_id").alias("ref"), F.col("structure_label").alias("label")),
        "author": persons.records.select(F.col("id").cast("string").alias("ref"), p["firstName"].alias("firstname"), p["lastName"].alias("lastname")),
    }


def _hashed(key: str, attempt: int, bits: int) -> Column:
    """The id of a natural key: the first bits of its md5, for a further attempt of key and attempt."""
    text = F.col(key).cast("string")
    text = F.concat_ws("\u0001", text, F.lit(str(attempt))) if attempt else text
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))


class Loaded(NamedTuple):
    """``table(id, <key>, <attributes>, n_entries)`` after the load, and
    ``clashes(<key>, reason, detail)``: ``attributes`` for a key that the load
    gives several of (detail: how many), ``id`` for a key whose hash another key
    has (detail: the key that has it)."""

    table: DataFrame
    clashes: DataFrame


def load_dimension(current: DataFrame | None, entries: DataFrame, key: str, attributes: list[str], bits: int = ID_BITS) -> Loaded:
    """One load of a dimension.

    ``entries(<key>, <attributes>)``, one row per mention; those with a blank key
    are skipped. A key that ``current`` has keeps its id; its attributes and
    count become the load's. A new key gets an id hashed from it; if another key
    has that id, the smaller new key keeps it and the others (all, if a key has it
    from before or by an earlier attempt) take the hash of their next attempt. Of several attributes of a
    key the smallest stay. The same loads in the same order give the same ids;
    keys are combined before the shuffle, however many rows mention one.
    """
    seen = entries.where(~is_blank(F.col(key).cast("string")))
    variants = seen.groupBy(key, *attributes).agg(F.count(F.lit(1)).alias("_n"))
    keys = variants.groupBy(key).agg(F.min(F.struct(*attributes)).alias("_a"), F.sum("_n").alias("n_entries"), F.count(F.lit(1)).alias("_variants"))
    keys = cut_lineage(keys, "dimension-keys")
    several = keys.where(F.col("_variants") > 1).select(key, F.lit("attributes").alias("reason"), F.col("_variants").cast("string").alias("detail"))
    known = None if current is None else current.select("id", key)
    pending = keys.select(key) if known is None else keys.select(key).join(known.select(key), key, "left_anti")
    clashes, attempt, given = several, 0, None
    while True:
        asked = pending.withColumn("id", _hashed(key, attempt, bits))
        first = asked.groupBy("id").agg(F.min(key).alias("_new"))
        holders = [df for df in (known, given) if df is not None]
        if holders:
            taken = holders[0] if len(holders) == 1 else holders[0].unionByName(holders[1])
            first = first.join(taken.select("id", F.col(key).alias("_held")), "id", "left")
        else:
            first = first.withColumn("_held", F.lit(None).cast(asked.schema[key].dataType))
        settled = cut_lineage(asked.join(first, "id").withColumn("_by", F.coalesce("_held", "_new")), "dimension-ids")
        won = settled.where(F.col("_by") == F.col(key)).select("id", key)
        given = won if given is None else given.unionByName(won)
        lost = settled.where(F.col("_by") != F.col(key))
        if lost.isEmpty():
            break
        clashes = clashes.unionByName(lost.select(key, F.lit("id").alias("reason"), F.col("_by").cast("string").alias("detail")))
        pending, attempt = lost.select(key), attempt + 1
    ids = given if known is None else known.unionByName(given)
    columns = ["id", key, *attributes, "n_entries"]
    fresh = keys.join(ids, key).select("id", key, F.col("_a.*"), "n_entries")
    if current is None:
        return Loaded(fresh.select(*columns), clashes)
    stay = current.join(keys.select(key), key, "left_anti")
    return Loaded(stay.select(*columns).unionByName(fresh.select(*columns)), clashes)
