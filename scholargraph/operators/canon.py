"""Canonical person records from dumps, tables and registry documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph import schemas
from scholargraph.functions.text import php_empty
from scholargraph.session import spread

# The researcher registry's identifier type, the URL prefix of
# a registry record, and the prefix of a person id built from a registry id.
REGISTRY_TYPE = "orcid"
REGISTRY_URL = "https://orcid.org/"
REGISTRY_ID_PREFIX = "orcid:"


def _arr(c: Column, elem: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{elem}>"))


def canonical_person(rec: Column, score: Column | None = None, items: Column | None = None) -> Column:
    """The 13-field canonical record of a decoded person.

    ``rec`` is a struct decoded with ``schemas.PERSON_OR_ENVELOPE``: an
    ``_source``/``_score`` envelope is unwrapped; missing strings become
    '' and missing lists empty arrays; ``topDomains`` is preferred over
    ``top_domains``. ``items`` are the ids of the
    graph items that match the person (J1), an empty list where not looked up.
    """
    env = rec.getField("_source")
    src = F.when(env.isNotNull(), env).otherwise(
        F.struct(*[rec.getField(f.split(":")[0].strip()).alias(f.split(":")[0].strip()) for f in _person_field_names()])
    )
    sc = F.coalesce(F.when(env.isNotNull(), rec.getField("_score")), score if score is not None else F.lit(0.0), F.lit(0.0))
    return F.struct(
        F.coalesce(src["id"], F.lit("")).alias("id"),
        sc.cast("double").alias("score"),
        _arr(items if items is not None else F.lit(None).cast("array<bigint>"), "bigint").alias("items"),
        F.coalesce(src["firstName"], F.lit("")).alias("firstName"),
        F.coalesce(src["lastName"], F.lit("")).alias("lastName"),
        F.coalesce(src["fullName"], F.lit("")).alias("fullName"),
        _arr(src["domains"], schemas.DOMAIN).alias("domains"),
        _arr(src["coContributors"], schemas.CO_CONTRIBUTOR).alias("coContributors"),
        _arr(src["externalIds"], schemas.EXTERNAL_ID).alias("externalIds"),
        _arr(F.coalesce(src["topDomains"], src["top_domains"]), schemas.DOMAIN).alias("top_domains"),
        _arr(src["affiliations"], schemas.AFFILIATION).alias("affiliations"),
        F.coalesce(src["awards"], F.lit("[]")).alias("awards"),
        _arr(src["publications"], schemas.PUBLICATION).alias("publications"),
    )


def _person_field_names() -> list[str]:
    names, depth, cur = [], 0, ""
    for ch in schemas.PERSON_FIELDS:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            names.append(cur)
            cur = ""
        else:
            cur += ch
    names.append(cur)
    return [n.split(":")[0].strip() for n in names]


def decode_person_table(table: DataFrame, data_col: str = "data") -> DataFrame:
    """Person table rows ``(id, fullName, data, ...)`` -> canonical persons.

    Output ``(row_id, person)``: the table id and the canonical struct. A
    record is decoded once, and not for every field of the struct; decoding is
    work for all cores, also where one file holds the table.
    """
    table = spread(table, 1 << 20)
    decoded = table.select(F.col("id").alias("row_id"), F.from_json(F.col(data_col), schemas.PERSON_OR_ENVELOPE).alias("_rec"))
    return decoded.select("row_id", canonical_person(F.col("_rec")).alias("person"))


def canonical_from_registry(docs: DataFrame, id_col: str = "orcid", doc_col: str = "doc") -> DataFrame:
    """Canonical person from a researcher-registry JSON document.

    Names and a trimmed full name; every external identifier (an empty
    URL becomes '#'), then the registry id itself; non-empty keywords as
    domains with count 1 (also used as top domains).
    """
    d = F.from_json(F.col(doc_col), schemas.REGISTRY_PERSON)
    orcid = F.col(id_col).cast("string")
    first = F.coalesce(d["name"]["given-names"]["value"], F.lit(""))
    last = F.coalesce(d["name"]["family-name"]["value"], F.lit(""))
    ext = F.transform(
        _arr(d["external-identifiers"]["external-identifier"], "struct<`external-id-type`:string,`external-id-value`:string,`external-id-url`:struct<value:string>>"),
        lambda x: F.struct(
            F.coalesce(x["external-id-type"], F.lit("")).alias("type"),
            F.coalesce(x["external-id-value"], F.lit("")).alias("id"),
            F.when(php_empty(x["external-id-url"]["value"]), F.lit("#")).otherwise(x["external-id-url"]["value"]).alias("url"),
        ),
    )
    own = F.array(F.struct(F.lit(REGISTRY_TYPE).alias("type"), orcid.alias("id"),
                           F.concat(F.lit(REGISTRY_URL), orcid).alias("url")))
    kws = F.filter(_arr(d["keywords"]["keyword"], "struct<content:string>"), lambda k: ~php_empty(k["content"]))
    domains = F.transform(
        kws,
        lambda k: F.struct(
            F.struct(k["content"].alias("default")).alias("label"),
            F.lit(None).cast("string").alias("code"),
            F.lit("keyword").alias("type"),
            F.lit(1).cast("bigint").alias("count"),
        ),
    )
    person = F.struct(
        F.concat(F.lit(REGISTRY_ID_PREFIX), orcid).alias("id"),
        F.lit(0.0).alias("score"),
        first.alias("firstName"),
        last.alias("lastName"),
        F.trim(F.concat(first, F.lit(" "), last)).alias("fullName"),
        domains.alias("domains"),
        F.array().cast(f"array<{schemas.CO_CONTRIBUTOR}>").alias("coContributors"),
        F.concat(ext, own).alias("externalIds"),
        domains.alias("top_domains"),
        F.array().cast(f"array<{schemas.AFFILIATION}>").alias("affiliations"),
        F.lit("[]").alias("awards"),
        F.array().cast(f"array<{schemas.PUBLICATION}>").alias("publications"),
    )
    return docs.select(F.col(id_col).alias("registry_id"), person.alias("person"))
