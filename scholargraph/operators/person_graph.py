"""Person record to graph rows: ranked domains, publications, affiliations, statements."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.ids import rank_within
from scholargraph.functions.text import is_blank, strip_ws


def domain_sums(domains: DataFrame) -> DataFrame:
    """The domains of a person merged by lower-case label, without a rank.

    Input ``domains(person_id, pos, label, code, type, count)``, one row per
    domain entry, ``pos`` its position in the person's list. Entries with
    no label are skipped. Per (person, lower(label)): counts are summed,
    label and type come from the first entry, the code is the last
    non-null one. One shuffle on (person_id, key) with map-side partial
    aggregation, so a person or label holding a large share of rows is
    combined before the shuffle.
    """
    d = domains.where(F.col("label").isNotNull()).withColumn("_key", F.lower("label"))
    g = d.groupBy("person_id", "_key").agg(
        F.sum("count").alias("count"),
        F.min_by(F.struct("label", "type"), "pos").alias("_first"),
        F.max_by("code", F.when(F.col("code").isNotNull(), F.col("pos"))).alias("code"),
        F.min("pos").alias("first_pos"),
    )
    return g.select("person_id", "_key", F.col("_first.label").alias("label"), F.col("_first.type").alias("type"), "code", "count", "first_pos")


def merge_domains(domains: DataFrame) -> DataFrame:
    """A1: ``domain_sums``, ranked by summed count desc, then first position.

    Output ``(person_id, rank, label, type, code, count, first_pos)``. Ranks
    come from one global sort, not from a window per person.
    """
    # the key breaks ties that only repeated positions can leave
    g = rank_within(domain_sums(domains), ["person_id"], [F.desc("count"), F.asc("first_pos"), F.asc("_key")])
    return g.select("person_id", "rank", "label", "type", "code", "count", "first_pos")


def group_publications(pubs: DataFrame) -> DataFrame:
    """A2: one row per (person, publication) with first title/year and roles.

    Input ``pubs(person_id, pos, publication, title, year, role)``. Entries
    without a title are skipped, an empty title is one. Title and year come from the first entry; roles are
    the distinct non-empty roles in first-seen order.
    """
    p = pubs.where(F.col("title").isNotNull())
    # per (person, publication, role) first, so that what is gathered for a
    # pair are its different roles, however many entries repeat them
    r = p.withColumn("role", F.when(~is_blank("role"), F.col("role"))).groupBy("person_id", "publication", "role").agg(
        F.min("pos").alias("pos"), F.min_by(F.struct("title", "year"), "pos").alias("_f")
    )
    g = r.groupBy("person_id", "publication").agg(
        F.min_by("_f", "pos").alias("_f"),
        F.min("pos").alias("first_pos"),
        F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("pos", "role")))).alias("_r"),
    )
    return g.select(
        "person_id",
        "publication",
        F.col("_f.title").alias("title"),
        F.col("_f.year").alias("year"),
        F.transform("_r", lambda s: s["role"]).alias("roles"),
        "first_pos",
    )


def affiliation_links(affiliations: DataFrame, org_ids: DataFrame) -> DataFrame:
    """P5: one person-to-organisation link per affiliation with a label (an
    empty label is one).

    ``affiliations(person_id, pos, structure_id, structure_label,
    publications_count, start_date, end_date)``; ``org_ids(structure_id,
    item_id)`` from J3. The link carries the annotation values.
    """
    a = affiliations.where(F.col("structure_label").isNotNull())
    return a.join(org_ids, "structure_id", "left").select(
        "person_id",
        "pos",
        "structure_id",
        F.col("item_id").alias("org_item_id"),
        F.col("publications_count").cast("string").alias("publications_count"),
        strip_ws("start_date").alias("start_date"),
        strip_ws("end_date").alias("end_date"),
    )


def display_summary(
    affiliations: DataFrame,
    domains: DataFrame,
    external_ids: DataFrame,
    n_affiliations: int = 2,
    n_domains: int = 10,
    ellipsis_over: int = 2,
    registry_type: str = "orcid",
) -> DataFrame:
    """One display line per person.

    ``affiliations(person_id, pos, label)``, ``domains(person_id, rank,
    label)``, ``external_ids(person_id, pos, type, id)``. The first
    ``n_affiliations`` labels and first ``n_domains`` domain labels are
    joined by ", "; " ..." is appended to the domains when the person has
    more than ``ellipsis_over`` of them. The registry id is the first
    external id of ``registry_type``. Each list is cut by a ranking window
    before it is gathered, so no list grows with the data.
    """
    wa = Window.partitionBy("person_id").orderBy("pos")
    aff = (
        affiliations.where(~is_blank("label"))
        .withColumn("_rn", F.row_number().over(wa))
        .where(F.col("_rn") <= n_affiliations)
        .groupBy("person_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "label"))), lambda s: s["label"]), ", ").alias("affiliations_text"))
    )
    # domains carry their rank already: one aggregation gives the count and
    # the first n labels (collect_list skips the nulls of ranks beyond n)
    dom = domains.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= n_domains, F.struct("rank", "label")))).alias("_d"),
    )
    dtext = F.array_join(F.transform("_d", lambda s: s["label"]), ", ")
    dom = dom.select(
        "person_id",
        F.when(F.col("n_domains") > ellipsis_over, F.concat(dtext, F.lit(" ..."))).otherwise(dtext).alias("domains_text"),
        "n_domains",
    )
    reg = (
        external_ids.where(F.col("type") == registry_type)
        .groupBy("person_id")
        .agg(F.min_by("id", "pos").alias("registry_id"))
    )
    # full outer joins: each input is read once
    return aff.join(dom, "person_id", "full").join(reg, "person_id", "full")
