"""One batch of items merged with what is known of persons and structures."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.ids import stable_id
from scholargraph.functions.text import fold, is_blank
from scholargraph.operators import graph as G
from scholargraph.operators import person_graph as pg
from scholargraph.operators.enrich import enrich_structures
from scholargraph.session import cut_lineage

# Properties that the mapping fills, the annotations of their
# values, and the classes of created items.
HAS_CONCEPT = "dcterms:subject"
HAS_STRUCTURE = "dcterms:isPartOf"
CONTRIBUTORS = "bibo:contributorList"
PUBLICATIONS = "foaf:publications"
RANK = "curation:rank"
START = "curation:start"
END = "curation:end"
DATE = "dcterms:date"
STATUS = "foaf:status"
PERSON_CLASS = "foaf:Person"
ORG_CLASS = "foaf:Organization"
CONCEPT_CLASS = "skos:Concept"


class PersonTables(NamedTuple):
    """What is known of persons, one table per list of a record.

    ``records(id, person)`` canonical persons; ``domains(person_id, pos,
    label, code, type, count)``; ``coauthors(person_id, coauthor_id)``;
    ``affiliations(person_id, pos, structure_id, structure_label, kinds,
    publications_count, start_date, end_date)``; ``publications(person_id,
    pos, publication, title, year, role)``.
    """

    records: DataFrame
    domains: DataFrame
    coauthors: DataFrame
    affiliations: DataFrame
    publications: DataFrame


def person_tables(records: DataFrame) -> PersonTables:
    """The lists of canonical persons ``(id, person)`` as tables of their own."""

    def rows(field: str) -> DataFrame:
        return records.select(F.col("id").alias("person_id"), F.posexplode(f"person.{field}").alias("pos", "x"))

    x = F.col("x")
    structure = x["structure"]
    return PersonTables(
        records.select("id", "person"),
        rows("top_domains").select("person_id", "pos", x["label"]["default"].alias("label"), x["code"].alias("code"), x["type"].alias("type"), x["count"].alias("count")),
        rows("coContributors").where(x["person"].isNotNull()).select("person_id", x["person"].cast(records.schema["id"].dataType).alias("coauthor_id")),
        rows("affiliations").select(
            "person_id", "pos", structure["id"].alias("structure_id"), structure["label"]["default"].alias("structure_label"), structure["kind"].alias("kinds"),
            x["publicationsCount"].alias("publications_count"), x["startDate"].alias("start_date"), x["endDate"].alias("end_date"),
        ),
        rows("publications").select("person_id", "pos", x["publication"].alias("publication"), x["title"]["default"].alias("title"), x["year"].alias("year"), x["role"].alias("role")),
    )


class Merge(NamedTuple):
    """``statements``: those of the batch's person items, of its updated
    organisations and of created items, after the merge. ``annotations(item_id,
    property, target_id, value, name, annotation)`` of the statements with that
    target or value. ``created(item_id, class)``. ``status(item_id, route,
    status)`` for every item of the batch: route ``person`` or ``structure``,
    ``updated`` or ``skipped``. ``missing(item_id)``: asked for, not there."""

    statements: DataFrame
    annotations: DataFrame
    created: DataFrame
    status: DataFrame
    missing: DataFrame


def _links(df: DataFrame, prop: str, target: str) -> DataFrame:
    return G.statements_frame(df.select("item_id", F.lit(prop).alias("property"), F.lit("resource").alias("type"), F.col(target).alias("target_id")))


def _annotations(df: DataFrame, prop: str, named: dict[str, Column], target: Column | None = None, value: Column | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), c.cast("string").alias("annotation")) for name, c in named.items()])
    out = df.select(
        "item_id", F.lit(prop).alias("property"),
        (target if target is not None else F.lit(None)).cast("bigint").alias("target_id"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"),
        F.inline(pairs),
    )
    return out.where(F.col("annotation").isNotNull())


def settle_coauthors(co: DataFrame, records: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4 with the items that are to be created settled.

    Returns ``(links, founders)``: ``links(person_id, coauthor_id, item_id)``
    for every co-author that is known, ``founders(item_id, person_id)`` the
    items to create and the record each is made from. As items are matched by
    folded full name, co-authors of one name share one item, with an id hashed
    from the name (from the person id if it has no name) and the record of the
    smallest id; a second batch finds it by that name.
    """
    known = cut_lineage(records.select("id", F.col("person.fullName").alias("fullName")), "merge-names")
    resolved = G.resolve_coauthors(co, known, statements)
    resolved = cut_lineage(resolved.where(F.col("status") != "unknown"), "merge-coauthors")
    names = known.join(resolved.where(F.col("status") == "to_create").select(F.col("coauthor_id").alias("id")).distinct(), "id", "left_semi")
    key = F.when(is_blank("fullName"), F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("name:"), fold("fullName")))
    made = cut_lineage(names.select(F.col("id").alias("coauthor_id"), stable_id(F.lit("person"), key).alias("_made")).distinct(), "merge-created-persons")
    links = resolved.join(made, "coauthor_id", "left").select("person_id", "coauthor_id", F.coalesce("item_id", "_made").alias("item_id"))
    founders = made.groupBy(F.col("_made").alias("item_id")).agg(F.min("coauthor_id").alias("person_id"))
    return links, founders


def merge_batch(
    requested: DataFrame,
    items: DataFrame,
    statements: DataFrame,
    names: DataFrame,
    persons: PersonTables,
    register: DataFrame,
    search: Callable[[DataFrame, DataFrame, int], DataFrame],
    org_class: str = ORG_CLASS,
    id_prefix: str = "person:",
) -> Merge:
    """Enrich many items at once.

    ``requested(item_id)``; ``items(item_id, class, title)`` and
    ``statements`` of the graph; ``names(id, name)`` the searchable person
    table; ``register`` the structure register; ``search(names, queries, k)``
    a batch search (F3).

    1. Ids that no item has are reported (J14). Organisation items take the
       structure route (J5), all others the person route.
    2. Titles of the person route are searched as one batch; an item without
       a hit is left as it is.
    3. What the mapping refers to is settled once for the whole batch, in order
       of dependence: co-authors of the hits (J4, created from their own record,
       one level deep), then concepts of the hits' merged domains (A1, J2), then
       organisations of the affiliations of hits and created persons (P5, J3).
    4. Rows are typed by property: names and external ids (P3), domain,
       co-author and affiliation links, publication titles (A2). They replace
       the values of the same item and property (J6); ranks, dates and roles
       are annotations beside them.

    Every step is a keyed join over the batch's part of a table; what several
    steps read is written once.
    """
    asked = cut_lineage(requested.select("item_id").distinct(), "merge-requested")
    batch = cut_lineage(items.join(asked, "item_id", "left_semi"), "merge-batch")
    is_org = F.col("class").eqNullSafe(F.lit(org_class))
    orgs, others = batch.where(is_org), batch.where(~is_org)

    queries = others.select(F.col("item_id").alias("query_id"), F.col("title").alias("text"))
    found = search(names, queries, 1).select(F.col("query_id").alias("item_id"), F.col("id").alias("person_id"))
    hits = cut_lineage(found, "merge-hits")
    wanted = hits.select("person_id").distinct()

    coauthors = persons.coauthors.join(wanted, "person_id", "left_semi").select("person_id", "coauthor_id").distinct()
    coauthors = cut_lineage(coauthors, "merge-coauthor-pairs")
    links, founders = settle_coauthors(coauthors, persons.records, statements)
    people = cut_lineage(hits.unionByName(founders), "merge-people")
    co_links = hits.join(links.withColumnRenamed("item_id", "target"), "person_id").select("item_id", "target")

    domains = pg.domain_sums(persons.domains.join(wanted, "person_id", "left_semi"))
    domains = cut_lineage(G.concept_key(domains), "merge-domains")
    concepts, concept_rows = G.resolve_concepts(domains.select("label", "code", "type"), statements)
    concepts = cut_lineage(concepts, "merge-concepts")
    domain_links = domains.join(concepts.select("kind", "key", F.col("item_id").alias("concept_id")), ["kind", "key"])
    domain_links = cut_lineage(hits.join(domain_links, "person_id").select("item_id", "concept_id", "count"), "merge-domain-links")

    affiliations = persons.affiliations.join(people.select("person_id").distinct(), "person_id", "left_semi")
    # links have no place in a list, so none is made or carried
    affiliations = affiliations.where(F.col("structure_label").isNotNull()).withColumn("pos", F.lit(None).cast("int"))
    affiliations = cut_lineage(affiliations, "merge-affiliations")
    structures = affiliations.select("structure_id", F.col("structure_label").alias("label"), "kinds")
    resolved_orgs, org_rows = G.resolve_orgs(structures, statements)
    resolved_orgs = cut_lineage(resolved_orgs, "merge-organisations")
    org_links = pg.affiliation_links(affiliations, resolved_orgs.select("structure_id", "item_id")).where(F.col("org_item_id").isNotNull())
    org_links = cut_lineage(people.join(org_links, "person_id").drop("person_id", "pos", "structure_id"), "merge-affiliation-links")

    publications = pg.group_publications(persons.publications.join(wanted, "person_id", "left_semi"))
    publications = cut_lineage(hits.join(publications, "person_id").drop("person_id", "first_pos"), "merge-publications")

    own = statements.join(others.select("item_id"), "item_id", "left_semi")
    records = people.join(persons.records.withColumnRenamed("id", "person_id"), "person_id").select("item_id", "person")
    titles = publications.select("item_id", F.lit(PUBLICATIONS).alias("property"), F.lit("literal").alias("type"), F.col("title").alias("value"))
    # the other rows come from written tables: reading those twice is less than writing their rows
    new = (
        cut_lineage(G.person_statements(records, own, id_prefix), "merge-person-statements")
        .unionByName(_links(domain_links, HAS_CONCEPT, "concept_id"))
        .unionByName(_links(co_links, CONTRIBUTORS, "target"))
        .unionByName(_links(org_links, HAS_STRUCTURE, "org_item_id"))
        .unionByName(G.statements_frame(titles))
    )
    merged = G.merge_statements(own, new, "replace")

    refreshed, org_status, _ = enrich_structures(orgs, statements.join(orgs.select("item_id"), "item_id", "left_semi"), register, org_class)
    statuses = F.when(F.col("_s").isNull(), "skipped").otherwise(F.col("_s"))
    status = (
        others.select("item_id")
        .join(hits.select("item_id", F.lit("updated").alias("_s")), "item_id", "left")
        .select("item_id", F.lit("person").alias("route"), statuses.alias("status"))
        .unionByName(
            orgs.select("item_id")
            .join(org_status.withColumnRenamed("status", "_s"), "item_id", "left")
            .select("item_id", F.lit("structure").alias("route"), statuses.alias("status"))
        )
    )
    role = F.explode("roles").alias("role")
    annotations = (
        _annotations(domain_links, HAS_CONCEPT, {RANK: F.col("count")}, target=F.col("concept_id"))
        .unionByName(_annotations(org_links, HAS_STRUCTURE, {RANK: F.col("publications_count"), START: F.col("start_date"), END: F.col("end_date")}, target=F.col("org_item_id")))
        .unionByName(_annotations(publications, PUBLICATIONS, {DATE: F.coalesce("year", F.lit("")), G.REFERENCED_BY: F.col("publication")}, value=F.col("title")))
        .unionByName(_annotations(publications.select("item_id", "title", role), PUBLICATIONS, {STATUS: F.col("role")}, value=F.col("title")))
    )
    made = lambda df, cls: df.where(F.col("status") == "created").select("item_id", F.lit(cls).alias("class"))
    created = (
        made(concepts, CONCEPT_CLASS).unionByName(made(resolved_orgs, org_class)).unionByName(founders.select("item_id", F.lit(PERSON_CLASS).alias("class")))
    )
    everything = merged.unionByName(G.statements_frame(concept_rows)).unionByName(G.statements_frame(org_rows)).unionByName(G.statements_frame(refreshed))
    return Merge(everything, annotations, created, status, G.missing_ids(asked, items))
