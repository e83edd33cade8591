"""Graph operators over ``items`` and ``statements`` (entity-attribute-value rows).

F10 filters, J1-J4 entity resolution (find or create), J6 statement
merges, J12/J14 set differences, P3 person statements, P7 addresses,
J15 organisation cards.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.ids import stable_id
from scholargraph.functions.text import fold, is_blank, php_empty, strip_ws

# Property terms of the vocabulary used by the graph.
TITLE = "dcterms:title"
FIRST_NAME = "foaf:firstName"
FAMILY_NAME = "foaf:familyName"
IDENTIFIER = "dcterms:identifier"
REFERENCED_BY = "dcterms:isReferencedBy"
PREF_LABEL = "skos:prefLabel"
TYPE = "dcterms:type"
WIKIDATA_URL = "https://www.wikidata.org/wiki/"
DOCTORAL_PREFIX = "ED"
DOCTORAL_TYPE = "Ecole doctorale"
STREET = "schema:address"
POSTCODE = "schema:postalCode"
TOWN = "schema:addressLocality"

STATEMENT_COLS = ["item_id", "property", "type", "value", "uri", "label", "target_id"]


def statements_frame(df: DataFrame) -> DataFrame:
    """Fill missing statement columns with typed nulls, in canonical order."""
    types = {"item_id": "bigint", "target_id": "bigint"}
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in STATEMENT_COLS]
    )


# ------------------------------------------------------------- F10 filter


@dataclass
class Predicate:
    """One property predicate: ``eq``, ``contains``, ``links_to`` or ``exists``.

    ``links_to`` takes either ``value`` (one item id) or ``targets`` (a
    DataFrame of ``item_id``s).
    """

    property: str
    op: str
    value: object = None
    targets: DataFrame | None = field(default=None, repr=False)


def _predicate_items(statements: DataFrame, p: Predicate) -> DataFrame:
    s = statements.where(F.col("property") == p.property)
    if p.op == "eq":
        s = s.where(F.col("value") == F.lit(p.value))
    elif p.op == "contains":
        s = s.where(F.lower("value").contains(F.lower(F.lit(p.value))))
    elif p.op == "links_to":
        s = s.where(F.col("target_id").isNotNull())
        if p.targets is not None:
            s = s.join(p.targets.select(F.col("item_id").alias("target_id")), "target_id", "left_semi")
        else:
            s = s.where(F.col("target_id") == F.lit(p.value))
    elif p.op != "exists":
        raise ValueError(f"unknown predicate {p.op!r}")
    return s.select("item_id")


def filter_items(items: DataFrame, statements: DataFrame, predicates: list[Predicate],
                 cls: str | None = None, template: str | None = None) -> DataFrame:
    """items satisfying every predicate (AND), optionally of a class/template.

    Each predicate is a filter on ``statements`` (pushed to the scan)
    followed by a semi join on ``item_id``; no predicate materialises
    item x statement pairs.
    """
    out = items
    if cls is not None:
        out = out.where(F.col("class") == cls)
    if template is not None:
        out = out.where(F.col("template") == template)
    for p in predicates:
        out = out.join(_predicate_items(statements, p), "item_id", "left_semi")
    return out


# ---------------------------------------------------------- J1 by name


def match_items_by_name(persons: DataFrame, statements: DataFrame, prop: str = TITLE,
                        person_id: str = "id", name_col: str = "fullName") -> DataFrame:
    """The smallest item whose ``prop`` value equals the person's full name.

    Case- and accent-insensitive (folded) equality; an equi-join on the
    folded key. Output ``(person_id, item_id)``; ``item_id`` null when none.
    """
    vals = (
        statements.where(F.col("property") == prop)
        .select(fold("value").alias("_k"), "item_id")
        .groupBy("_k")
        .agg(F.min("item_id").alias("item_id"))
    )
    p = persons.select(F.col(person_id).alias("person_id"), fold(name_col).alias("_k"))
    return p.join(vals, "_k", "left").select("person_id", "item_id")


# -------------------------------------------------------- J2 concepts


def concept_key(tags: DataFrame) -> DataFrame:
    """The lookup key of a domain tag, by tier: Wikidata URI, else
    ``type_code``, else the preferred label. A null type is the label tier."""
    t = F.col("type")
    code = F.col("code")
    kind = (
        F.when(t == "wikidata", F.lit("uri"))
        .when(code.isNotNull() & t.isNotNull(), F.lit("value"))
        .otherwise(F.lit("label"))
    )
    key = (
        F.when(t == "wikidata", F.concat(F.lit(WIKIDATA_URL), code))
        .when(code.isNotNull() & t.isNotNull(), F.concat(t, F.lit("_"), code))
        .otherwise(F.col("label"))
    )
    return tags.withColumn("kind", kind).withColumn("key", key)


def _row(prop: str, typ: str, value: Column, uri: Column, label: Column) -> Column:
    """One statement as a struct with fixed field names (for ``inline``)."""
    return F.struct(
        F.lit(prop).alias("property"), F.lit(typ).alias("type"), value.cast("string").alias("value"),
        uri.cast("string").alias("uri"), label.cast("string").alias("label"),
    )


def _statement_keys(statements: DataFrame) -> DataFrame:
    """``(kind, key, item_id)`` for every statement usable as a concept key."""
    ref = statements.where(F.col("property") == REFERENCED_BY)
    by_uri = ref.where(F.col("uri").isNotNull()).select(F.lit("uri").alias("kind"), F.col("uri").alias("key"), "item_id")
    by_val = ref.where(F.col("value").isNotNull()).select(F.lit("value").alias("kind"), F.col("value").alias("key"), "item_id")
    by_lab = statements.where(F.col("property") == PREF_LABEL).select(
        F.lit("label").alias("kind"), F.col("value").alias("key"), "item_id"
    )
    return by_uri.unionByName(by_val).unionByName(by_lab)


def resolve_concepts(tags: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find or create one concept item per distinct tag key.

    ``tags(label, code, type)``. Returns ``(resolved, new_statements)``:
    ``resolved(kind, key, label, item_id, status)`` with status ``found``
    (smallest matching item) or ``created`` (id hashed from the key, so
    two people creating the same concept get one item and re-runs agree);
    ``new_statements`` holds title, preferred label and references of the
    created items.
    """
    k = concept_key(tags).where(F.col("key").isNotNull())
    keys = k.groupBy("kind", "key").agg(
        F.min_by(F.struct("label", "code", "type"), F.struct("label", "code", "type")).alias("_t")
    )
    found = _statement_keys(statements).join(keys.select("kind", "key"), ["kind", "key"], "left_semi").groupBy(
        "kind", "key"
    ).agg(F.min("item_id").alias("found_id"))
    r = keys.join(found, ["kind", "key"], "left")
    resolved = r.select(
        "kind", "key", F.col("_t.label").alias("label"),
        F.coalesce("found_id", stable_id("kind", "key")).alias("item_id"),
        F.when(F.col("found_id").isNotNull(), "found").otherwise("created").alias("status"),
        F.col("_t.code").alias("code"), F.col("_t.type").alias("type"),
    )
    c = resolved.where(F.col("status") == "created")
    nul = F.lit(None).cast("string")
    has_code = F.col("code").isNotNull() & F.col("type").isNotNull()
    rows = F.array(
        _row(TITLE, "literal", F.col("label"), nul, nul),
        _row(PREF_LABEL, "literal", F.col("label"), nul, nul),
        _row(REFERENCED_BY, "uri", nul, F.when(F.col("type") == "wikidata", F.concat(F.lit(WIKIDATA_URL), F.col("code"))), F.lit("wikidata")),
        _row(REFERENCED_BY, "literal", F.when(has_code, F.concat(F.col("type"), F.lit("_"), F.col("code"))), nul, nul),
    )
    new = c.select("item_id", F.inline(rows)).where(F.col("value").isNotNull() | F.col("uri").isNotNull())
    return resolved.drop("code", "type"), statements_frame(new)


# ------------------------------------------------------------- J3 orgs


def org_type(structure_id: Column, kinds: Column) -> Column:
    """Doctoral schools by id prefix, else the first kind, else ``no``."""
    return (
        F.when(structure_id.startswith(DOCTORAL_PREFIX), F.lit(DOCTORAL_TYPE))
        .otherwise(F.coalesce(F.get(kinds, 0), F.lit("no")))
    )


def resolve_orgs(structures: DataFrame, statements: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The oldest organisation item whose reference starts with the structure id.

    ``structures(structure_id, label, kinds)``. The prefix test (``LIKE
    'id%'``, wildcards literal) is an equi-join: each stored reference is
    cut to every distinct structure-id length of the batch (a short list
    read from the batch) and joined on equality. ``exact=True`` asks for
    equal references. Oldest is the smallest ``value_id`` where statements
    have one, else the smallest item. Label and kinds come from one record.
    Returns ``(resolved, new_statements)`` as J2.
    """
    s = structures.where(F.col("structure_id").isNotNull()).groupBy("structure_id").agg(
        F.min(F.struct("label", "kinds")).alias("_r")
    ).select("structure_id", "_r.label", "_r.kinds")
    age = F.col("value_id") if "value_id" in statements.columns else F.col("item_id")
    refs = statements.where((F.col("property") == REFERENCED_BY) & F.col("value").isNotNull()).select("item_id", "value", age.alias("_age"))
    if exact:
        cut = refs.select("item_id", "_age", F.col("value").alias("structure_id"))
    else:
        lens = [r[0] for r in s.select(F.length("structure_id")).distinct().collect()]
        if not lens:
            lens = [0]
        arr = F.array(*[F.lit(n) for n in sorted(lens)])
        cut = refs.select(
            "item_id",
            "_age",
            F.explode(F.transform(F.filter(arr, lambda n: n <= F.length("value")), lambda n: F.substring("value", 1, n))).alias("structure_id"),
        )
    found = cut.join(s.select("structure_id"), "structure_id", "left_semi").groupBy("structure_id").agg(
        F.min_by("item_id", F.struct("_age", "item_id")).alias("found_id")
    )
    r = s.join(found, "structure_id", "left")
    resolved = r.select(
        "structure_id", "label",
        F.coalesce("found_id", stable_id(F.lit("org"), F.col("structure_id"))).alias("item_id"),
        F.when(F.col("found_id").isNotNull(), "found").otherwise("created").alias("status"),
        org_type(F.col("structure_id"), F.col("kinds")).alias("org_type"),
    )
    c = resolved.where(F.col("status") == "created")
    nul = F.lit(None).cast("string")
    rows = F.array(
        _row(TITLE, "literal", F.col("label"), nul, nul),
        _row(TYPE, "literal", F.col("org_type"), nul, nul),
        _row(REFERENCED_BY, "literal", F.col("structure_id"), nul, nul),
    )
    new = c.select("item_id", F.inline(rows))
    return resolved, statements_frame(new)


# -------------------------------------------------------- J4 co-authors


def resolve_coauthors(co: DataFrame, persons: DataFrame, statements: DataFrame) -> DataFrame:
    """Each co-contributor id to an item, a creation, or unknown.

    ``co(person_id, coauthor_id)``; ``persons(id, fullName)`` is the
    person table. Known co-authors matched by name (J1) are ``linked``;
    known ones without an item are ``to_create`` (from their own record,
    no further recursion); ids missing from the table are ``unknown``.
    """
    ids = co.select(F.col("coauthor_id").alias("id")).distinct()
    known = persons.join(ids, "id", "left_semi").groupBy("id").agg(F.min("fullName").alias("fullName"))
    m = match_items_by_name(known, statements).withColumnRenamed("person_id", "coauthor_id")
    k = known.select(F.col("id").alias("coauthor_id"), F.lit(True).alias("_known"))
    j = co.select("person_id", "coauthor_id").distinct().join(k, "coauthor_id", "left").join(m, "coauthor_id", "left")
    status = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("item_id").isNotNull(), "linked")
        .otherwise("to_create")
    )
    return j.select("person_id", "coauthor_id", status.alias("status"), "item_id")


# -------------------------------------------------------------- J6 merge


def _cmp_key() -> Column:
    return F.when(F.col("type") == "uri", F.concat(F.lit("u:"), F.coalesce("uri", F.lit("")))).otherwise(
        F.concat(F.lit("v:"), F.coalesce("value", F.lit("")))
    )


def merge_statements(existing: DataFrame, new: DataFrame, mode: str = "replace") -> DataFrame:
    """Merge new statements into existing ones.

    ``replace``: new values replace all values of the same (item,
    property). ``append_distinct``: a new value is added unless the item
    already has an equal one for that property (URIs compared by URI,
    others by text); repeated new values are added once. ``append``: all
    are added. Keyed anti joins and a union; idempotent for the first two.
    """
    e = statements_frame(existing)
    n = statements_frame(new)
    if mode == "replace":
        return e.join(n.select("item_id", "property").distinct(), ["item_id", "property"], "left_anti").unionByName(n)
    if mode == "append":
        return e.unionByName(n)
    if mode != "append_distinct":
        raise ValueError(f"unknown mode {mode!r}")
    ek = e.select("item_id", "property", _cmp_key().alias("_k")).distinct()
    nk = n.withColumn("_k", _cmp_key())
    nk = nk.groupBy("item_id", "property", "_k").agg(F.min(F.struct(*[c for c in STATEMENT_COLS if c not in ("item_id", "property")])).alias("_s"))
    nk = nk.select("item_id", "property", "_k", "_s.*")
    add = nk.join(ek, ["item_id", "property", "_k"], "left_anti").drop("_k")
    return e.unionByName(statements_frame(add))


# --------------------------------------------------- P3 person statements


def person_statements(persons: DataFrame, existing: DataFrame, id_prefix: str = "person:") -> DataFrame:
    """Statements of a canonical person for its item.

    ``persons(item_id, person)``. Title, first name, family name and the
    prefixed identifier are emitted only if non-empty and the item has no
    value for that property yet; every external id becomes a URI statement
    labelled ``type:id`` (merged with ``replace``).
    """
    p = F.col("person")
    lit_null = F.lit(None).cast("string")
    scalars = F.array(
        F.struct(F.lit(TITLE).alias("property"), p["fullName"].alias("value")),
        F.struct(F.lit(FIRST_NAME).alias("property"), p["firstName"].alias("value")),
        F.struct(F.lit(FAMILY_NAME).alias("property"), p["lastName"].alias("value")),
        F.struct(F.lit(IDENTIFIER).alias("property"), F.when(~php_empty(p["id"]), F.concat(F.lit(id_prefix), p["id"])).alias("value")),
    )
    sc = persons.select("item_id", F.inline(scalars)).where(~php_empty("value"))
    sc = sc.join(existing.select("item_id", "property").distinct(), ["item_id", "property"], "left_anti")
    sc = sc.select("item_id", "property", F.lit("literal").alias("type"), "value", lit_null.alias("uri"), lit_null.alias("label"))
    ext = persons.select("item_id", F.explode(p["externalIds"]).alias("x")).select(
        "item_id", F.lit(REFERENCED_BY).alias("property"), F.lit("uri").alias("type"), lit_null.alias("value"),
        F.col("x.url").alias("uri"), F.concat(F.col("x.type"), F.lit(":"), F.col("x.id")).alias("label"),
    )
    return statements_frame(sc.unionByName(ext))


# ---------------------------------------------------- J12 link keywords


def link_keywords(existing_links: DataFrame, requested: DataFrame, props: list[str]) -> DataFrame:
    """Add (person, concept) links not yet present through any keyword property.

    ``existing_links(person_id, concept_id, property)``; ``requested
    (person_id, concept_id)``. Output ``(person_id, concept_id, status)``:
    ``added`` once per new pair, ``duplicate`` for pairs already linked; a
    pair with a null is equal to none. One aggregate over both: a task holds
    one row per pair, once.
    """
    have = existing_links.where(F.col("property").isin(props)).select("person_id", "concept_id", F.lit(False).alias("_asked"))
    req = requested.select("person_id", "concept_id", F.lit(True).alias("_asked"))
    pairs = req.unionByName(have).groupBy("person_id", "concept_id").agg(F.max("_asked").alias("_asked"), F.min("_asked").alias("_new"))
    new = F.col("_new") | F.col("person_id").isNull() | F.col("concept_id").isNull()
    return pairs.where("_asked").select("person_id", "concept_id", F.when(new, "added").otherwise("duplicate").alias("status"))


# --------------------------------------------------------- P7 addresses


def pivot_values(statements: DataFrame, props: dict[str, str]) -> DataFrame:
    """One row per item with the first (smallest) value of each property as a column."""
    s = statements.where(F.col("property").isin(list(props)))
    aggs = [F.min(F.when(F.col("property") == p, F.col("value"))).alias(name) for p, name in props.items()]
    return s.groupBy("item_id").agg(*aggs)


def join_address(*parts) -> Column:
    """Non-blank parts joined with ", " (null and blank parts are dropped)."""
    cleaned = [F.when(~is_blank(p), strip_ws(p)) for p in parts]
    return F.nullif(F.concat_ws(", ", *cleaned), F.lit(""))


def postal_address(statements: DataFrame) -> DataFrame:
    """``(item_id, street, postcode, town, address)`` per item."""
    p = pivot_values(statements, {STREET: "street", POSTCODE: "postcode", TOWN: "town"})
    return p.withColumn("address", join_address("street", "postcode", "town"))


# ----------------------------------------------------------- J15 cards


def org_cards(orgs: DataFrame, statements: DataFrame, points: DataFrame, members: DataFrame,
              persons: DataFrame, n_members: int = 20) -> DataFrame:
    """The card of every organisation that has a point.

    ``orgs(item_id, title)``, ``points(item_id, lat, lng)``,
    ``members(org_id, person_id)`` (reverse ``member`` links),
    ``persons(item_id, title)``. Members are counted in full; their
    titles and ids are listed for the first ``n_members`` by title, cut
    by a ranking window before they are gathered.
    """
    props = {"foaf:surname": "acronym", "dcterms:created": "created", "foaf:workplaceHomepage": "site_web"}
    p = pivot_values(statements.withColumn("value", F.coalesce("value", "uri")), props)
    addr = postal_address(statements).select("item_id", "address")
    m = members.select("org_id", "person_id").distinct().join(
        persons.select(F.col("item_id").alias("person_id"), F.col("title").alias("member_title")), "person_id"
    )
    cnt = m.groupBy("org_id").agg(F.count(F.lit(1)).alias("n_members"))
    w = Window.partitionBy("org_id").orderBy("member_title", "person_id")
    top = m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_members)
    lists = top.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "member_title", "person_id"))).alias("_m"))
    lists = lists.select(
        F.col("org_id").alias("item_id"),
        F.transform("_m", lambda x: x["member_title"]).alias("members"),
        F.transform("_m", lambda x: x["person_id"]).alias("member_ids"),
    )
    located = orgs.join(points.select("item_id", "lat", "lng"), "item_id")
    return (
        located.join(p, "item_id", "left")
        .join(addr, "item_id", "left")
        .join(cnt.withColumnRenamed("org_id", "item_id"), "item_id", "left")
        .join(lists, "item_id", "left")
        .withColumn("n_members", F.coalesce("n_members", F.lit(0)))
    )


def missing_ids(requested: DataFrame, existing: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Distinct requested ids with no existing row."""
    return requested.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(
        existing.select(id_col), id_col, "left_anti"
    )
