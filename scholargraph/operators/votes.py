"""Expertise votes: last ranks, first links, scoreboards, permissions, change logs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.ids import rank_within
from scholargraph.functions.joins import bounded_broadcast
from scholargraph.operators.vote_log import replay
from scholargraph.session import cut_lineage

# Roles that may edit every person, and the editing roles.
ADMIN_ROLES = ("global_admin", "site_admin")
REVIEWER = "reviewer"
AUTHOR = "author"


def last_rank(vote_ranks: DataFrame) -> DataFrame:
    """A vote's rank is the last of its rank values.

    ``vote_ranks(vote_id, person_id, concept_id, owner_id, rank, seq)``
    -> one row per vote with ``rank`` = value at the greatest ``seq``.
    """
    return vote_ranks.groupBy("vote_id").agg(
        F.max_by(F.struct("person_id", "concept_id", "owner_id", "rank"), "seq").alias("_v")
    ).select("vote_id", "_v.*")


def first_link(links: DataFrame, props: list[str]) -> DataFrame:
    """The first property linking each concept to a person.

    ``links(person_id, concept_id, property, pos, rank)``; properties are
    tried in the order of ``props`` (others ignored), then by position;
    later links of the same concept are ignored.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in props]), F.col("property"))
    lk = links.where(order > 0).withColumn("_o", F.struct(order.alias("o"), F.col("pos").alias("p")))
    return lk.groupBy("person_id", "concept_id").agg(
        F.min_by(F.struct("property", F.col("rank").alias("base_rank")), "_o").alias("_l")
    ).select("person_id", "concept_id", "_l.property", "_l.base_rank")


def scoreboard(first_links: DataFrame, votes: DataFrame, evaluator_id: int, allowed: DataFrame) -> DataFrame:
    """A3: per linked (person, concept), the summed expertise.

    ``first_links(person_id, concept_id, property, base_rank)`` from W3;
    ``votes(vote_id, person_id, concept_id, owner_id, rank)`` from W2;
    ``allowed(person_id)``: persons the evaluator may edit (F14). The base
    rank of the link counts as one more vote (owner 0) when it is not 0.
    Output adds ``rank_sum``, ``cls`` (pos/neg), ``sign``, ``n_votes``,
    ``has_mine``, ``my_rank`` and ``slot`` (1 when the evaluator has no
    vote yet but may add one). Votes of concepts that are not linked are
    ignored. One aggregation keyed by (person, concept), partial on the
    map side.
    """
    first_links = cut_lineage(first_links, "first-links")  # read three times below
    base = first_links.where(F.coalesce(F.col("base_rank"), F.lit(0)) != 0).select(
        "person_id", "concept_id", F.lit(-1).cast("bigint").alias("vote_id"), F.lit(0).cast("bigint").alias("owner_id"),
        F.col("base_rank").cast("bigint").alias("rank"),
    )
    v = votes.select("person_id", "concept_id", "vote_id", F.col("owner_id").cast("bigint"), F.col("rank").cast("bigint"))
    v = v.join(first_links.select("person_id", "concept_id"), ["person_id", "concept_id"], "left_semi").unionByName(base)
    mine = F.col("owner_id") == F.lit(evaluator_id)
    agg = v.groupBy("person_id", "concept_id").agg(
        F.sum("rank").alias("rank_sum"),
        F.count(F.lit(1)).alias("n_votes"),
        F.max(mine.cast("int")).alias("has_mine"),
        F.min_by("rank", F.when(mine, F.col("vote_id"))).alias("my_rank"),
    )
    al = allowed.select("person_id").distinct().withColumn("_allowed", F.lit(1))
    j = first_links.join(agg, ["person_id", "concept_id"], "left").join(al, "person_id", "left")
    rs = F.coalesce("rank_sum", F.lit(0))
    hm = F.coalesce("has_mine", F.lit(0))
    return j.select(
        "person_id", "concept_id", "property", "base_rank",
        rs.alias("rank_sum"),
        F.when(rs > 0, "pos").otherwise("neg").alias("cls"),
        F.when(rs > 0, "+").otherwise("").alias("sign"),
        F.coalesce("n_votes", F.lit(0)).alias("n_votes"),
        hm.alias("has_mine"),
        F.coalesce("my_rank", F.lit(0)).alias("my_rank"),
        F.when((hm == 0) & F.col("_allowed").isNotNull(), 1).otherwise(0).alias("slot"),
    )


STATUSES = ("all", "todo", "done", "pos", "neg")


def filter_scoreboard(board: DataFrame, titles: DataFrame, text: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """visible and total keyword counts per person for a text and each
    status: ``all``, ``todo`` (no vote of mine), ``done``, ``pos`` (rank > 0)
    or ``neg``. ``titles(concept_id, title)``. Conditional sums of one
    aggregation, one row per (person, status).
    """
    t = text.strip().lower()
    b = board.join(titles, "concept_id", "left")
    match_text = F.lit(True) if not t else F.lower(F.coalesce("title", F.lit(""))).contains(t)
    match_status = {
        "all": F.lit(True),
        "todo": F.col("has_mine") == 0,
        "done": F.col("has_mine") == 1,
        "pos": F.col("rank_sum") > 0,
        "neg": F.col("rank_sum") <= 0,
    }
    counts = b.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.sum((match_text & match_status[st]).cast("int")).alias(f"_{st}") for st in statuses],
    )
    rows = F.array(*[F.struct(F.col(f"_{st}").alias("n_visible"), F.lit(st).alias("status")) for st in statuses])
    return counts.select("person_id", "n_total", F.inline(rows))


def sort_scoreboard(board: DataFrame, titles: DataFrame, by: str = "title", ascending: bool = True,
                    collation: str = "fr") -> DataFrame:
    """Position of each keyword in a person's list, by title (locale
    collation) or by summed rank, in either direction; ties by concept id.
    Ranked by one global sort, so a long list is not one task's."""
    b = board.join(titles, "concept_id", "left")
    key = F.collate(F.coalesce("title", F.lit("")), collation) if by == "title" else F.col("rank_sum")
    key = key.asc() if ascending else key.desc()
    return rank_within(b, ["person_id"], [key, F.col("concept_id").asc()], "position")


# ------------------------------------------------------------- F14 access


def access_rules(users: DataFrame, persons: DataFrame) -> DataFrame:
    """who may edit whom, as compact rules ``(user_id, scope, lab_id, person_id)``.

    ``users(user_id, name, role, labs ARRAY<BIGINT>)``; ``persons
    (person_id, account)``. Admins get one ``all`` rule (not one row per
    person), reviewers one ``lab`` rule per lab they manage, authors a
    ``person`` rule for the person whose account is their name; other
    roles none. ``can_edit`` evaluates pairs against these rules.
    """
    nb = F.lit(None).cast("bigint")
    admins = users.where(F.col("role").isin(*ADMIN_ROLES)).select("user_id", F.lit("all").alias("scope"), nb.alias("lab_id"), nb.alias("person_id"))
    labs = users.where(F.col("role") == REVIEWER).select(
        "user_id", F.lit("lab").alias("scope"), F.explode(F.transform("labs", lambda x: x.cast("bigint"))).alias("lab_id"), nb.alias("person_id")
    ).distinct()
    authors = users.where(F.col("role") == AUTHOR).select("user_id", "name").join(
        persons.select("person_id", F.col("account").alias("name")), "name"
    ).select("user_id", F.lit("person").alias("scope"), nb.alias("lab_id"), F.col("person_id").cast("bigint"))
    return admins.unionByName(labs).unionByName(authors)


def can_edit(pairs: DataFrame, rules: DataFrame, person_labs: DataFrame) -> DataFrame:
    """Keep the ``(user_id, person_id, ...)`` rows the rules allow.

    ``person_labs(person_id, lab_id)``: the labs a person is part of.
    Three semi joins: admin users, (user, lab) of the person, and
    (user, person) author rules.
    """
    up = pairs.select("user_id", "person_id").distinct()
    admins = rules.where(F.col("scope") == "all").select("user_id").distinct()
    by_admin = up.join(bounded_broadcast(admins), "user_id", "left_semi")
    lab_rules = rules.where(F.col("scope") == "lab").select("user_id", "lab_id")
    by_lab = (
        up.join(person_labs.select("person_id", F.col("lab_id").cast("bigint")), "person_id")
        .join(lab_rules, ["user_id", "lab_id"], "left_semi")
        .select("user_id", "person_id")
    )
    own = rules.where(F.col("scope") == "person").select("user_id", "person_id")
    by_own = up.join(own, ["user_id", "person_id"], "left_semi")
    allowed = by_admin.unionByName(by_lab).unionByName(by_own).distinct()
    return pairs.join(allowed, ["user_id", "person_id"], "left_semi")


def editable_persons(rules: DataFrame, person_labs: DataFrame, persons: DataFrame, user_id: int) -> DataFrame:
    """``(person_id)`` one user may edit: everyone of ``persons`` (with or
    without a lab) if the user has an ``all`` rule (an uncorrelated EXISTS
    subquery, not a join), members of the user's labs (semi join on lab), and
    the user's own persons."""
    r = rules.where(F.col("user_id") == F.lit(user_id))
    is_admin = r.where(F.col("scope") == "all").exists()
    everyone = persons.where(is_admin).select("person_id")
    by_lab = person_labs.join(r.where(F.col("scope") == "lab").select("lab_id"), "lab_id", "left_semi").select("person_id")
    own = r.where(F.col("scope") == "person").select("person_id")
    return everyone.unionByName(by_lab).unionByName(own).distinct()


# ------------------------------------------------------------- C1 changes


# The titles of a created and of an updated vote.
CREATED_TITLE = "Expertise - %s = %d - pour %s fait par %s le %s"
UPDATED_TITLE = "Expertise -> %s = %d - pour %s fait par %s le %s"


def vote_changes(votes: DataFrame, changes: DataFrame, rules: DataFrame, person_labs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a create/update/delete change log does to a vote table.

    ``votes(vote_id, person_id, concept_id, rank, owner_id)``;
    ``changes(op, vote_id, person_id, concept_id, rank, user_id, day, seq)``.

    * A create needs the right to edit its person and an id that no vote has
      then; its user owns the vote.
    * An update or a delete needs a vote that is stored or was created before
      it; rights are tested on that vote's person, whatever person the change
      names. An update sets the rank, and nothing else; a deleted vote is gone,
      until its id is created again.

    Changes take effect one after another, in order of ``seq``: what a change
    meets is the vote as it stands then. Stored votes may bring ``kind``,
    ``user_id`` and ``day`` of an earlier change.

    Returns ``(decided, errors)``: ``decided(vote_id, person_id, concept_id,
    rank, owner_id, kind, user_id, day)`` has every vote left, ``kind`` null
    for untouched ones, else ``create`` or ``update`` with the user and day of
    its last change; ``errors(vote_id, op, seq, user_id, reason)`` the changes
    without effect: ``unknown vote`` (none stands), ``not allowed`` or ``vote
    exists``.
    """
    return replay(votes, changes, rules, person_labs)


def with_vote_titles(decided: DataFrame, concepts: DataFrame, persons: DataFrame, users: DataFrame) -> DataFrame:
    """Titles of changed votes, with the names of concept, person and user and
    the day; null for untouched votes, whose stored title stays.
    ``concepts(concept_id, concept)``, ``persons(person_id, person)``,
    ``users(user_id, name)``."""
    j = decided.join(concepts, "concept_id", "left").join(persons, "person_id", "left").join(users.select("user_id", "name"), "user_id", "left")
    parts = [F.coalesce("concept", F.lit("")), F.col("rank"), F.coalesce("person", F.lit("")), F.coalesce("name", F.lit("")), F.col("day")]
    title = F.when(F.col("kind") == "create", F.format_string(CREATED_TITLE, *parts)).when(
        F.col("kind") == "update", F.format_string(UPDATED_TITLE, *parts)
    )
    return j.select(*decided.columns, title.alias("title"))


def vote_list(board: DataFrame, votes: DataFrame, users: DataFrame, evaluator_id: int) -> DataFrame:
    """A3: the votes shown under each linked (person, concept), in long form.

    ``board`` from ``scoreboard``; ``votes(vote_id, person_id, concept_id,
    owner_id, rank, created)``. Rows: every vote of a linked concept, the
    link's own rank as a vote of owner 0 where it is not 0, and an empty one
    (id null, rank 0, ``pos``) where the evaluator may add theirs. Output
    ``(person_id, concept_id, vote_id, owner_id, owner_name, created, rank,
    cls, sign)``; ``created`` is text, ``-`` when unknown.
    """
    key = ["person_id", "concept_id"]
    nb = F.lit(None).cast("bigint")
    given = votes.join(board.select(*key), key, "left_semi").select(
        *key, "vote_id", F.col("owner_id").cast("bigint"), F.coalesce("created", F.lit("-")).alias("created"), F.col("rank").cast("bigint")
    )
    linked = board.where(F.coalesce("base_rank", F.lit(0)) != 0).select(
        *key, nb.alias("vote_id"), F.lit(0).cast("bigint").alias("owner_id"), F.lit("-").alias("created"), F.col("base_rank").cast("bigint").alias("rank")
    )
    shown = given.unionByName(linked).withColumn("cls", F.when(F.col("rank") > 0, "pos").otherwise("neg"))
    slot = board.where(F.col("slot") == 1).select(
        *key, nb.alias("vote_id"), F.lit(evaluator_id).cast("bigint").alias("owner_id"), F.lit("-").alias("created"),
        F.lit(0).cast("bigint").alias("rank"), F.lit("pos").alias("cls"),
    )
    names = users.select(F.col("user_id").cast("bigint").alias("owner_id"), F.col("name").alias("owner_name"))
    out = shown.unionByName(slot).withColumn("sign", F.when(F.col("rank") > 0, "+").otherwise(""))
    return out.join(names, "owner_id", "left").select(*key, "vote_id", "owner_id", "owner_name", "created", "rank", "cls", "sign")
