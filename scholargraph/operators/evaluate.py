"""Researcher evaluations: profiles, prompts, reply parsing, scores by category and axis."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.ids import dense_index, rank_within, stable_id
from scholargraph.functions.text import fold, is_blank

# The four evaluation categories, the score bands, and the
# fenced-block pattern of a model reply.
CATEGORIES = ["arts", "care", "democratie", "transitions"]
HIGH, MID = 70, 40
FENCE = r"```(?:json)?\s*([\s\S]+?)\s*```"
REPLY_SCHEMA = (
    "evaluations ARRAY<STRUCT<id: STRING, name: STRING, scores: MAP<STRING, STRING>, justification: STRING>>"
)
PROFILE_LIMITS = {"keyword": 20, "publication": 10, "coauthor": 10, "axis": 10}


def profile(values: DataFrame, limits: dict[str, int] = PROFILE_LIMITS) -> DataFrame:
    """Per person and kind, distinct non-empty values in first-seen order, cut.

    ``values(person_id, kind, pos, text)`` where ``text`` is the linked
    item's title or else the literal. Output ``(person_id, kind, items,
    n_distinct)``; ``items`` holds the first ``limits[kind]`` values (a
    ranking window cuts each list before it is gathered).
    """
    v = values.where(~is_blank("text")).groupBy("person_id", "kind", "text").agg(F.min("pos").alias("pos"))
    n = v.groupBy("person_id", "kind").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("person_id", "kind").orderBy("pos", "text")
    # the largest limit bounds the window (a window group limit); each kind's own limit cuts the rest
    own = F.element_at(F.create_map(*[F.lit(x) for kl in limits.items() for x in kl]), F.col("kind"))
    top = v.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= max(limits.values())) & (F.col("_rn") <= own))
    lists = top.groupBy("person_id", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "text"))), lambda s: s["text"]).alias("items")
    )
    return lists.join(n, ["person_id", "kind"])


def text_keywords(docs: DataFrame, id_col: str, text_col: str, min_len: int = 5, limit: int = 20) -> DataFrame:
    """P8 for free text: the first ``limit`` distinct words of at least
    ``min_len`` letters of the whole text, in first-seen order.

    One projection per row: a word is a maximal run of letters/digits of
    the folded text, so ``regexp_extract_all`` of runs of ``min_len`` or
    more gives the long words in order; ``array_distinct`` keeps first
    occurrences. No explode, no shuffle. Output ``(person_id, kind, items,
    n_distinct)`` as ``profile``.
    """
    words = F.array_distinct(F.regexp_extract_all(fold(text_col), F.lit(f"[\\p{{L}}\\p{{N}}]{{{min_len},}}"), 0))
    return docs.select(
        F.col(id_col).alias("person_id"), F.lit("keyword").alias("kind"),
        F.slice(words, 1, limit).alias("items"), F.size(words).alias("n_distinct"),
    ).where(F.col("n_distinct") > 0)


def find_agent(agents: DataFrame, agent_title: str):
    """The id of the agent item with that title, the smallest of several, or
    else the hashed id that it is created under; a lazy scalar.
    ``agents(item_id, title)``."""
    known = agents.where(F.col("title") == agent_title).agg(F.min("item_id").alias("id"))
    return F.coalesce(known.scalar(), stable_id(F.lit("agent"), F.lit(agent_title)))


def split_evaluated(people: DataFrame, evaluations: DataFrame, agent_title: str, agents: DataFrame) -> DataFrame:
    """People already evaluated by the agent (reuse) and pending ones.

    ``evaluations(eval_id, person_id, agent_title)``; ``agents(item_id,
    title)``: the agent items there are, of which the one with this title is
    used, else one is created under an id hashed from the title. Output ``(person_id, status, eval_id, agent_id)``; the smallest
    evaluation id is reused when there are several.
    """
    ev = evaluations.where(F.col("agent_title") == agent_title).groupBy("person_id").agg(F.min("eval_id").alias("eval_id"))
    j = people.select("person_id").distinct().join(ev, "person_id", "left")
    return j.select(
        "person_id",
        F.when(F.col("eval_id").isNotNull(), "reuse").otherwise("pending").alias("status"),
        "eval_id",
        find_agent(agents, agent_title).alias("agent_id"),
    )


def evaluation_prompts(pending: DataFrame, profiles: DataFrame, names: DataFrame, batch_size: int = 50) -> DataFrame:
    """One prompt per pending person, in batches of at most ``batch_size``.

    Parts with no values are left out. Batches follow person id order; the
    numbering is a distributed dense index (no single-task window).
    """
    wide = profiles.groupBy("person_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.array_join("items", ", "))).alias(k) for k in PROFILE_LIMITS]
    )
    p = pending.select("person_id").join(names, "person_id", "left").join(wide, "person_id", "left")

    def part(label: str, c: str) -> Column:
        return F.when(~is_blank(c), F.concat(F.lit(label), F.col(c)))

    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("id: "), F.col("person_id").cast("string")),
        part("name: ", "name"),
        part("keywords: ", "keyword"),
        part("publications: ", "publication"),
        part("co-authors: ", "coauthor"),
    )
    idx = dense_index(p.select("person_id", prompt.alias("prompt")), ["person_id"], "idx")
    return idx.select(F.floor((F.col("idx") - 1) / batch_size).cast("bigint").alias("batch_id"), "person_id", "prompt")


def parse_evaluations(replies: DataFrame) -> DataFrame:
    """Model replies to evaluation rows, or rejects.

    A fenced block is unwrapped; the content must be JSON with a
    non-empty ``evaluations`` list; the first element is taken and the
    person's axes attached. Scores are decimals under whatever keys the reply
    has; a null score counts as absent, one that is no number rejects the
    reply. Output ``(person_id, agent_id, status, eval_id, name, scores
    MAP<STRING, DOUBLE>, score_texts, justification, axes, raw, reason,
    reject_text)``: ``score_texts`` has the scores as written, ``raw`` the
    element's JSON; rejects keep the first 300 characters of the content.
    """
    r = F.col("reply")
    content = F.when(r.rlike(FENCE), F.regexp_extract(r, FENCE, 1)).otherwise(r)
    t = replies.withColumn("_c", content)
    parsed = F.from_json("_c", REPLY_SCHEMA)
    t = t.withColumn("_ok", F.try_parse_json("_c").isNotNull()).withColumn("_e", parsed["evaluations"])
    first = F.get("_e", 0)
    texts = F.map_filter(F.coalesce(first["scores"], F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    t = t.withColumn("_t", texts).withColumn("_s", F.transform_values("_t", lambda k, v: v.try_cast("double")))
    reason = (
        F.when(~F.col("_ok"), "undecodable")
        .when(F.col("_e").isNull(), "no evaluations")
        .when(F.size("_e") == 0, "empty evaluations")
        .when(F.exists(F.map_values("_s"), lambda v: v.isNull()), "undecodable scores")
    )
    good = lambda c: F.when(reason.isNull(), c)
    return t.select(
        "person_id", "agent_id",
        F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"),
        good(first["id"]).alias("eval_id"),
        good(first["name"]).alias("name"),
        good(F.col("_s")).alias("scores"),
        good(F.col("_t")).alias("score_texts"),
        good(first["justification"]).alias("justification"),
        "axes",
        good(F.get_json_object("_c", "$.evaluations[0]")).alias("raw"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.substring("_c", 1, 300)).alias("reject_text"),
    )


def category_scores(evals: DataFrame) -> DataFrame:
    """``(person_id, category, score)``: one row per category that an ok evaluation scores."""
    ok = evals.where(F.col("status") == "ok")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col("scores")[c].alias("score")) for c in CATEGORIES])
    return ok.select("person_id", "name", "axes", F.inline(rows)).where(F.col("score").isNotNull())


# Fixed value: the title of an evaluation item (agent, person, time).
EVALUATION_TITLE = "Evaluation EUR convergences : %s —> %s — %s"


def evaluation_statements(evals: DataFrame, agent_title: str, run_time: str, source_prop: str = "dcterms:source",
                          agent_prop: str = "dcterms:creator") -> DataFrame:
    """An evaluation as long statement rows ``(person_id, property, value, rank)``.

    The title (agent, person's name, ``run_time``), one ``key = score`` row per
    key the reply holds (rank = the score), the justification, the evaluated
    person (source), the agent, and the evaluation's JSON.
    """
    ok = evals.where(F.col("status") == "ok")
    none = F.lit(None).cast("double")

    def row(prop, value, rank=none):
        return F.struct(prop.alias("property"), value.cast("string").alias("value"), rank.alias("rank"))

    title = F.format_string(EVALUATION_TITLE, F.lit(agent_title), F.coalesce("name", F.lit("")), F.lit(run_time))
    scores = F.transform(
        F.map_entries("score_texts"),
        lambda e: row(F.concat(F.lit("eval:"), e["key"]), F.concat_ws(" = ", e["key"], e["value"]), F.col("scores")[e["key"]]),
    )
    others = F.array(
        row(F.lit("dcterms:title"), title),
        row(F.lit("eval:justification"), F.col("justification")),
        row(F.lit(source_prop), F.col("person_id")),
        row(F.lit(agent_prop), F.col("agent_id")),
        row(F.lit("curation:data"), F.col("raw")),
    )
    # one pass: every statement of an evaluation from its one row
    return ok.select("person_id", F.inline(F.concat(others, scores)))


def score_bands(evals: DataFrame) -> DataFrame:
    """High (70+), mid (40+) and low counts per category."""
    cs = category_scores(evals)
    band = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MID, "mid").otherwise("low")
    return cs.groupBy("category", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def axis_rows(evals: DataFrame) -> DataFrame:
    """Evaluations x axes x categories; people with no axis drop out."""
    return category_scores(evals).select("person_id", "name", F.explode("axes").alias("axis"), "category", "score")


def category_axis_scores(evals: DataFrame) -> DataFrame:
    """A5: totals, counts and rounded means per category and per (category, axis).

    One ``GROUPING SETS ((category), (category, axis))`` aggregation.
    ``n_rows`` counts (person, axis) rows, so a person with two axes counts
    twice at category level; ``n_people`` counts distinct people.
    """
    rows = axis_rows(evals)
    g = rows.groupingSets([["category"], ["category", "axis"]], "category", "axis").agg(
        F.sum("score").alias("total"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("person_id").alias("n_people"),
        F.grouping_id().alias("_gid"),
    )
    return g.select(
        "category",
        F.when(F.col("_gid") == 0, F.col("axis")).alias("axis"),
        F.when(F.col("_gid") == 0, "axis").otherwise("category").alias("level"),
        "total", "n_rows", "n_people",
        F.round(F.col("total") / F.col("n_rows")).cast("bigint").alias("mean"),
    )


def top_people(evals: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best people per category by score (ties by person id)."""
    cs = category_scores(evals)
    w = Window.partitionBy("category").orderBy(F.desc("score"), "person_id")
    return cs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("category", "rank", "person_id", "score")


def ranked_in_axis(evals: DataFrame) -> DataFrame:
    """People by score (desc) inside each (category, axis).

    Every person of a group is ranked, so the groups are ranked with the
    distributed ``rank_within`` rather than a window over the whole group.
    """
    r = axis_rows(evals)
    return rank_within(r, ["category", "axis"], [F.col("score").desc(), F.col("person_id").asc()]).select(
        "category", "axis", "rank", "person_id", "score"
    )


def attach_summaries(scores: DataFrame, summaries: DataFrame) -> DataFrame:
    """Left join of the (category, axis) aggregates to their summaries.

    ``summaries(EUR, AXE, score, synthese, forces, recommandations,
    vigilances)``.
    """
    s = summaries.select(
        F.col("EUR").alias("category"), F.col("AXE").alias("axis"), F.col("score").alias("summary_score"),
        "synthese", "forces", "recommandations", "vigilances",
    )
    return scores.where(F.col("level") == "axis").join(s, ["category", "axis"], "left")


SECTION_FORMAT = "## %s / %s\n\nTotal %.1f, rows %d, people %d, mean %d/100\n\n%s"
CATEGORY_FORMAT = "# %s\n\nTotal %.1f, rows %d, people %d, mean %d/100"


def report_sections(scores: DataFrame, with_summaries: DataFrame) -> DataFrame:
    """One Markdown section per category and per (category, axis).

    Output ``(category, axis, section)``; ``write_report`` writes them
    in (category, axis) order.
    """
    cat = scores.where(F.col("level") == "category").select(
        "category", F.lit(None).cast("string").alias("axis"),
        F.format_string(CATEGORY_FORMAT, "category", "total", "n_rows", "n_people", "mean").alias("section"),
    )
    ax = with_summaries.select(
        "category", "axis",
        F.format_string(SECTION_FORMAT, "category", "axis", "total", "n_rows", "n_people", "mean",
                        F.coalesce("synthese", F.lit("No summary."))).alias("section"),
    )
    return cat.unionByName(ax)
