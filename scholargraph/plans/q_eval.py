"""Evaluation queries: documents as researchers, labels as model replies.

Bindings: each document is a researcher (keywords from the whole text,
axes = language and source); labels are the agent's existing evaluations
(J11) and, rebuilt as model replies (fenced or plain, some cut, without an
``evaluations`` list or with an empty one), the input of E2-E4, A5, W4, W5;
summaries per (category, language) come from document counts.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from scholargraph.functions.ids import stable_id
from scholargraph.operators import evaluate as EV
from scholargraph.plans.registry import register, table
from scholargraph.plans.sqltext import toks_sql

AGENT = "model-a"
MIN_KEYWORD = 5


def _hash_sql(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


AGENT_ID_SQL = _hash_sql(f"'agent' || chr(1) || '{AGENT}'")


def people(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("person_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"))


def axis_values(spark, sf):
    """Axes of each document's author: language, then source."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("person_id"), F.inline(F.array(
        F.struct(F.lit(1).alias("pos"), F.col("lang").alias("text")), F.struct(F.lit(2).alias("pos"), F.col("source").alias("text"))
    ))).withColumn("kind", F.lit("axis"))


def profiles(spark, sf, only=None):
    """Keywords: distinct words of 5+ letters over the whole text (first 20); axes.

    ``only(person_id)`` restricts the (costly) per-text work to those people.
    """
    docs = table(spark, sf, "documents")
    if only is not None:
        docs = docs.join(only.select(F.col("person_id").alias("doc_id")), "doc_id", "left_semi")
    kw = EV.text_keywords(docs, "doc_id", "text", MIN_KEYWORD, 20)
    ax = axis_values(spark, sf)
    if only is not None:
        ax = ax.join(only.select("person_id"), "person_id", "left_semi")
    return kw.unionByName(EV.profile(ax))


PROFILE_SQL = f"""
  WITH d AS (SELECT doc_id, {toks_sql('text')} AS toks, lang, source FROM documents),
  kw AS (SELECT doc_id AS person_id, 'keyword' AS kind, tok AS text, min(pos) AS pos
         FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM d)
         WHERE length(tok) >= {MIN_KEYWORD} GROUP BY 1, 2, 3),
  ax AS (SELECT person_id, kind, text, min(pos) AS pos FROM (
           SELECT doc_id AS person_id, 'axis' AS kind, lang AS text, 1 AS pos FROM documents
           UNION ALL SELECT doc_id, 'axis', source, 2 FROM documents) WHERE trim(text) <> '' GROUP BY 1, 2, 3),
  v AS (SELECT * FROM kw UNION ALL SELECT * FROM ax),
  r AS (SELECT *, row_number() OVER (PARTITION BY person_id, kind ORDER BY pos, text) AS rn FROM v)
  SELECT person_id, kind,
         string_agg(text, ', ' ORDER BY rn) FILTER (WHERE rn <= CASE kind WHEN 'keyword' THEN 20 ELSE 10 END) AS items,
         CAST(count(*) AS BIGINT) AS n_distinct
  FROM r GROUP BY 1, 2
"""


@register("P8_profile", PROFILE_SQL)
def q_profile(spark, sf):
    """First 20 distinct keywords (whole text) and the axes of every document's author."""
    return profiles(spark, sf).select("person_id", "kind", F.array_join("items", ", ").alias("items"), "n_distinct")


def evaluations(spark, sf):
    lb = table(spark, sf, "labels")
    return lb.select((F.col("doc_id") * 10 + 7).alias("eval_id"), F.col("doc_id").alias("person_id"), F.lit(AGENT).alias("agent_title"))


def split(spark, sf):
    return EV.split_evaluated(people(spark, sf), evaluations(spark, sf), AGENT, agents(spark, sf))


def agents(spark, sf):
    """Agent items: one per supplier nation, the agent's own title among them."""
    n = table(spark, sf, "nation")
    title = F.when(F.col("n_nationkey") % 7 == 3, F.lit(AGENT)).otherwise(F.concat(F.lit("Agent "), F.col("n_name")))
    return n.select((F.col("n_nationkey") + 5000).cast("bigint").alias("item_id"), title.alias("title"))


J11_SQL = f"""
SELECT d.doc_id AS person_id, CASE WHEN e.eval_id IS NOT NULL THEN 'reuse' ELSE 'pending' END AS status, e.eval_id,
       (SELECT CAST(min(n_nationkey) + 5000 AS BIGINT) FROM nation WHERE n_nationkey % 7 = 3) AS agent_id
FROM documents d LEFT JOIN (SELECT doc_id, min(doc_id * 10 + 7) AS eval_id FROM labels GROUP BY 1) e ON e.doc_id = d.doc_id
"""


@register("J11_split_evaluated", J11_SQL)
def q_split(spark, sf):
    """Documents already evaluated by the agent (reuse) or pending."""
    return split(spark, sf)


E1_SQL = f"""
WITH pr AS ({PROFILE_SQL}),
pend AS (SELECT person_id FROM ({J11_SQL}) WHERE status = 'pending'),
kw AS (SELECT person_id, items FROM pr WHERE kind = 'keyword'),
p AS (SELECT pend.person_id,
             concat_ws(chr(10), 'id: ' || pend.person_id, 'name: Doc ' || pend.person_id,
                       CASE WHEN kw.items IS NOT NULL AND trim(kw.items) <> '' THEN 'keywords: ' || kw.items END) AS prompt
      FROM pend LEFT JOIN kw USING (person_id))
SELECT CAST((row_number() OVER (ORDER BY person_id) - 1) // 50 AS BIGINT) AS batch_id, person_id, prompt FROM p
"""


@register("E1_evaluation_prompts", E1_SQL)
def q_prompts(spark, sf):
    """One prompt per pending person, 50 per batch."""
    pending = split(spark, sf).where(F.col("status") == "pending")
    return EV.evaluation_prompts(pending, profiles(spark, sf, only=pending), people(spark, sf), 50)


def replies(spark, sf):
    """Model replies built from labels: fenced or plain, some cut, some
    without evaluations or with an empty list; axes from the document."""
    lb = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    j = lb.join(d, "doc_id")
    di = F.col("doc_id")
    s = lambda x: x.cast("string")
    body = F.concat(
        F.lit('{"evaluations":[{"id":"'), s(di), F.lit('","name":"Doc '), s(di), F.lit('","scores":{"arts":'),
        s(F.col("quality") * 60 + di % 40), F.when(di % 5 == 0, ".5").otherwise(""),
        F.when(di % 11 == 0, "").otherwise(F.concat(F.lit(',"care":'), s(F.col("toxic") * 50 + di % 50))),
        F.lit(',"democratie":'), F.when(di % 10 == 7, "null").otherwise(s(di * 7 % 101)),
        F.when(di % 6 == 0, F.concat(F.lit(',"extra":'), s(di % 7))).otherwise(""),
        F.lit(',"transitions":'), F.when(di % 19 == 0, '"n/a"').otherwise(s(di * 13 % 101)),
        F.lit('},"justification":"quality '), s(F.col("quality")), F.lit(", toxic "), s(F.col("toxic")), F.lit('"}]}'),
    )
    j = j.withColumn("_b", body)
    body2 = (
        F.when(di % 9 == 0, F.expr("substring(_b, 1, length(_b) div 2)"))
        .when(di % 13 == 0, F.lit('{"results":[]}'))
        .when(di % 17 == 0, F.lit('{"evaluations":[]}'))
        .otherwise(F.col("_b"))
    )
    reply = (
        F.when(di % 4 == 0, F.concat(F.lit("```json\n"), body2, F.lit("\n```")))
        .when(di % 4 == 1, F.concat(F.lit("Here you go:\n```\n"), body2, F.lit("\n```\nThanks")))
        .otherwise(body2)
    )
    axes = (
        F.when(di % 7 == 0, F.array().cast("array<string>"))
        .when(di % 3 == 0, F.array("lang"))
        .otherwise(F.array("lang", "source"))
    )
    return j.select(di.alias("person_id"), stable_id(F.lit("agent"), F.lit(AGENT)).alias("agent_id"), axes.alias("axes"), reply.alias("reply"))


REPLIES_SQL = f"""
  SELECT doc_id AS person_id, {AGENT_ID_SQL} AS agent_id, lang, source,
         CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_axes,
         CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || b2 || chr(10) || '```'
                         WHEN 1 THEN 'Here you go:' || chr(10) || '```' || chr(10) || b2 || chr(10) || '```' || chr(10) || 'Thanks'
                         ELSE b2 END AS reply
  FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN substr(b, 1, length(b) // 2) WHEN doc_id % 13 = 0 THEN '{{"results":[]}}'
                       WHEN doc_id % 17 = 0 THEN '{{"evaluations":[]}}' ELSE b END AS b2
        FROM (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source,
                     '{{"evaluations":[{{"id":"' || l.doc_id || '","name":"Doc ' || l.doc_id || '","scores":{{"arts":' || (l.quality * 60 + l.doc_id % 40) || CASE WHEN l.doc_id % 5 = 0 THEN '.5' ELSE '' END
                     || CASE WHEN l.doc_id % 11 = 0 THEN '' ELSE ',"care":' || (l.toxic * 50 + l.doc_id % 50) END
                     || ',"democratie":' || CASE WHEN l.doc_id % 10 = 7 THEN 'null' ELSE CAST(l.doc_id * 7 % 101 AS VARCHAR) END
                     || CASE WHEN l.doc_id % 6 = 0 THEN ',"extra":' || (l.doc_id % 7) ELSE '' END
                     || ',"transitions":' || CASE WHEN l.doc_id % 19 = 0 THEN '"n/a"' ELSE CAST(l.doc_id * 13 % 101 AS VARCHAR) END || '}},"justification":"quality ' || l.quality || ', toxic ' || l.toxic || '"}}]}}' AS b
              FROM labels l JOIN documents d ON d.doc_id = l.doc_id))
"""
SCORE_KEYS = [*EV.CATEGORIES, "extra"]
FENCE_SQL = EV.FENCE.replace("'", "''")
PARSED_SQL = f"""
  SELECT *, CASE WHEN NOT json_valid(c) THEN 'undecodable'
                 WHEN json_type(c, '$.evaluations') IS DISTINCT FROM 'ARRAY' THEN 'no evaluations'
                 WHEN json_array_length(c, '$.evaluations') = 0 THEN 'empty evaluations'
                 WHEN {" OR ".join(f"(json_extract_string(c, '$.evaluations[0].scores.{k}') IS NOT NULL AND TRY_CAST(json_extract_string(c, '$.evaluations[0].scores.{k}') AS DOUBLE) IS NULL)" for k in SCORE_KEYS)}
                 THEN 'undecodable scores' END AS reason
  FROM (SELECT *, CASE WHEN regexp_matches(reply, '{FENCE_SQL}') THEN regexp_extract(reply, '{FENCE_SQL}', 1) ELSE reply END AS c
        FROM ({REPLIES_SQL}))
"""


def _score_sql(cat: str) -> str:
    return f"TRY_CAST(json_extract_string(c, '$.evaluations[0].scores.{cat}') AS DOUBLE)"


E2_SQL = f"""
SELECT person_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status,
       CASE WHEN reason IS NULL THEN json_extract_string(c, '$.evaluations[0].id') END AS eval_id,
       CASE WHEN reason IS NULL THEN json_extract_string(c, '$.evaluations[0].name') END AS name,
       {", ".join(f"CASE WHEN reason IS NULL THEN {_score_sql(c)} END AS {c}" for c in EV.CATEGORIES)},
       CASE WHEN reason IS NULL THEN json_extract_string(c, '$.evaluations[0].justification') END AS justification,
       CAST(n_axes AS BIGINT) AS n_axes, reason, CASE WHEN reason IS NOT NULL THEN substr(c, 1, 300) END AS reject_text
FROM ({PARSED_SQL})
"""


def parsed(spark, sf):
    return EV.parse_evaluations(replies(spark, sf))


@register("E2_parse_evaluations", E2_SQL)
def q_parse(spark, sf):
    """Model replies decoded into evaluations, or rejected with a reason."""
    p = parsed(spark, sf)
    return p.select(
        "person_id", "status", "eval_id", "name", *[F.col("scores")[c].alias(c) for c in EV.CATEGORIES],
        "justification", F.size("axes").alias("n_axes"), "reason", "reject_text",
    )


OK_SQL = f"SELECT * FROM ({PARSED_SQL}) WHERE reason IS NULL"
CS_SQL = " UNION ALL ".join(
    f"SELECT person_id, lang, source, n_axes, '{c}' AS category, {_score_sql(c)} AS score FROM ok WHERE {_score_sql(c)} IS NOT NULL" for c in EV.CATEGORIES
)
RUN_TIME = "01/03/2024 10:00"
_ELEMENT = "json_extract_string(c, '$.evaluations[0].{}')"
E3_SQL = f"""
WITH ok AS ({OK_SQL}), sc AS ({" UNION ALL ".join(
    f"SELECT person_id, '{k}' AS key, {_ELEMENT.format('scores.' + k)} AS txt FROM ok" for k in SCORE_KEYS)})
SELECT person_id, 'eval:' || key AS property, key || ' = ' || txt AS value, CAST(txt AS DOUBLE) AS rank FROM sc WHERE txt IS NOT NULL
UNION ALL SELECT person_id, 'dcterms:title', printf('{EV.EVALUATION_TITLE}', '{AGENT}', {_ELEMENT.format('name')}, '{RUN_TIME}'), NULL FROM ok
UNION ALL SELECT person_id, 'eval:justification', {_ELEMENT.format('justification')}, NULL FROM ok
UNION ALL SELECT person_id, 'dcterms:source', CAST(person_id AS VARCHAR), NULL FROM ok
UNION ALL SELECT person_id, 'dcterms:creator', CAST(agent_id AS VARCHAR), NULL FROM ok
UNION ALL SELECT person_id, 'curation:data', CAST(json_extract(c, '$.evaluations[0]') AS VARCHAR), NULL FROM ok
"""


@register("E3_evaluation_statements", E3_SQL)
def q_eval_statements(spark, sf):
    """Each parsed evaluation as long statement rows."""
    return EV.evaluation_statements(parsed(spark, sf), AGENT, RUN_TIME)


E4_SQL = f"""
WITH ok AS ({OK_SQL}), cs AS ({CS_SQL})
SELECT category, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS band,
       CAST(count(*) AS BIGINT) AS n FROM cs GROUP BY 1, 2
"""


@register("E4_score_bands", E4_SQL)
def q_bands(spark, sf):
    """High / mid / low score counts per category."""
    return EV.score_bands(parsed(spark, sf))


AX_SQL = f"""
  WITH ok AS ({OK_SQL}), cs AS ({CS_SQL}),
  ax AS (SELECT person_id, lang AS axis, category, score FROM cs WHERE n_axes >= 1
         UNION ALL SELECT person_id, source, category, score FROM cs WHERE n_axes = 2)
"""
A5_SQL = f"""
{AX_SQL}
SELECT category, NULL::VARCHAR AS axis, 'category' AS level, sum(score) AS total, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT person_id) AS BIGINT) AS n_people, CAST(round(sum(score) / count(*)) AS BIGINT) AS mean FROM ax GROUP BY 1
UNION ALL
SELECT category, axis, 'axis', sum(score), CAST(count(*) AS BIGINT), CAST(count(DISTINCT person_id) AS BIGINT),
       CAST(round(sum(score) / count(*)) AS BIGINT) FROM ax GROUP BY 1, 2
"""


def scores(spark, sf):
    return EV.category_axis_scores(parsed(spark, sf))


@register("A5_category_axis_scores", A5_SQL)
def q_category_axis(spark, sf):
    """Totals, counts and means per category and per (category, axis): one grouping-sets pass."""
    return scores(spark, sf)


W4_SQL = f"""
WITH ok AS ({OK_SQL}), cs AS ({CS_SQL})
SELECT category, rank, person_id, score FROM (
  SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, person_id) AS BIGINT) AS rank, person_id, score FROM cs)
WHERE rank <= 5
"""


@register("W4_top_people_per_category", W4_SQL)
def q_top_people(spark, sf):
    """The five best-scored people per category."""
    return EV.top_people(parsed(spark, sf), 5)


W5_SQL = f"""
{AX_SQL}
SELECT category, axis, CAST(row_number() OVER (PARTITION BY category, axis ORDER BY score DESC, person_id) AS BIGINT) AS rank,
       person_id, score FROM ax
"""


@register("W5_ranked_in_axis", W5_SQL)
def q_ranked_axis(spark, sf):
    """People ranked by score inside each (category, axis)."""
    return EV.ranked_in_axis(parsed(spark, sf))


def summaries(spark, sf):
    """Summaries per (category, language) for two categories, from document counts."""
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for cat in ("arts", "care"):
        s = d.select(
            F.lit(cat).alias("EUR"), F.col("lang").alias("AXE"), (F.col("n") % 100).alias("score"),
            F.format_string(f"{cat} in %s: %d documents", F.col("lang"), F.col("n")).alias("synthese"),
            F.concat(F.lit("strong "), F.col("lang")).alias("forces"), F.concat(F.lit("grow "), F.col("lang")).alias("recommandations"),
            F.concat(F.lit("watch "), F.col("lang")).alias("vigilances"),
        )
        out = s if out is None else out.unionByName(s)
    return out


SUMMARIES_SQL = " UNION ALL ".join(
    f"""SELECT '{cat}' AS EUR, lang AS AXE, count(*) % 100 AS score, printf('{cat} in %s: %d documents', lang, count(*)) AS synthese,
       'strong ' || lang AS forces, 'grow ' || lang AS recommandations, 'watch ' || lang AS vigilances FROM documents GROUP BY lang"""
    for cat in ("arts", "care")
)
J13_SQL = f"""
WITH a5 AS ({A5_SQL}), s AS ({SUMMARIES_SQL})
SELECT a5.category, a5.axis, a5.total, a5.n_rows, a5.n_people, a5.mean, CAST(s.score AS BIGINT) AS summary_score, s.synthese
FROM a5 LEFT JOIN s ON s.EUR = a5.category AND s.AXE = a5.axis WHERE a5.level = 'axis'
"""


@register("J13_attach_summaries", J13_SQL)
def q_summaries(spark, sf):
    """(category, axis) aggregates with their summary attached."""
    j = EV.attach_summaries(scores(spark, sf), summaries(spark, sf))
    return j.select("category", "axis", "total", "n_rows", "n_people", "mean", "summary_score", "synthese")


S6_SQL = f"""
WITH a5 AS ({A5_SQL}), j AS ({J13_SQL})
SELECT category, NULL::VARCHAR AS axis,
       printf('{EV.CATEGORY_FORMAT.replace(chr(10), "' || chr(10) || '")}', category, total, n_rows, n_people, mean) AS section
FROM a5 WHERE level = 'category'
UNION ALL
SELECT category, axis,
       printf('{EV.SECTION_FORMAT.replace(chr(10), "' || chr(10) || '")}', category, axis, total, n_rows, n_people, mean,
              coalesce(synthese, 'No summary.')) FROM j
"""


@register("S6_report_sections", S6_SQL)
def q_report(spark, sf):
    """Markdown report sections per category and per (category, axis)."""
    sc = scores(spark, sf)
    return EV.report_sections(sc, EV.attach_summaries(sc, summaries(spark, sf)))
