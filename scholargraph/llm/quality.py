"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are fitted to the labels, every path from a root to a node is a
rule (a conjunction of thresholds), a logistic model with a lasso penalty
weighs rules and statistics, and what keeps a weight becomes one column
expression. Scoring is a projection of the scan, without Python.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import text_or_empty, written

#: Separators and signs that prose has few of.
_SIGNS = "|%&$#*!<>{}[]=\\/_~^@+"
_DIGITS = "0123456789"
#: Partitions of the rows that the model is fitted on.
FIT_PARTITIONS = 4
_STOPS = ".,;:?"


def with_statistics(df: DataFrame, keep: list[str], text: Column) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` of ``df`` and statistics of the whole text, and the
    names of the latter; all are finite, for an empty text too.

    Words and lines are cut once, in a projection of their own. Counts of
    characters are differences of lengths, without regular expressions.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    cut = df.select(
        *kept,
        text.alias("_text"),
        F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "").alias("_words"),
        F.split(text, "\n").alias("_lines"),
    )
    n, words, lines = F.char_length("_text"), F.size("_words"), F.size("_lines")
    per = lambda x, y: x.cast("double") / F.greatest(y.cast("double"), F.lit(1.0))
    without = lambda chars: n - F.char_length(F.translate("_text", chars, ""))
    initial = lambda w: F.left(w, F.lit(1))
    stats = {
        "_n_words": F.log1p(words.cast("double")),
        "_distinct_words": per(F.size(F.array_distinct("_words")), words),
        "_word_chars": per(n, words),
        "_distinct_lines": per(F.size(F.array_distinct("_lines")), lines),
        "_line_words": F.log1p(per(words, lines)),
        "_signs": per(without(_SIGNS), n),
        "_digits": per(without(_DIGITS), n),
        "_stops": per(without(_STOPS), words),
        "_capitals": per(F.char_length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")), n),
        "_first_capitals": per(F.size(F.filter("_words", lambda w: initial(w) != F.lower(initial(w)))), words),
    }
    return cut.select(*kept, *[c.alias(name) for name, c in stats.items()]), list(stats)


@dataclass(frozen=True)
class Rule:
    """Thresholds that hold together: (statistic, "<=" or ">", value)."""

    terms: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        """1.0 where all terms hold, else 0.0."""
        both = " AND ".join(f"{name} {op} {value!r}D" for name, op, value in self.terms)
        return f"if({both}, 1D, 0D)"


def simplified(terms: list[tuple[str, str, float]]) -> Rule:
    """One bound of each side for each statistic."""
    bound: dict[tuple[str, str], float] = {}
    for name, op, value in terms:
        old = bound.get((name, op))
        bound[name, op] = value if old is None else (min if op == "<=" else max)(old, value)
    return Rule(tuple(sorted((name, op, value) for (name, op), value in bound.items())))


def tree_rules(described: str, names: list[str]) -> list[Rule]:
    """The paths of a tree as Spark describes it."""
    rules, path = [], []
    for line in described.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        indent, feature, op, value = found.groups()
        path = [p for p in path if p[0] < len(indent)]
        path.append((len(indent), (names[int(feature)], op, float(value))))
        rules.append(simplified([term for _, term in path]))
    return list(dict.fromkeys(rules))


@dataclass(frozen=True)
class RuleEnsemble:
    """A fitted model: weights of rules and of statistics."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[str, float], ...]
    constant: float | None = None

    def score(self) -> Column:
        """The probability of label 1 as one column over the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        terms = [f"{rule.sql()} * {weight!r}D" for rule, weight in self.rules]
        terms += [f"{name} * {weight!r}D" for name, weight in self.linear]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")


def fit(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20000,
    trees: int = 40,
    depth: int = 3,
    lasso: float = 0.0005,
    seed: int = 5,
) -> RuleEnsemble:
    """Fits the ensemble on the labelled texts of ``df``.

    At most ``max_rows`` labelled rows are used, those with the smallest hash
    of the id; only they are joined with the texts (the broadcast side has at
    most that many rows). Null labels and ids are left out; of several labels
    of one id the largest counts. Without labels the score is 0.5, with one
    class or without any useful split it is the share of label 1.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_whole"))
    rows, names = with_statistics(texts.join(F.broadcast(chosen), "_id"), ["_label"], F.col("_whole"))
    # at most max_rows rows of a few numbers: few partitions, as every iteration of the fits is a job
    rows = written(rows, "quality-rows").coalesce(FIT_PARTITIONS)
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    if not n:
        return RuleEnsemble(0.0, (), (), 0.5)
    if ones in (0, n):
        return RuleEnsemble(0.0, (), (), float(ones / n))
    data = rows.select(array_to_vector(F.array(*names)).alias("_x"), "_label").cache()
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed
    ).fit(data)
    data.unpersist()
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString, names)))
    if not rules:
        return RuleEnsemble(0.0, (), (), float(ones / n))
    inputs = F.expr(f"array({', '.join([r.sql() for r in rules] + names)})")
    data = rows.select(array_to_vector(inputs).alias("_x"), "_label").cache()
    model = LogisticRegression(
        featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True
    ).fit(data)
    data.unpersist()
    weights = model.coefficients.toArray()
    return RuleEnsemble(
        float(model.intercept),
        tuple((r, float(w)) for r, w in zip(rules, weights) if w),
        tuple((n, float(w)) for n, w in zip(names, weights[len(rules) :]) if w),
    )


def score(df: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if
    the score is at least ``threshold``). Every row is scored on its whole
    text; null texts are empty; other columns stay as they are (score and
    predicted are replaced, names that begin with "_" are ours)."""
    names = [c for c in df.columns if c not in ("score", "predicted")]
    with_stats, _ = with_statistics(df, names, text_or_empty(f"`{text_col}`"))
    scored = with_stats.select(*[F.col(f"`{c}`") for c in names], model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
