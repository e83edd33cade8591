"""Nearest neighbours by inner product: a forest of random-projection trees,
searched through one priority queue, and exact reranking."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.common import written


class Forest:
    """Trees that split at the median of a random projection.

    Every level of a tree has one random direction and every node its own
    threshold, the median of the sample rows that reach it; so a forest is
    trees x depth directions and trees x 2^depth thresholds, whatever the data.
    Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2)
    for rows (M: the largest norm) and 0 for queries.
    """

    def __init__(self, sample: np.ndarray, largest_norm: float, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm, self.trees, self.depth = largest_norm, trees, depth
        directions = rng.standard_normal((trees, depth, sample.shape[1] + 1))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, (1 << depth) - 1))
        points = self.lift(sample)
        for t in range(trees):
            projected = points @ self.directions[t].T
            groups = [np.arange(len(points))]
            for level in range(depth):
                below = []
                for k, rows in enumerate(groups):
                    values = projected[rows, level]
                    cut = np.median(values) if len(rows) else 0.0
                    self.thresholds[t, (1 << level) - 1 + k] = cut
                    below += [rows[values <= cut], rows[values > cut]]
                groups = below

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - np.einsum("ij,ij->i", rows, rows), 0.0)
        return np.concatenate((rows, np.sqrt(rest)[:, None]), axis=1)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        points = self.lift(rows)
        out = np.zeros((len(rows), self.trees), dtype=np.int32)
        for t in range(self.trees):
            projected = points @ self.directions[t].T
            node = np.zeros(len(rows), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (projected[:, level] > self.thresholds[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def visit(self, query: np.ndarray, counts: np.ndarray, rows: int) -> list[tuple[int, int]]:
        """(tree, leaf) nearest the query first, until they hold ``rows`` rows.

        All trees share one queue, ordered by the squared distances to the
        planes on whose far side a branch lies."""
        projected = self.directions[:, :, :-1] @ query
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        first_leaf, out, got = (1 << self.depth) - 1, [], 0
        while queue and got < rows:
            far, t, node, level = heapq.heappop(queue)
            while level < self.depth:
                margin = projected[t, level] - self.thresholds[t, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (far + margin * margin, t, 4 * node + 3 - near, level + 1))
                node, level = near, level + 1
            leaf = node - first_leaf
            if counts[t, leaf]:
                out.append((t, leaf))
                got += counts[t, leaf]
        return out


def _valid(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assign(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = forest.leaves(_matrix(batch.column(1)))
            for t in range(forest.trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(leaves[:, t]), batch.column(0), batch.column(1)],
                    ["tree", "leaf", "id", "vector"],
                )

    return run


def _visit(forest: Forest, counts: np.ndarray, rows: int, known: np.ndarray, k: int):
    """The leaves that every query visits, and ``least``: the ``k``-th best
    score among those of the ``known`` rows of the index that they hold. No row
    below it can be one of the query's ``k`` best."""
    places = forest.leaves(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, trees, leaves, least = [], [], [], []
            for i, query in enumerate(_matrix(batch.column(1))):
                visits = forest.visit(query, counts, rows)
                seen = np.zeros(counts.shape, dtype=bool)
                for t, leaf in visits:
                    seen[t, leaf] = True
                scores = known[seen[np.arange(forest.trees), places].any(axis=1)] @ query
                bound = -np.inf
                if len(scores) >= k:
                    # the last bits of a score depend on the shape of the product
                    bound = np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-12 * forest.norm * np.linalg.norm(query)
                at += [i] * len(visits)
                trees += [t for t, _ in visits]
                leaves += [leaf for _, leaf in visits]
                least += [bound] * len(visits)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int32()), pa.array(leaves, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(least, pa.float64())],
                ["tree", "leaf", "id", "vector", "least"],
            )

    return run


#: Rows of the sample that give every query a bound.
_KNOWN = 8192
#: Candidates that a task holds before it cuts every query's to its best ones.
_HELD = 1 << 20


def _cut(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, row, score) every query's ``k`` best rows, each once, and
    those as good as the last of them."""
    q, r, score = found
    order = np.lexsort((r, -score, q))
    q, r, score = q[order], r[order], score[order]
    # a row met in several trees has one score, so its copies lie together
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1]))) if len(q) else np.zeros(0, bool)
    q, r, score = q[new], r[new], score[new]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(q)))
    last = score[first + np.minimum(sizes, k) - 1]
    keep = score >= np.repeat(last, sizes)
    return [q[keep], r[keep], score[keep]]


def _rerank(k: int):
    """Over rows sorted by (tree, leaf, is_query): a leaf's rows are kept, its
    queries scored against them a batch at a time. A task passes on the best
    rows that each query has in all its leaves together, and none below the
    query's bound: however many tasks there are, few rows are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, rows = None, [], []
        held: list[list[np.ndarray]] = [[], [], []]

        def best() -> list[np.ndarray]:
            return _cut([np.concatenate(h) if h else np.zeros(0, t) for h, t in zip(held, (np.int64, np.int64, np.float64))], k)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().astype(np.int64) << 33 | batch.column(1).to_numpy().astype(np.int64) << 1
            key |= batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            vec, own, bound = _matrix(batch.column(4)), batch.column(3).to_numpy(), batch.column(5).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                leaf, is_query = key[a] >> 1, key[a] & 1
                if leaf != here:
                    here, ids, rows = leaf, [], []
                if not is_query:
                    ids.append(own[a:b])
                    rows.append(vec[a:b])
                elif ids:
                    if len(ids) > 1:
                        ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    for s in range(a, b, 256):
                        scores = vec[s : min(b, s + 256)] @ rows[0].T
                        n = min(k, scores.shape[1])
                        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                        q, r = np.nonzero(scores >= np.maximum(least, bound[s : min(b, s + 256)])[:, None])
                        for h, x in zip(held, (own[s + q], ids[0][r], scores[q, r])):
                            h.append(x)
            if sum(map(len, held[0])) > _HELD:
                cut = best()
                if len(cut[0]) > _HELD // 2:  # many queries: what they have so far goes on
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cut], ["qid", "cls", "score"])
                    cut = [c[:0] for c in cut]
                held = [[c] for c in cut]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["qid", "cls", "score"])

    return run


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 8,
    leaf_rows: int = 128,
    sample_rows: int = 65536,
    share: float = 1.0,
    least_rows: int = 10000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of largest inner product found for every query, its own
    row aside: query_id, rank (int, from 1), ``id_col``, score (double).

    The thresholds of the trees are fitted on at most ``sample_rows`` vectors
    (smallest hash of the id); every row is indexed in every tree. A query
    visits leaves of all trees until they hold ``share`` times as many rows as
    there are (a row counts once in each tree; ``least_rows`` at least, which
    in a small table is all of them), and what they hold is scored
    exactly in blocks, leaf by leaf. What a query has in the first 8192 of the
    sample bounds what is passed on, and changes no result. Vectors without structure need a large
    share: directions in many dimensions are nearly orthogonal, so no tree can
    rule much out. 8 trees and a share of 1 look at about 0.6 of the rows.

    Equal vectors are indexed and searched once (a row of the index stands for
    all of them and keeps its k + 1 smallest ids, of which no result can need
    more), so a vector held by a third of the rows is one row. Null vectors,
    zero vectors and vectors with null or non-finite components take no part,
    as rows or as queries. Null ids and columns other than the two are not
    read; an empty table gives no rows; fewer than ``k`` rows give all.
    Vectors must have one length.
    """
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
        return df.where(F.col("_id").isNotNull() & _valid("_v")).dropDuplicates(["_id", "_v"])

    by_id = Window.partitionBy("_v").orderBy("_id")
    firsts = usable(rows).withColumn("_k", F.row_number().over(by_id)).where(F.col("_k") <= k + 1)
    classes = firsts.groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("members"))
    classes = written(classes.select(F.col("members")[0].alias("cls"), F.col("_v").alias("vector"), "members"), "vectors")
    wanted = usable(queries)
    asked = wanted.groupBy("_v").agg(F.min("_id").alias("id")).select("id", F.col("_v").alias("vector"))

    schema = "query_id long, rank int, vec_id long, score double"
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, norm = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    if not total:
        return spark.createDataFrame([], schema.replace("vec_id", id_col))
    sample = classes.select("cls", "vector").orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).select("vector").toPandas()
    sample = np.stack(sample["vector"].to_numpy()).astype(np.float64)
    # no deeper than the sample can place thresholds for: 32 of its rows in a leaf
    depth = max(0, min(int(np.log2(max(1, total / leaf_rows))), int(np.log2(max(1, len(sample) / 32)))))
    forest = Forest(sample, norm, trees, depth)

    indexed = classes.select("cls", "vector").mapInArrow(_assign(forest), "tree int, leaf int, id long, vector array<float>")
    indexed = written(indexed, "forest")
    counts = np.zeros((trees, 1 << depth), dtype=np.int64)
    for r in indexed.groupBy("tree", "leaf").count().collect():  # trees x 2^depth rows at most
        counts[r["tree"], r["leaf"]] = r["count"]
    visits = _visit(forest, counts, max(least_rows, int(share * total)), sample[:_KNOWN], k + 1)
    visits = asked.mapInArrow(visits, "tree int, leaf int, id long, vector array<float>, least double")
    mixed = indexed.withColumns({"is_query": F.lit(0), "least": F.lit(0.0)}).unionByName(visits.withColumn("is_query", F.lit(1)))
    mixed = mixed.select("tree", "leaf", "is_query", "id", "vector", "least")
    sorted_leaves = mixed.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "is_query")
    found = sorted_leaves.mapInArrow(_rerank(k + 1), "qid long, cls long, score double")
    found = found.groupBy("qid", "cls").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cls")
    found = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1)
    # a matrix product's last bits depend on its shape and the machine: what is left is
    # scored once more, component by component in order, and ranked by that
    pairs = found.join(classes.select("cls", "vector"), "cls").join(asked.select(F.col("id").alias("qid"), F.col("vector").alias("_q")), "qid")
    products = F.zip_with("vector", "_q", lambda x, y: x.cast("double") * y.cast("double"))
    found = pairs.select("qid", "cls", F.aggregate(products, F.lit(0.0), lambda s, x: s + x).alias("score"))
    members = found.join(classes.select("cls", "members"), "cls")
    # at most (k + 1)^2 ids a query
    answers = members.groupBy("qid").agg(
        F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("id"))))).alias("a")
    )
    answers = answers.select("qid", F.slice(F.array_sort("a"), 1, k + 1).alias("a"))
    out = (
        wanted.join(asked.select("id", F.col("vector").alias("_v")), "_v")
        .join(answers, F.col("id") == F.col("qid"))
        .select(F.col("_id").alias("query_id"), F.slice(F.filter("a", lambda x: x["id"] != F.col("_id")), 1, k).alias("a"))
        .select("query_id", F.posexplode("a").alias("p", "x"))
    )
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
