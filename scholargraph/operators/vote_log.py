"""A change log replayed in order on a vote table."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from scholargraph.session import cut_lineage

#: Columns of a vote that stay as they were given.
_VOTE = ["person_id", "concept_id", "rank", "owner_id"]


class Life(NamedTuple):
    """A vote as it stands."""

    person_id: int
    concept_id: int
    rank: int
    owner_id: int
    kind: str | None
    user_id: int | None
    day: str | None
    labs: list[int]


def _may_edit(row: dict, person: int, labs: list[int]) -> bool:
    """The user of a change may edit a person: as an administrator, by a lab
    that they manage and the person is part of, or as that person."""
    if row["everyone"]:
        return True
    return person is not None and (person in row["own"] or not set(row["managed"]).isdisjoint(labs))


def step(life: Life | None, row: dict) -> tuple[Life | None, str | None]:
    """The vote after a change, and why the change had no effect."""
    op = row["op"]
    if op == "stored":
        return Life(*(row[c] for c in _VOTE), row["kind"], row["by"], row["day"], row["labs"]), None
    if op == "create":
        if not _may_edit(row, row["person_id"], row["labs"]):
            return life, "not allowed"
        if life is not None:
            return life, "vote exists"
        return Life(*(row[c] for c in _VOTE), "create", row["user_id"], row["day"], row["labs"]), None
    if life is None:
        return life, "unknown vote"
    if not _may_edit(row, life.person_id, life.labs):
        return life, "not allowed"
    if op == "delete":
        return None, None
    return life._replace(rank=row["rank"], kind="update", user_id=row["user_id"], day=row["day"]), None


def _replay(schema: pa.Schema, started: dict[int, tuple]):
    """Rows sorted by segment, vote and moment -> the errors, and per segment
    and vote the vote at its end (``alive`` false: there is none).

    ``started``: for a segment, the vote that runs over from the segment
    before, and how it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, life, first = None, None, False
        out: list[dict] = []

        def end() -> dict:
            known = life._asdict() if life else {}
            return {"seg": at[0], "vote_id": at[1], "first": first, "alive": life is not None, **known}

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["seg"], row["vote_id"])
                if key != at:
                    if at is not None:
                        out.append(end())
                    first = at is None or at[0] != key[0]
                    at = key
                    vote, carried = started.get(key[0], (None, None))
                    life = Life(**carried) if first and vote == key[1] and carried else None
                life, reason = step(life, row)
                if reason:
                    out.append({"seg": key[0], "vote_id": key[1], "op": row["op"], "moment": row["moment"], "user_id": row["user_id"], "reason": reason})
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([end()], schema)

    return run


def _rights(rules: DataFrame) -> DataFrame:
    """One row per user: everyone, labs they manage, persons that are them."""
    gathered = lambda scope, col: F.collect_set(F.when(F.col("scope") == scope, F.col(col)))
    return rules.groupBy("user_id").agg(
        F.max(F.col("scope") == "all").alias("everyone"), gathered("lab", "lab_id").alias("managed"), gathered("person", "person_id").alias("own")
    )


def _events(votes: DataFrame, changes: DataFrame, rules: DataFrame, person_labs: DataFrame) -> DataFrame:
    """Votes and changes in one frame: (vote_id, moment, op, ...) with the
    rights of the change's user and the labs of the person it names."""
    seq = changes.schema["seq"].dataType
    given = lambda df, col, kind: F.col(col).cast(kind) if col in df.columns else F.lit(None).cast(kind)
    stored = votes.select(
        "vote_id", F.struct(F.lit(0).alias("late"), F.lit(None).cast(seq).alias("seq")).alias("moment"), F.lit("stored").alias("op"),
        *[F.col(c).cast("bigint").alias(c) for c in _VOTE], F.lit(None).cast("bigint").alias("user_id"),
        given(votes, "day", "string").alias("day"), given(votes, "kind", "string").alias("kind"), given(votes, "user_id", "bigint").alias("by"),
    )
    logged = changes.select(
        "vote_id", F.struct(F.lit(1).alias("late"), F.col("seq")).alias("moment"), "op",
        *[F.col(c).cast("bigint").alias(c) for c in _VOTE[:3]], F.col("user_id").cast("bigint").alias("owner_id"), F.col("user_id").cast("bigint").alias("user_id"),
        "day", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("by"),
    )
    labs = person_labs.groupBy("person_id").agg(F.collect_set(F.col("lab_id").cast("bigint")).alias("labs"))
    names_person = F.col("op").isin("stored", "create")
    none = F.array().cast("array<bigint>")
    rows = stored.unionByName(logged).withColumn("_named", F.when(names_person, F.col("person_id")))
    rows = rows.join(labs.withColumnRenamed("person_id", "_named"), "_named", "left").join(_rights(rules), "user_id", "left")
    return rows.drop("_named").withColumns({
        "labs": F.coalesce("labs", none), "everyone": F.coalesce("everyone", F.lit(False)),
        "managed": F.coalesce("managed", none), "own": F.coalesce("own", none),
    })


def replay(votes: DataFrame, changes: DataFrame, rules: DataFrame, person_labs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every change in order of its vote's log: ``(decided, errors)``.

    Votes and changes are sorted by (vote, moment) as one frame and cut into
    ranges of that order, so that a vote with a third of all changes is spread
    over many. Each range is folded by itself; of a range only its first vote
    may have begun before, and how it stood there is one row of the range
    before. Those first votes are folded again with that row, until no range
    ends otherwise than before: once, if no vote fills a whole range. Nothing is
    joined on a vote's changes, and a task holds one vote's state.
    """
    spark = votes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a moment is not unique if the log repeats a seq; the rest of the row settles the order
    order = ["vote_id", "moment", "op", "user_id", "rank", "person_id", "concept_id", "day"]
    ranged = _events(votes, changes, rules, person_labs).repartitionByRange(n, *order).withColumn("seg", F.spark_partition_id())
    ranged = cut_lineage(ranged, "vote-log")
    moment = ranged.schema["moment"].dataType.simpleString()
    schema = (
        f"seg int, vote_id long, first boolean, alive boolean, person_id long, concept_id long, rank long, owner_id long, kind string, "
        f"user_id long, day string, labs array<long>, op string, moment {moment}, reason string"
    )
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def folded(rows: DataFrame, started: dict[int, tuple], name: str) -> DataFrame:
        dealt = rows.repartition(n, "seg").sortWithinPartitions("seg", *order)
        return cut_lineage(dealt.mapInArrow(_replay(arrow, started), schema), name)

    done = folded(ranged, {}, "vote-replay")
    ends = done.where("reason is null")
    bounds = ends.groupBy("seg").agg(F.max("vote_id").alias("vote_id"), F.min("vote_id").alias("first_vote"))
    bounds = bounds.join(ends.drop("first"), ["seg", "vote_id"])
    carried = {r["seg"]: r.asDict() for r in bounds.drop("op", "moment", "reason").collect()}  # a row per range
    known: dict[int, tuple] = {}
    while True:
        started = {}
        for before, seg in zip(sorted(carried), sorted(carried)[1:]):
            vote, life = carried[before]["vote_id"], _life(carried[before])
            if vote == carried[seg]["first_vote"] and known.get(seg, (vote, None)) != (vote, life):
                started[seg] = (vote, life)
        if not started:
            break
        known |= started
        pairs = spark.createDataFrame([(s, v) for s, (v, _) in started.items()], "seg int, vote_id long")
        # at most a row per range
        rows = ranged.join(F.broadcast(pairs), ["seg", "vote_id"], "left_semi")
        again = folded(rows, started, "vote-replay-again")
        done = done.join(F.broadcast(pairs), ["seg", "vote_id"], "left_anti").unionByName(again)
        for r in again.where("reason is null").collect():
            if r["vote_id"] == carried[r["seg"]]["vote_id"]:
                carried[r["seg"]] |= r.asDict()
    final = done.where("reason is null").groupBy("vote_id").agg(F.max_by(F.struct("alive", *_VOTE, "kind", "user_id", "day"), "seg").alias("_v"))
    decided = final.select("vote_id", "_v.*").where("alive").drop("alive")
    errors = done.where("reason is not null").select("vote_id", "op", F.col("moment.seq").alias("seq"), "user_id", "reason")
    return decided, errors


def _life(row: dict) -> dict | None:
    return {f: row[f] for f in Life._fields} if row["alive"] else None

