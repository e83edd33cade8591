"""The ordered replay of vote changes against a plain loop; hot votes; the log as a stream."""
import random

from scholargraph.operators import votes as V
from scholargraph.streaming import votes as stream
from scholargraph.streaming.votes import CHANGES, VOTES, apply_changes, start_votes, vote_store

STORED = "vote_id long, person_id long, concept_id long, rank long, owner_id long"


def setting(spark):
    users = spark.createDataFrame(
        [(1, "adm", "global_admin", []), (2, "rev", "reviewer", [7]), (3, "p30", "author", []), (4, "none", "guest", []), (5, "rev2", "reviewer", [8, 9])],
        "user_id bigint, name string, role string, labs array<bigint>")
    persons = spark.createDataFrame([(30, "p30"), (31, "x"), (32, "y")], "person_id bigint, account string")
    labs = spark.createDataFrame([(30, 7), (31, 8), (31, 9), (32, 1)], "person_id bigint, lab_id bigint")
    return V.access_rules(users, persons), labs


MAY = {(1, p) for p in (30, 31, 32, None)} | {(2, 30), (3, 30), (5, 31)}


def plain(stored, changes):
    """One change after another."""
    votes = {v[0]: [*v[1:], None, None, None] for v in stored}
    errors = []
    for op, vote, person, concept, rank, user, day, seq in sorted(changes, key=lambda c: c[7]):
        known = votes.get(vote)
        if op == "create":
            reason = "not allowed" if (user, person) not in MAY else "vote exists" if known else None
            if not reason:
                votes[vote] = [person, concept, rank, user, "create", user, day]
        else:
            reason = "unknown vote" if known is None else None if (user, known[0]) in MAY else "not allowed"
            if not reason and op == "delete":
                del votes[vote]
            elif not reason:
                known[2], known[4:] = rank, ["update", user, day]
        if reason:
            errors.append((vote, op, seq, user, reason))
    return {(v, *r) for v, r in votes.items()}, sorted(errors, key=str)


def log(n, hot, seed):
    """``hot``: the share of changes that one vote has."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        vote = 1 if rnd.random() < hot else rnd.randrange(2, 40)
        op = rnd.choices(["create", "update", "delete"], [2, 6, 1])[0]
        out.append((op, vote, rnd.choice([30, 31, 32]), 5, rnd.randrange(9), rnd.choice([1, 2, 3, 4, 5, 6]), f"d{i % 28}", i))
    return out


STORED_ROWS = [(1, 31, 5, 2, 9), (2, 30, 6, 1, 9), (900, 32, 1, 1, 1)]


def compare(spark, changes, partitions):
    rules, labs = setting(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        decided, errors = V.vote_changes(spark.createDataFrame(STORED_ROWS, STORED), spark.createDataFrame(changes, CHANGES), rules, labs)
        got = {tuple(r) for r in decided.collect()}, sorted((tuple(r) for r in errors.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(STORED_ROWS, changes)


def test_replay_equals_a_plain_loop(spark):
    compare(spark, log(3000, 0.05, 1), 5)


def test_a_hot_vote_runs_over_many_ranges(spark):
    changes = log(2000, 0.9, 2)
    compare(spark, changes, 13)


def test_a_hundred_thousand_changes_of_one_vote(spark):
    changes = log(100_000, 1.0, 3)
    compare(spark, changes, 8)


def test_no_changes_and_no_votes(spark):
    rules, labs = setting(spark)
    empty, none = spark.createDataFrame([], STORED), spark.createDataFrame([], CHANGES)
    assert [df.collect() for df in V.vote_changes(empty, none, rules, labs)] == [[], []]
    decided, errors = V.vote_changes(spark.createDataFrame(STORED_ROWS, STORED), none, rules, labs)
    assert {tuple(r)[:5] for r in decided.collect()} == set(STORED_ROWS) and errors.collect() == []


def test_any_split_into_batches_gives_the_same_table(spark, tmp_path):
    rules, labs = setting(spark)
    changes = log(400, 0.3, 4)
    expected, failed = plain([], changes)
    for name, cuts in (("one", [0, 400]), ("some", [0, 7, 8, 250, 400])):
        store = vote_store(spark, str(tmp_path / name), buckets=4)
        errors = []
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            part = spark.createDataFrame(changes[low:high], CHANGES)
            errors += apply_changes(store, part, rules, labs, ("log", i)).collect()
            assert apply_changes(store, part, rules, labs, ("log", i)) is None  # a batch counts once
        assert {tuple(r) for r in store.read().select(*[c.split()[0] for c in VOTES.split(", ")]).collect()} == expected
        assert sorted((tuple(r) for r in errors), key=str) == failed


def test_the_log_as_a_stream(spark, tmp_path):
    rules, labs = setting(spark)
    changes = log(120, 0.3, 5)
    table, folder = str(tmp_path / "votes"), str(tmp_path / "log")
    for low in (0, 50):
        spark.createDataFrame(changes[low : low + 50 if low == 0 else 120], CHANGES).coalesce(1).write.mode("append").parquet(folder)
        start_votes(spark, folder, table, rules, labs, str(tmp_path / "ck"), buckets=4).awaitTermination()
    assert {tuple(r) for r in stream.vote_store(spark, table, 4).read().collect()} == plain([], changes)[0]
