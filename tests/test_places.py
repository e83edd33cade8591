"""Near street names against all pairs of a town; proposed and current points."""
import random

from pyspark.sql import functions as F

from scholargraph.operators import places as P

ADDRESS = "item_id long, street string, postcode string, town string"
PLACE = "street string, postcode string, town string, lat double, lng double, label string"


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def streets():
    rnd = random.Random(7)
    word = lambda low, high: "".join(rnd.choice("abc") for _ in range(rnd.randint(low, high)))
    names = ["rue de la " + word(3, 9) for _ in range(60)] + [word(1, 6) for _ in range(60)]
    town = lambda: rnd.choice(["A", "B"])
    places = [(n, "1", town(), float(i), float(-i), f"p{i:03}") for i, n in enumerate(names)] + [("", "1", "A", 500.0, 500.0, "A centre")]
    asked = []
    for i in range(300):
        n = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(n) + 1)
            n[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c", "z"])
        asked.append((i, "".join(n), "1", town()))
    return asked + [(900, None, "1", "A"), (901, "  ", "1", "B"), (902, "rue", None, "A"), (903, "abc", "1", None)], places


def test_near_streets_equal_all_pairs_of_a_town(spark):
    asked, places = streets()
    for k in (1, 2):
        got = P.geocode(spark.createDataFrame(asked, ADDRESS), spark.createDataFrame(places, PLACE), max_edits=k)
        rows = {r["item_id"]: (r["label"], r["level"]) for r in got.collect()}
        for i, street, postcode, town in asked:
            name = (street or "").strip()
            near = sorted((edits(name, p[0]), p[5]) for p in places if name and p[0] and (p[1], p[2]) == (postcode, town))
            if near and near[0][0] <= k:
                expected = (near[0][1], "near" if near[0][0] else "street")
            else:
                expected = ("A centre", "town") if (postcode, town) == ("1", "A") else None
            assert rows.get(i) == expected, (i, name, k)


def test_no_address_meets_all_streets_of_its_town(spark):
    """Every join of the plan has a street or a gram among its keys, or one row per town on a side."""
    asked, places = streets()
    a = spark.createDataFrame([(p, t, s) for _, s, p, t in asked if s], "_pc string, _tw string, _st string")
    g = spark.createDataFrame([(p[1], p[2], p[0], p[3], p[4], p[5]) for p in places], "_pc string, _tw string, _st string, lat double, lng double, label string")
    plan = P.near_streets(a.distinct(), g)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line[line.index("Join ") :] for line in plan.splitlines() if "Join " in line]
    assert len(joins) >= 3
    assert all("gram" in j or "_near" in j or j.startswith("Join LeftSemi") for j in joins)


def test_points_are_compared(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "item_id long")
    addresses = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, " "), (5, "e")], "item_id long, address string")
    proposed = spark.createDataFrame([(1, 48.0, 2.0, "x"), (2, 48.0, 2.0, "x"), (3, 48.0, 2.0, "x"), (4, 48.0, 2.0, "x")], "item_id long, lat double, lng double, label string")
    features = spark.createDataFrame([(1, 48.0, 2.0004), (2, 49.0, 2.0), (5, 1.0, 1.0)], "item_id long, lat double, lng double")
    rows = {r["item_id"]: r for r in P.compare_points(items, addresses, proposed, features).collect()}
    assert {i: r["status"] for i, r in rows.items()} == {1: "same", 2: "moved", 3: "new", 4: "no address", 5: "no result", 6: "no address"}
    assert abs(rows[2]["metres"] - 111_195) < 5 and rows[3]["metres"] is None and rows[5]["has_feature"]
    far = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    assert abs(far.select(P.distance(*[F.col(c) for c in "abcd"])).first()[0] - 3.141592653589793 * P.EARTH_RADIUS) < 1
