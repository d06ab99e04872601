import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.rank import cascading_midrank, first_rows, hash_rank_id, midrank, midrank_place, with_midrank, with_previous


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, float("nan"), 1.0, 2.0, 2.5, 3.0, 7.0, -4.0]), i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 6])
def test_midrank_against_brute_force(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, id long").repartition(parts)
    got = {r.id: r.p for r in with_midrank(df, ["g"], "v", "p").collect()}
    for g, v, i in data:
        pool = [x for h, x, _ in data if h == g and x is not None and x == x]
        want = None if v is None or v != v else 100 * (sum(x < v for x in pool) + 0.5 * sum(x == v for x in pool)) / len(pool)
        assert got[i] is None and want is None or abs(got[i] - want) < 1e-9


def test_midrank_goldens_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 20, 40)], "v int")
    assert {r.v: r.percentile for r in midrank(df, [], "v").collect()} == {10: 12.5, 20: 50.0, 40: 87.5}
    assert midrank(df.limit(1), [], "v").first().percentile == 50.0
    assert midrank(df.filter(F.lit(False)), [], "v").count() == 0


def test_places_previous_and_first_rows(spark):
    data = [(g, i) for g, _, i in rows(2)]
    df = spark.createDataFrame(data, "g string, id long").repartition(5)
    order = {}
    for g, i in sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        order.setdefault(g, []).append(i)
    place = {r.id: r.place for r in midrank_place(df, ["g"], ["id"]).collect()}
    prev = {r.id: r.prev_id for r in with_previous(df, ["g"], ["id"], ["id"]).collect()}
    first = {(r.g, r.id) for r in first_rows(df, ["g"], [F.col("id")], 3).collect()}
    for g, ids in order.items():
        assert [place[i] for i in ids] == list(range(1, len(ids) + 1))
        assert [prev[i] for i in ids] == [None, *ids[:-1]]
        assert {i for h, i in first if h == g} == set(ids[:3])


def test_anonymous_ids_ignore_row_order(spark):
    df = spark.createDataFrame([("CS", f"A{i}") for i in range(40)], "p string, k string")
    a = {r.k: r.anonymous_id for r in hash_rank_id(df, "p", "k", "v1").collect()}
    b = {r.k: r.anonymous_id for r in hash_rank_id(df.orderBy(F.desc("k")).repartition(3), "p", "k", "v1").collect()}
    assert a == b and sorted(a.values()) == [f"CS-{i:03d}" for i in range(1, 41)]


def test_cascade_against_brute_force(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["f", "g", None]), rnd.choice([2001, 2002, 2003, None]), rnd.choice(["d", None]), rnd.choice([None, float("nan"), *[float(x) for x in range(9)]]), i) for i in range(300)]
    data += [("f", 1990, "d", 5.0, 900), ("q", 1990, "e", 5.0, 901)]
    levels = [("fy", ["f", "y"]), ("dy", ["d", "y"]), ("y", ["y"]), ("all", [])]
    df = spark.createDataFrame(data, "f string, y int, d string, v double, id long").repartition(4)
    got = {r.id: (r.stratum, r.percentile) for r in cascading_midrank(df, levels, "v", 12).collect()}
    names = {"f": 0, "y": 1, "d": 2}
    known = lambda x: x is not None and x == x
    for row in data:
        for name, columns in levels:
            pool = [o[3] for o in data if known(o[3]) and all(o[names[c]] == row[names[c]] and row[names[c]] is not None for c in columns)]
            if not columns or (all(row[names[c]] is not None for c in columns) and len(pool) >= 12):
                break
        v = row[3]
        want = 100 * (sum(x < v for x in pool) + 0.5 * sum(x == v for x in pool)) / len(pool) if known(v) else None
        assert got[row[4]][0] == name and (want is None) == (got[row[4]][1] is None) and (want is None or abs(want - got[row[4]][1]) < 1e-9)
    assert {s for s, _ in got.values()} == {"fy", "dy", "y", "all"}
    with pytest.raises(ValueError):
        cascading_midrank(df, levels[:2], "v", 12)
