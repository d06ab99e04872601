from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.sampling import exchanged, sample_report, sample_to_targets, seats_of_cells

TARGETS = "g string, dimension string, category string, sample_size int, target_count int, target_share double, minimum_count int"


def targets(spark, size=20):
    rows = [("p", "a", "x", size, size // 2, 0.5, 1), ("p", "a", "y", size, size // 4, 0.25, 1), ("p", "a", "z", size, size // 4, 0.25, 2), ("p", "b", "u", size, size * 3 // 4, 0.75, 1), ("p", "b", "v", size, size // 4, 0.25, 1)]
    return spark.createDataFrame(rows, TARGETS)


def people(spark, n, cats=("x", "y", "z")):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("p").alias("g"), F.element_at(F.array(*map(F.lit, cats)), (F.col("id") % len(cats) + 1).cast("int")).alias("a"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("b"), F.lit(1).alias("seat"), F.lit(0).alias("r"))


def test_shares_are_met_exactly_where_they_can_be(spark):
    out = sample_to_targets(people(spark, 3000), targets(spark), "k", "g", ["a", "b"]).collect()
    assert len(out) == 20 and len({r.k for r in out}) == 20
    a, b = Counter(r.a for r in out), Counter(r.b for r in out)
    assert all(abs(a[c] - t) <= 1 for c, t in (("x", 10), ("y", 5), ("z", 5))) and abs(b["u"] - 15) <= 1


def test_the_draw_does_not_depend_on_partitions(spark):
    one = sample_to_targets(people(spark, 500).repartition(1), targets(spark), "k", "g", ["a", "b"]).select("k").collect()
    many = sample_to_targets(people(spark, 500).repartition(7), targets(spark), "k", "g", ["a", "b"]).select("k").collect()
    assert {r.k for r in one} == {r.k for r in many}


def test_exhausted_categories_give_their_seats_and_minimums_hold(spark):
    few = people(spark, 300, ("x", "y")).union(people(spark, 1, ("z",)).withColumn("k", F.lit("only-z")))
    out = sample_to_targets(few, targets(spark), "k", "g", ["a", "b"])
    rows = out.collect()
    assert len(rows) == 20 and sum(r.a == "z" for r in rows) == 1
    rep = {(r.dimension, r.category): r for r in sample_report(few, out, targets(spark), "g", ["a", "b"]).collect()}
    assert rep["a", "z"].reason == "too_few" and rep["a", "x"].reason is None and rep["a", "z"].drawn == 1


def test_nulls_unknown_categories_missing_pools_and_empty_tables(spark):
    rows = spark.createDataFrame([("1", "p", None, "u"), ("2", "p", "odd", "v"), ("3", None, "x", "u"), ("4", "q", "x", "u"), ("5", "p", "x", None)], "k string, g string, a string, b string")
    out = sample_to_targets(rows, targets(spark), "k", "g", ["a", "b"])
    assert {r.k for r in out.collect()} == {"1", "2", "5"}
    empty = rows.filter(F.lit(False))
    assert sample_to_targets(empty, targets(spark), "k", "g", ["a", "b"]).count() == 0
    rep = sample_report(empty, sample_to_targets(empty, targets(spark), "k", "g", ["a", "b"]), targets(spark), "g", ["a", "b"]).collect()
    assert len(rep) == 5 and all(r.reason == "too_few" for r in rep)
    assert sample_to_targets(rows, targets(spark).filter(F.lit(False)), "k", "g", ["a", "b"]).count() == 0


def test_seats_against_a_ranking_of_all_priorities():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 7))
        available, target = rng.integers(0, 9, n), rng.random(n) * 4 + 0.01
        least, size = rng.integers(0, 3, n), int(rng.integers(0, 20))
        rows = sorted((p > min(least[c], available[c]), (p - 0.5) / target[c], c) for c in range(n) for p in range(1, available[c] + 1))
        want = np.bincount([c for *_, c in rows[:size]], minlength=n)
        assert (seats_of_cells(available, target, size, least) == want).all()


def test_exchanges_meet_what_can_be_met():
    # Cells (x,u) (x,v) (y,u) (y,v); goals x 5, y 5, u 5, v 5.
    member = np.array([[1, 1, 0, 0], [0, 0, 1, 1], [1, 0, 1, 0], [0, 1, 0, 1]])
    goal, zero = np.array([5, 5, 5, 5]), np.zeros(4, np.int64)
    assert (member @ exchanged(np.array([6, 0, 0, 4]), zero, np.array([6, 5, 0, 5]), member, goal) == goal).all()
    # Only two moves together help: (x,u) to (z,u) and (z,v) to (x,v) in a third category without a goal.
    member = np.array([[1, 1, 0, 0], [1, 0, 1, 0]])
    out = exchanged(np.array([0, 3, 3, 0]), zero, np.array([3, 3, 3, 3]), member, np.array([3, 3]))
    assert (member @ out >= 3).all() and out.sum() == 6
    held = exchanged(np.array([3, 0]), np.array([3, 0]), np.array([9, 9]), np.array([[0, 1]]), np.array([2]))
    assert held.tolist() == [3, 0]
    many = exchanged(np.array([1_000_000, 0]), np.zeros(2, np.int64), np.array([10**6, 10**6]), np.array([[1, 0], [0, 1]]), np.array([500_000, 500_000]))
    assert many.tolist() == [500_000, 500_000]


def test_rounding_is_repaired_and_joint_misses_are_named(spark):
    rows = [(f"{a}{b}{i}", "p", a, b) for a, b, n in (("x", "u", 10), ("x", "v", 10), ("y", "u", 0), ("y", "v", 10), ("z", "u", 10), ("z", "v", 10)) for i in range(n)]
    records = spark.createDataFrame(rows, "k string, g string, a string, b string")
    out = sample_to_targets(records, targets(spark), "k", "g", ["a", "b"])
    rep = {(r.dimension, r.category): r for r in sample_report(records, out, targets(spark), "g", ["a", "b"]).collect()}
    assert sum(r.short_of_target for r in rep.values()) == 0 and out.count() == 20
    # All of x is v, so that 10 of x leave no room for 15 of u: enough of each, but not together.
    joint = records.filter("a <> 'x' OR b = 'v'")
    joint = joint.unionByName(joint.filter("a = 'z' AND b = 'u'").withColumn("k", F.concat(F.lit("again"), "k")))
    out = sample_to_targets(joint, targets(spark), "k", "g", ["a", "b"])
    rep = [r for r in sample_report(joint, out, targets(spark), "g", ["a", "b"]).collect() if r.reason]
    assert rep and {r.reason for r in rep} == {"jointly"}


def test_a_hot_cell_is_placed_by_several_tasks(spark):
    hot = people(spark, 20_000).withColumn("a", F.lit("x")).unionByName(people(spark, 300).withColumn("k", F.concat(F.lit("o"), "k")))
    out = sample_to_targets(hot, targets(spark, 4000), "k", "g", ["a", "b"])
    assert out.count() == 4000 and out.filter("a <> 'x'").count() == 200
