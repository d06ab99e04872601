import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import topn
from lectern.llm.topn import LoserTree, merge_runs, top_n_per_group


def brute(rows, n):
    out, by = [], {}
    for g, s, t in rows:
        if g is not None and t is not None and s is not None and not math.isnan(s):
            by.setdefault(g, []).append((-s, t))
    for g, items in by.items():
        out += [(g, -s, t) for s, t in sorted(items)[:n]]
    return sorted(out)


def test_loser_tree_merges_in_order():
    rnd = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(6))) for _ in range(k)]
        at = [0] * k
        tree, out = LoserTree([r[0] if r else None for r in runs]), []
        while (w := tree.winner()) is not None:
            out.append(runs[w][at[w]])
            at[w] += 1
            tree.replace(w, runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_to_the_next_group():
    runs = [(["a"] * 3 + ["b"], [1, 2, 3, 1], [1, 1, 1, 1]), (["a", "c"], [0, 5], [9, 9])]
    assert [(runs[r][0][i], runs[r][1][i]) for r, i in merge_runs(runs, 2)] == [("a", 0), ("a", 1), ("b", 1), ("c", 5)]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force_with_nulls_ties_and_a_hot_group(spark, parts):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None]), rnd.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.5, -1.0]), rnd.choice(["x", "y", "z", None])) for _ in range(600)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g string, s double, t string").repartition(parts)
    got = sorted(tuple(r) for r in top_n_per_group(df, "g", "s", "t", 4).select("g", "s", "t").collect())
    assert got == brute(rows, 4)


def test_empty_frame_clashing_names_and_bad_n(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 7, "v")], "__g string, __run double, c0 int, __s int, `odd name` string")
    out = top_n_per_group(df, "__g", "__run", "c0", 2)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [("a", 1.0, 1, 7, "v")]
    assert top_n_per_group(df.filter(F.lit(False)), "__g", "__run", "c0", 2).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "__g", "__run", "c0", 0)


def test_several_levels_of_runs_and_a_group_of_half_the_rows(spark, monkeypatch):
    monkeypatch.setattr(topn, "FAN_IN", 2)
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(300)}", float(rnd.randrange(50)), f"t{rnd.randrange(200):03d}") for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, s double, t string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted(tuple(r) for r in top_n_per_group(df, "g", "s", "t", 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 5)
