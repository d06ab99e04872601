import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.llm.mixing import filled, marginal_report, mix, mix_report, rake


def docs(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").when(F.col("id") % 40 == 9, "tiny").otherwise("unknown").alias("source"),
        F.when(F.col("id") % 3 == 0, "fr").otherwise("en").alias("lang"), (F.col("id") % 8).cast("int").alias("topic"), (F.col("id") % 97 + 1).cast("long").alias("n_tokens"), F.lit(1).alias("rate"))


TARGETS = pd.DataFrame({"source": ["big", "mid", "tiny", "none"], "target_share": [0.4, 0.4, 0.15, 0.05], "max_repeats": [2, 3, 2, 4]})


def test_shares_caps_and_report(spark):
    drawn, plan = mix(docs(spark), TARGETS, "k")
    rep = {r.source: r for r in mix_report(drawn, plan).collect()}
    assert rep["tiny"].is_short and rep["none"].is_short and not rep["big"].is_short and not rep["mid"].is_short
    for s in ("big", "mid"):
        assert abs(rep[s].mixed_tokens / rep[s].wanted - 1) < 0.03
    assert rep["tiny"].mixed_tokens == 2 * rep["tiny"].tokens and rep["none"].mixed_tokens == 0
    most = {r.source: r.m for r in drawn.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert all(most[s] <= m for s, m in zip(TARGETS["source"], TARGETS["max_repeats"]) if s in most) and "unknown" not in most
    lang = {r.lang: r.t for r in drawn.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(lang["fr"] / sum(lang.values()) - 1 / 3) < 0.02


def test_raking_keeps_margins():
    cells = pd.DataFrame([(s, la, t, 100 + 10 * i) for i, (s, la, t) in enumerate((s, la, t) for s in ("a", "b") for la in ("en", "fr") for t in (0, 1))], columns=["source", "lang", "topic", "tokens"])
    plan = rake(cells, pd.DataFrame({"source": ["a", "b"], "target_share": [0.7, 0.3], "max_repeats": [3, 3]}))
    w = plan.cells["rate"] * plan.cells["tokens"]
    total = cells["tokens"].sum()
    assert abs(w[plan.cells["source"] == "a"].sum() / total - 0.7) < 1e-6
    fr = cells["lang"] == "fr"
    assert abs(w[fr].sum() / w.sum() - cells["tokens"][fr].sum() / total) < 0.01


def test_empty_and_null_sources(spark):
    none = docs(spark, 50).withColumn("source", F.lit(None).cast("string"))
    for df in (none, none.filter(F.lit(False))):
        drawn, plan = mix(df, TARGETS, "k")
        assert drawn.count() == 0 and all(r.is_short for r in mix_report(drawn, plan).filter("target_share > 0 AND wanted > 0").collect())


def test_filled_keeps_caps_and_goals():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(1, 12)
        code = np.sort(rng.integers(0, 3, n))
        weight, cap = rng.random(n) + 0.01, rng.random(n) * 2 + 0.01
        goal = np.bincount(code, cap, 3) * rng.choice([0.2, 0.7, 1.0], 3)
        out = filled(weight, cap, code, goal)
        assert (out <= cap).all() and np.allclose(np.bincount(code, out, 3), goal)


def test_one_draw_for_a_source_of_any_size_and_any_partitioning(spark):
    big = spark.range(60_000).select(F.col("id").alias("k"), F.lit("big").alias("source"), F.lit("en").alias("lang"), F.lit(0).alias("topic"), (F.col("id") % 997 + 1).alias("n_tokens"))
    rest = big.filter("k < 600").withColumn("source", F.lit("mid")).withColumn("k", F.col("k") + 1_000_000)
    targets = pd.DataFrame({"source": ["big", "mid"], "target_share": [0.97, 0.03], "max_repeats": [1, 8]})
    draws = []
    for parts in (1, 9):
        drawn, plan = mix(big.unionByName(rest).repartition(parts), targets, "k")
        rep = {r.source: r for r in mix_report(drawn, plan).collect()}
        # One systematic draw is off by two documents at most, however large the source is.
        assert all(abs(rep[s].mixed_tokens - rep[s].wanted) <= 2 * 997 for s in rep)
        draws.append({(r.k, r.copies) for r in drawn.select("k", "copies").collect()})
    assert draws[0] == draws[1] and len(draws[0]) > 50_000


def test_smaller_mix_that_meets_all_shares_and_marginals(spark):
    drawn, plan = mix(docs(spark), TARGETS, "k", total="met")
    rep = {r.source: r for r in mix_report(drawn, plan).collect()}
    assert abs(rep["tiny"].mixed_tokens / rep["tiny"].wanted - 1) < 1e-9 and not rep["big"].is_short
    assert all(abs(rep[s].actual_share * 0.95 / rep[s].target_share - 1) < 0.03 for s in ("big", "mid", "tiny"))
    m = marginal_report(drawn, plan).collect()
    assert {r.dimension for r in m} == {"source", "lang", "topic"} and all(abs(r.actual_share - r.wanted_share) < 0.03 for r in m if r.dimension != "source")
    # All of tiny is of one topic, more than that topic's share of the corpus: raking can't meet both, and says so.
    assert plan.residual > 0.1
