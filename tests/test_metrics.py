import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.labels import LABELS
from lectern.operators import agreement, portfolio, rates


def metric(spark, labels, words=150):
    df = spark.createDataFrame([("c", "e", x) for x in labels], "condition string, email string, label string")
    return rates.condition_metrics(df, spark.createDataFrame([("e", words)], "email string, n_words int"), ["condition"], "email", "label").first()


def test_rates(spark):
    assert metric(spark, ["supported", "unsupported", "contradicted", "overstated"]).severe_error_rate == 0.5
    assert metric(spark, ["supported", "subjective_or_generic", "outside_evidence_scope", "contradicted"]).severe_error_rate == 0.5
    r = metric(spark, ["supported"] * 3)
    assert r.supported_density == 2.0 and r.email_severe_rate == 0.0
    r = metric(spark, ["outside_evidence_scope", None], 0)
    assert r.severe_error_rate is None and r.supported_density is None and r.email_severe_rate is None and r.n_claims == 2


def test_leave_one_out_and_edits(spark):
    t = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 4)], "g string, x string, n int")
    assert {r.x: r.n for r in rates.leave_one_out(t, "g", "x", ["n"]).collect()} == {"a": 6, "b": 5, "c": 3}
    e = spark.createDataFrame([("r", x) for x in ("delete", "soften", "rewrite", "keep")], "r string, a string")
    assert tuple(rates.edit_rates(e, ["r"], "a").first())[1:] == (4, 1, 0.25, 0.5)


def test_kappa(spark):
    def k(pairs):
        return agreement.cohen_kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()

    assert k([("s", "s"), ("s", "u"), ("u", "u"), ("u", "s")]).kappa == 0.0
    r = k([("s", "s"), ("s", "s")])
    assert r.kappa == 1.0 and r.kappa_se is None
    none = k([("s", None)])
    assert none.kappa is None and none.n_pairs is None


def test_confusion_and_scores(spark):
    p = spark.createDataFrame([("supported", "supported"), ("supported", "overstated"), ("contradicted", "overstated"), (None, "supported")], "h string, m string")
    m = {r.label: r.asDict() for r in agreement.confusion_matrix(p, "h", "m", LABELS).collect()}
    assert len(m) == 7 and m["supported"]["overstated"] == 1 and m["supported"]["row_total"] == 2 and m["unsupported"]["row_total"] == 0
    s = {r.label: (r.precision, r.recall, r.f1) for r in agreement.per_label_scores(p, "h", "m").collect()}
    assert s["supported"] == (1.0, 0.5, pytest.approx(2 / 3)) and s["contradicted"] == (None, 0.0, None) and s["overstated"] == (0.0, None, None)
    assert agreement.disagreement(p, "h", "m").first().lenient == 1


def test_portfolio_measures(spark):
    c = spark.createDataFrame([("p", "F1", 3), ("p", "F2", 1), ("q", "F1", 5)], "o string, c string, n int")
    e = {r.o: r.e for r in portfolio.normalized_entropy(c, ["o"], "n", "e").collect()}
    assert e["p"] == pytest.approx(0.8112781244591328) and e["q"] == 0.0
    r = spark.range(1).select(portfolio.weighted_available_mean({"a": (F.lit(1.0), 0.3), "b": (F.lit(None), 0.5), "c": (F.lit(0.0), 0.1)}).alias("x")).first().x
    assert r.value == pytest.approx(0.75) and r.available == ["a", "c"] and r.missing == ["b"]
    assert spark.range(1).select(portfolio.weighted_available_mean({"a": (F.lit(None), 0.3)})["value"].alias("x")).first().x is None


def test_pair_similarity_without_pairs(spark):
    rnd = random.Random(3)
    items = [("hot" if rnd.random() < 0.7 else "b", None if rnd.random() < 0.1 else f"T{rnd.randrange(1000, 1120)}") for _ in range(120)]
    rows = [(o, t, t and t[:-1], t and t[:-2]) for o, t in items]
    df = spark.createDataFrame(rows, "o string, t string, s string, f string").groupBy("o", "t", "s", "f").agg(F.count("*").alias("n"))
    got = {r.o: r.x for r in portfolio.pair_similarity(df, ["o"], [("t", 1.0), ("s", 0.85), ("f", 0.7)], "n", "x").collect()}
    for owner in ("hot", "b"):
        ts = [t for o, t in items if o == owner]
        scores = [0 if a is None or b is None else 1.0 if a == b else 0.85 if a[:-1] == b[:-1] else 0.7 if a[:-2] == b[:-2] else 0 for i, a in enumerate(ts) for b in ts[i + 1 :]]
        assert got[owner] == pytest.approx(sum(scores) / len(scores)) and not math.isnan(got[owner]) and json.dumps(got[owner])


def test_wide_counts_has_every_condition_there_is(spark):
    from lectern.operators.rates import wide_counts

    df = spark.createDataFrame([("f", "A", 1), ("f", "E 5", 0), ("g", "A", 1), ("g", None, 1), ("f", "A", 1)], "field string, condition string, s int")
    got = {r.field: r.asDict() for r in wide_counts(df, "field", "condition", {"n": F.count(F.lit(1)), "s": F.count_if(F.col("s") == 1)}).collect()}
    assert got == {"f": {"field": "f", "A_n": 2, "A_s": 2, "E 5_n": 1, "E 5_s": 0}, "g": {"field": "g", "A_n": 1, "A_s": 1, "E 5_n": 0, "E 5_s": 0}}
    assert wide_counts(df, "field", "condition", {"n": F.count(F.lit(1))}).columns == ["field", "A_n", "E 5_n"]
    assert wide_counts(df.limit(0), "field", "condition", {"n": F.count(F.lit(1))}).count() == 0
