import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.claims import LABELS, label
from lectern.llm.consensus import annotator_reliability, consensus


def simulated(seed=5, items=900):
    rnd = random.Random(seed)
    skill = {f"a{i}": s for i, s in enumerate([0.95, 0.9, 0.9, 0.85, 0.8, 0.6, 0.5, 0.3, 0.15])}
    truth, votes = {}, []
    for i in range(items):
        truth[i] = rnd.choice(LABELS)
        for a in rnd.sample(sorted(skill), 4):
            votes.append((i, a, truth[i] if rnd.random() < skill[a] else rnd.choice([x for x in LABELS if x != truth[i]])))
    return skill, truth, votes


def test_reliabilities_and_labels_on_held_out_truth(spark):
    skill, truth, votes = simulated()
    v = spark.createDataFrame(votes, "item long, annotator string, label string")
    r = {x.annotator: x.accuracy for x in annotator_reliability(v, len(LABELS)).collect()}
    assert np.mean([abs(r[a] - s) for a, s in skill.items()]) < 0.08
    out = consensus(v, annotator_reliability(v, len(LABELS)), len(LABELS)).collect()
    ours = np.mean([x.label == truth[x.item] for x in out])
    majority = {}
    for i, _, lab in sorted(votes):
        majority.setdefault(i, []).append(lab)
    plain = np.mean([max(sorted(set(m)), key=m.count) == truth[i] for i, m in majority.items()])
    assert len(out) == len(truth) and ours > plain + 0.02 and ours > 0.9


def test_single_votes_ties_nulls_and_empty(spark):
    v = spark.createDataFrame([(1, "a", "supported"), (2, "a", "overstated"), (2, "b", "supported"), (3, None, "supported"), (None, "a", "supported"), (4, "b", None)], "item long, annotator string, label string").withColumn("n", F.lit(1))
    r = annotator_reliability(v, len(LABELS))
    out = {x.item: x for x in consensus(v, r, len(LABELS)).collect()}
    assert set(out) == {1, 2} and out[1].agreement is None and out[2].agreement == 0.0 and out[2].label == "supported"
    empty = v.filter(F.lit(False))
    assert annotator_reliability(empty, 7).count() == 0 and consensus(empty, annotator_reliability(empty, 7), 7).count() == 0


def test_spellings(spark):
    cases = {"Suported": "supported", " PARTIALLY-supported ": "partially_supported", "un-supported": "unsupported", "subjective / generic": "subjective_or_generic", "n/a": None, "?": None, "": None, None: None, "Over stated": "overstated", "subjective or generic": "subjective_or_generic"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", label("s").alias("l"))
    got = {r.s: r.l for r in df.collect()}
    assert got == cases
