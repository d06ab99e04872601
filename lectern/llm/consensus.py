"""Problem 3: one label per item from annotators who disagree, by triplets of agreement rates.

With agreement rates corrected for chance, ``M_ij = z_i * z_j`` for annotators that err independently, so that
``z_i^2 = M_ij * M_ik / M_jk`` for every triplet.  To keep the work linear in the number of votes, annotators are
hashed into a fixed number of pools and a triplet is (annotator, pool, pool): the identity holds for the mean of a
pool as for one annotator.  ``z_i^2`` is the least-squares ratio over all pairs of other pools, weighted by the
items behind them; its sign is that of the annotator's agreement with everybody else.  Every item counts the same,
however many votes it has: hard items tend to get more votes, and by pairs they would outweigh all others.

Votes are then added with log-odds weights, twice.  First those of the accuracies, ``ln(a (k-1) / (1-a))``, which give
every item a posterior.  An accuracy says nothing of what somebody's errors look like, though: a vote of one who calls
nearly everything "supported" means little when it is that, and much when it isn't.  So the posteriors are counted by
annotator, posterior label and vote, drawn towards the accuracy, and the votes are added again with the weights ``ln
P(vote | label)`` of these rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Pools of annotators; their agreement matrix has at most POOLS * POOLS rows, which bounds what the driver sees.
POOLS = 64
#: Accuracies are drawn towards the mean as if this many more votes had been seen.
SHRINK = 10.0
BOUND = 0.02


def _solver(pools: np.ndarray, weight: np.ndarray, chance: float, mean_z: float):
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Accuracies of many annotators at once; ``met`` lists (pool, total, agree), at most one per pool."""
        for f in frames:
            n, agree = np.zeros((len(f), POOLS)), np.zeros((len(f), POOLS))
            for i, met in enumerate(f["met"]):
                for x in met:
                    n[i, x["other"]], agree[i, x["other"]] = x["total"], x["agree"]
            m = np.where(n > 0, (agree / np.maximum(n, 1e-12) - chance) / (1 - chance), 0.0)
            w = np.minimum(np.minimum(n[:, :, None], n[:, None, :]), weight)
            w[:, np.arange(POOLS), np.arange(POOLS)] = 0
            top, bottom = np.einsum("aij,ai,aj,ij->a", w, m, m, pools), np.einsum("aij,ij->a", w, pools**2)
            size = np.sqrt(np.clip(top / np.maximum(bottom, 1e-300), 0.0, 1.0)) * np.where((n * m).sum(1) >= 0, 1.0, -1.0)
            votes = f["votes"].to_numpy(float)
            z = (np.where(bottom > 0, size, mean_z) * votes + mean_z * SHRINK) / (votes + SHRINK)
            yield f[["annotator", "votes"]].assign(accuracy=np.clip(z * (1 - chance) + chance, BOUND, 1 - BOUND))

    return solve


def annotator_reliability(votes: DataFrame, n_labels: int) -> DataFrame:
    """(annotator, votes, accuracy) of ``votes(item, annotator, label)``, at most one row per item and annotator.

    Defined results: an annotator who shares no item with annotators of at least two other pools gets the mean
    accuracy; one who agrees less than chance gets an accuracy below chance, and so negative weight.  Votes with a null
    in any of the three columns don't count; no votes give an empty frame; further columns are ignored.
    """
    votes = votes.select("item", "annotator", "label").dropna()
    sizes = votes.groupBy("item").agg(F.count("*").alias("in_item")).filter("in_item > 1")
    pooled = votes.withColumn("pool", F.pmod(F.xxhash64("annotator"), F.lit(POOLS)).cast("int"))
    cells = pooled.groupBy("item", F.col("pool").alias("other"), F.col("label").alias("their_label")).agg(F.count("*").alias("n"))
    met = pooled.join(sizes, "item").join(cells, "item").filter(F.col("pool") != F.col("other")).withColumn("w", F.col("n") / (F.col("in_item") * (F.col("in_item") - 1)))
    rates = met.groupBy("annotator", "pool", "other").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("label") == F.col("their_label"), F.col("w")).otherwise(0.0)).alias("agree"))
    rates = materialize(rates, "consensus-rates")
    between = rates.groupBy("pool", "other").agg(F.sum("total").alias("total"), F.sum("agree").alias("agree")).toPandas()
    shares = votes.groupBy("label").agg(F.count("*").alias("n")).toPandas()["n"].to_numpy(float)  # one row per label
    chance = float(((shares / max(shares.sum(), 1)) ** 2).sum()) if len(shares) else 1.0 / n_labels
    chance = min(max(chance, 1.0 / n_labels), 0.95)
    m, n = np.zeros((POOLS, POOLS)), np.zeros((POOLS, POOLS))
    p, o = between["pool"].to_numpy(int), between["other"].to_numpy(int)
    n[p, o] = between["total"].to_numpy(float)
    m[p, o] = (between["agree"].to_numpy(float) / np.maximum(n[p, o], 1e-12) - chance) / (1 - chance)
    overall = float((n * m).sum() / n.sum()) if n.sum() else 0.25
    counts = votes.groupBy("annotator").agg(F.count("*").alias("votes"))
    met = rates.groupBy("annotator").agg(F.collect_list(F.struct("other", "total", "agree")).alias("met"))  # one per pool
    none = F.array().cast("array<struct<other: int, total: double, agree: double>>")
    rows = counts.join(met, "annotator", "left").select("annotator", "votes", F.coalesce("met", none).alias("met"))
    return rows.mapInPandas(_solver(m, n, chance, float(np.sqrt(max(overall, 0.01)))), f"annotator {votes.schema['annotator'].dataType.simpleString()}, votes long, accuracy double")


def posteriors(votes: DataFrame, reliability: DataFrame, n_labels: int) -> DataFrame:
    """(item, truth, q): posterior of each label an item has votes for, by the log-odds of accuracies."""
    weight = F.log(F.col("accuracy") * (n_labels - 1) / (1 - F.col("accuracy")))
    scored = votes.join(reliability.select("annotator", weight.alias("w")), "annotator")
    cells = scored.groupBy("item", F.col("label").alias("truth")).agg(F.sum("w").alias("w"))
    per = cells.groupBy("item").agg(F.max("w").alias("top"), F.collect_list(F.struct("truth", "w")).alias("all"))  # one per label
    others = F.greatest(F.lit(n_labels) - F.size("all"), F.lit(0)) * F.exp(F.least(-F.col("top"), F.lit(50.0)))
    whole = F.aggregate("all", others, lambda acc, x: acc + F.exp(x["w"] - F.col("top")))
    each = per.select("item", F.explode("all").alias("x"), "top", whole.alias("whole"))
    return each.select("item", "x.truth", (F.exp(F.col("x.w") - F.col("top")) / F.col("whole")).alias("q"))


def vote_weights(votes: DataFrame, reliability: DataFrame, n_labels: int, labels: list) -> tuple[DataFrame, list[float]]:
    """(annotator, label, w0, w1, ..): log P(vote | label) for every label in ``labels``; and the labels' log shares.

    A row for each annotator and label voted by anybody; rates are drawn towards the accuracy by SHRINK votes."""
    q = materialize(posteriors(votes, reliability, n_labels), "consensus-posteriors")
    share = {r["truth"]: r["n"] for r in q.groupBy("truth").agg(F.sum("q").alias("n")).collect()}  # a row per label
    whole = sum(share.values())
    logs = [float(np.log((share.get(x, 0.0) + 0.5) / (whole + 0.5 * len(labels)))) for x in labels]
    seen = votes.join(q, "item").groupBy("annotator", "label")
    counts = seen.agg(*[F.sum(F.when(F.col("truth") == F.lit(x), F.col("q")).otherwise(0.0)).alias(f"n{i}") for i, x in enumerate(labels)])
    totals = counts.groupBy("annotator").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(labels))])
    a = F.col("accuracy")
    base = lambda x: F.when(F.col("label") == F.lit(x), a).otherwise((1 - a) / max(1, n_labels - 1))
    w = [F.log((F.col(f"n{i}") + SHRINK * base(x)) / (F.col(f"t{i}") + SHRINK)).alias(f"w{i}") for i, x in enumerate(labels)]
    return counts.join(totals, "annotator").join(reliability.select("annotator", "accuracy"), "annotator").select("annotator", "label", *w), logs


def consensus(votes: DataFrame, reliability: DataFrame, n_labels: int) -> DataFrame:
    """(item, label, n_votes, agreement, confidence) per item.

    ``agreement`` is the share of agreeing pairs among an item's votes (null for a single vote); ``confidence`` the
    posterior of the label among all that anybody voted for.  Equal scores go to the label commoner among all votes, then to the
    smaller one.  Votes with a null
    in any column don't count, nor do votes of annotators without a reliability; no votes give an empty frame.
    """
    votes = votes.select("item", "annotator", "label").dropna()
    common = {r["label"]: r["n"] for r in votes.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per label
    labels = sorted(common, key=lambda x: (-common[x], x))  # equal scores go to the first of these
    kind, item = votes.schema["label"].dataType, votes.schema["item"].dataType.simpleString()
    if not labels:
        return votes.sparkSession.createDataFrame([], f"item {item}, label {kind.simpleString()}, n_votes long, agreement double, confidence double")
    weights, logs = vote_weights(votes, reliability, n_labels, labels)
    scored = votes.join(weights, ["annotator", "label"])
    cells = scored.groupBy("item", "label").agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(labels))])
    per = cells.groupBy("item").agg(F.sum("n").alias("n_votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(labels))])
    scores = F.array(*[F.round(F.col(f"w{i}") + F.lit(logs[i]), 9) for i in range(len(labels))]).cast("array<double>")
    ranked = per.select("item", "n_votes", "same", scores.alias("s")).withColumn("top", F.array_max("s"))
    named = F.array(*[F.lit(x).cast(kind) for x in labels])
    return ranked.select(
        "item", F.try_element_at(named, F.array_position("s", F.col("top")).cast("int")).alias("label"), "n_votes",
        F.try_divide(F.col("same").cast("double"), F.col("n_votes") * (F.col("n_votes") - 1)).alias("agreement"),
        (1 / F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))).alias("confidence"),
    )
