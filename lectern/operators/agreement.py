"""Agreement of two raters, all from the k by k table of joint counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.labels import NON_FACTUAL, SEVERE


def joint_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n); rows with a null label aren't pairs."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n_pairs, raw agreement, kappa, its asymptotic standard error and Wald interval.

    No pairs: all null.  Expected agreement 1: kappa is 1 if the raters agree, else 0, and has no error.
    """
    j = joint_counts(pairs, a, b)
    rows = j.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("ra"))
    cols = j.groupBy(F.col("b").alias("x")).agg(F.sum("n").alias("cb"))
    margins = rows.join(cols, "x", "full").fillna(0, ["ra", "cb"])
    total = j.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("same"))
    pe = margins.agg(F.sum(F.col("ra") * F.col("cb").cast("double")).alias("rc"))
    base = total.crossJoin(F.broadcast(pe)).select("t", (F.col("same") / F.col("t")).alias("po"), (F.col("rc") / (F.col("t") * F.col("t"))).alias("pe"))  # one row each
    k = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).when(F.col("po") == 1, 1.0).when(F.col("pe").isNotNull(), 0.0)
    base = base.withColumn("kappa", k)
    # Cells with both margins, for the variance of kappa (Fleiss, Cohen and Everitt).
    cells = j.join(rows.select(F.col("x").alias("a"), "ra"), "a").join(cols.select(F.col("x").alias("b"), "cb"), "b")
    other = margins.select(F.col("x"), F.col("cb").alias("ca"), F.col("ra").alias("rb"))
    cells = cells.join(other.select(F.col("x").alias("a"), "ca"), "a").join(other.select(F.col("x").alias("b"), "rb"), "b").crossJoin(F.broadcast(base))  # one row
    p, pa, pb = F.col("n") / F.col("t"), F.col("ra") / F.col("t"), F.col("cb") / F.col("t")
    qa, qb = F.col("ca") / F.col("t"), F.col("rb") / F.col("t")  # margins of the other rater
    on = F.when(F.col("a") == F.col("b"), p * F.pow(1 - (pa + pb) * (1 - F.col("kappa")), 2)).otherwise(0.0)
    off = F.when(F.col("a") != F.col("b"), p * F.pow(qa + qb, 2)).otherwise(0.0)
    parts = cells.agg(F.sum(on).alias("on"), F.sum(off).alias("off"))
    out = base.crossJoin(F.broadcast(parts))  # one row each
    variance = (F.col("on") + F.pow(1 - F.col("kappa"), 2) * F.col("off") - F.pow(F.col("kappa") - F.col("pe") * (1 - F.col("kappa")), 2)) / (F.col("t") * F.pow(1 - F.col("pe"), 2))
    se = F.when(F.col("pe") < 1, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return out.select(
        F.col("t").cast("long").alias("n_pairs"), F.col("po").alias("raw_agreement"), "kappa", se.alias("kappa_se"),
        (F.col("kappa") - 1.959963984540054 * se).alias("kappa_low"), (F.col("kappa") + 1.959963984540054 * se).alias("kappa_high"),
    )


def confusion_matrix(pairs: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """A row per label of ``a``, a column per label of ``b``, zero cells filled in, and the row's total."""
    spark = pairs.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "label string")
    wide = joint_counts(pairs, a, b).groupBy(F.col("a").alias("label")).pivot("b", list(labels)).sum("n")
    filled = every.join(wide, "label", "left").fillna(0, list(labels))
    return filled.withColumn("row_total", sum((F.col(x) for x in labels), F.lit(0).cast("long")))


def per_label_scores(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each label met on either side; null without a denominator, F1 0 where one is 0."""
    j = joint_counts(pairs, truth, guess)
    each = j.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("label"), "a", "b", "n")
    hit = F.sum(F.when((F.col("a") == F.col("label")) & (F.col("b") == F.col("label")), F.col("n")).otherwise(0)).alias("hit")
    s = each.groupBy("label").agg(hit, F.sum(F.when(F.col("b") == F.col("label"), F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(F.col("a") == F.col("label"), F.col("n")).otherwise(0)).alias("true"))
    p, r = F.try_divide(F.col("hit").cast("double"), F.col("guessed")), F.try_divide(F.col("hit").cast("double"), F.col("true"))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r)))
    return s.select("label", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def disagreement(pairs: DataFrame, human: str, machine: str) -> DataFrame:
    """One row: agreeing pairs, machine more lenient or stricter on severity, other disagreement, severe ones missed."""
    j = joint_counts(pairs, human, machine)
    hs, ms, same = F.col("a").isin(*SEVERE), F.col("b").isin(*SEVERE), F.col("a") == F.col("b")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    return j.agg(
        n(same).alias("agree"), n(~same & hs & ~ms).alias("lenient"), n(~same & ~hs & ms).alias("strict"), n(~same & (hs == ms)).alias("orthogonal"),
        n(hs & F.col("b").isin(*NON_FACTUAL)).alias("dropped_severe"), F.try_divide(n((F.col("a") == "supported") & (F.col("b") == "supported")).cast("double"), n(F.col("b") == "supported")).alias("supported_precision"),
    )
