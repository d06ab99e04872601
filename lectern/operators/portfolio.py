"""Measures of a portfolio: the papers of one owner.  Everything comes from counts, so no owner's papers meet in a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import as_column


def normalized_entropy(counts: DataFrame, group: Sequence[str], n: str, name: str) -> DataFrame:
    """Shannon entropy of the classes of each group (a row per class) over log2 of their number; 0 for one class."""
    x = F.col(n).cast("double")
    # H = log2 N - sum(n log2 n) / N, from two sums, so that partial aggregation does the work.
    sums = counts.groupBy(*group).agg(F.sum(x).alias("__t"), F.sum(x * F.log2(x)).alias("__s"), F.count("*").alias("__k"))
    h = F.when(F.col("__k") == 1, 0.0).otherwise((F.log2("__t") - F.col("__s") / F.col("__t")) / F.log2("__k"))
    return sums.select(*group, h.alias(name), F.col("__k").alias(f"{name}_classes"))


def weighted_available_mean(parts: Mapping[str, tuple[Column | str, float]]) -> Column:
    """struct(value, denominator, available, missing): weighted mean over the parts that aren't null."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), as_column(c).cast("double").alias("v"), F.lit(w).alias("w")) for n, (c, w) in parts.items()])
    there = F.filter(entries, lambda x: x["v"].isNotNull())
    weight = F.aggregate(there, F.lit(0.0), lambda a, x: a + x["w"])
    top = F.aggregate(there, F.lit(0.0), lambda a, x: a + x["w"] * x["v"])
    return F.struct(
        F.try_divide(top, weight).alias("value"), weight.alias("denominator"), F.transform(there, lambda x: x["name"]).alias("available"),
        F.transform(F.filter(entries, lambda x: x["v"].isNull()), lambda x: x["name"]).alias("missing"),
    )


def normalized_unique(n: Column | str, denominator: float) -> Column:
    return F.least(F.lit(1.0), as_column(n) / F.lit(float(denominator)))


def normalized_count(n: Column | str, observed: Column | str) -> Column:
    """(n - 1) / (observed - 1); 0 for one observation, null for none."""
    n, o = as_column(n), as_column(observed)
    return F.when(o == 1, 0.0).when(o > 1, (n - 1) / (o - 1))


def pair_similarity(counts: DataFrame, group: Sequence[str], levels: Sequence[tuple[str, float]], n: str, name: str) -> DataFrame:
    """Mean similarity over all pairs of items of a group, where a pair scores by the finest level it shares.

    ``levels`` runs from fine to coarse, (column, score) with falling scores; an item with a null at a level shares
    nothing there.  Levels must be nested.  The number of pairs sharing a level is the sum over its classes of
    m (m - 1) / 2, so no pair is ever formed: linear in the items, whatever the size of a group.
    """
    total = counts.groupBy(*group).agg(F.sum(n).alias("__t"))
    out = total.withColumn("n_pairs", (F.col("__t") * (F.col("__t") - 1) / 2).cast("long")).withColumn("__sum", F.lit(0.0))
    for i, (level, score) in enumerate(levels):
        step = score - (levels[i + 1][1] if i + 1 < len(levels) else 0.0)
        same = counts.filter(F.col(level).isNotNull()).groupBy(*group, level).agg(F.sum(n).alias("__m")).groupBy(*group).agg(F.sum(F.col("__m") * (F.col("__m") - 1) / 2).alias("__same"))
        out = out.join(same, list(group), "left").withColumn("__sum", F.col("__sum") + F.lit(step) * F.coalesce("__same", F.lit(0.0))).drop("__same")
    return out.select(*group, "n_pairs", F.try_divide("__sum", F.col("n_pairs")).alias(name))


def ladder(pairs: Sequence[tuple[Column, Column, float]]) -> Column:
    """Score of the first level at which both sides are known and equal, else 0."""
    out = F.lit(0.0)
    for a, b, score in reversed(pairs):
        out = F.when(a == b, score).otherwise(out)
    return out


def tier(c: Column | str, low: float, high: float) -> Column:
    c = as_column(c)
    return F.when(c.isNull(), None).when(c < low, "low").when(c < high, "medium").otherwise("high")
