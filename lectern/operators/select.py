"""Greedy choice of items per owner, step by step for all owners at once.

Each step is one ranking or one aggregation over all owners; what has been chosen and what it covers is small (as many
rows as owners) and joined back by key.  The number of steps is that of the places to fill, never that of the items.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rank import first_rows
from lectern.storage import materialize


def take_ranked(items: DataFrame, owner: str, key: str, order: Sequence[Column], n: int, reason: str, chosen: DataFrame | None) -> DataFrame:
    """``chosen`` (owner, key, reason, tokens) with each owner's next ``n`` items in ``order`` that it doesn't have."""
    left = items if chosen is None else items.join(chosen.select(owner, key), [owner, key], "left_anti")
    new = first_rows(left, [owner], order, n).select(owner, key, F.lit(reason).alias("reason"), "tokens")
    return materialize(new if chosen is None else chosen.unionByName(new), "chosen")


def take_diversifying(items: DataFrame, owner: str, key: str, n: int, reason: str, chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``n`` more items each, one at a time: most tokens not yet covered, then most tokens, then key."""
    for _ in range(n):
        covered = chosen.groupBy(owner).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("covered"))  # of the few chosen
        left = items.join(chosen.select(owner, key), [owner, key], "left_anti").join(covered, owner, "left")
        gain = F.size(F.array_except("tokens", F.coalesce("covered", F.array().cast("array<string>"))))
        best = left.groupBy(owner).agg(F.min(F.struct((-gain).alias("g"), (-F.size("tokens")).alias("s"), F.col(key).alias("k"), F.col("tokens").alias("t"))).alias("x"))
        chosen = materialize(chosen.unionByName(best.select(owner, F.col("x.k").alias(key), F.lit(reason).alias("reason"), F.col("x.t").alias("tokens"))), "chosen")
    return chosen


def representative(items: DataFrame, owner: str, key: str, recent: int = 3, influential: int = 2, diversifying: int = 2, drawn: int = 1, seed: int = 1) -> DataFrame:
    """(owner, key, reason) of up to eight items: most recent, most influential, most diversifying, and drawn at random.

    ``items`` has ``recency`` and ``influence`` (null counts as lowest) and ``tokens`` (what an item covers).  Ties go
    to the smaller key; the draw takes the smallest hashes of seed, owner and key.  Owners with fewer items get all.
    """
    by = lambda c: [F.desc(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))), F.col(key)]
    chosen = take_ranked(items, owner, key, by("recency"), recent, "recent", None)
    chosen = take_ranked(items, owner, key, by("influence"), influential, "influential", chosen)
    chosen = take_diversifying(items, owner, key, diversifying, "diversifying", chosen)
    chosen = take_ranked(items, owner, key, [F.sha2(F.concat_ws("\x00", F.lit(str(seed)), owner, key), 256), F.col(key)], drawn, "random", chosen)
    return chosen.select(owner, key, "reason")


def candidate_pool(items: DataFrame, owner: str, key: str, size: int = 20) -> DataFrame:
    """(owner, key, reason) of up to ``size`` items: half by recency, a third by influence, the rest diversifying."""
    by = lambda c: [F.desc(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))), F.col(key)]
    chosen = take_ranked(items, owner, key, by("recency"), size // 2, "recent", None)
    chosen = take_ranked(items, owner, key, by("influence"), size // 3, "influential", chosen)
    return take_diversifying(items, owner, key, size - size // 2 - size // 3, "diversifying", chosen).select(owner, key, "reason")


def focal_pair(items: DataFrame, owner: str, key: str) -> DataFrame:
    """(owner, key, place) of the two items of highest .35 open + .25 text + .25 consistent + .15 coverage.

    ``items`` has ``open`` (0..1), ``text`` and ``consistent`` (booleans) and ``tokens``.  Coverage is the share of the
    owner's rarity-weighted tokens an item adds: for the first item of all, for the second of those still uncovered.
    """
    df = items.select(owner, F.explode("tokens").alias("t")).groupBy(owner, "t").agg((1.0 / F.count("*")).alias("w"))
    worth = items.select(owner, key, F.explode("tokens").alias("t")).join(df, [owner, "t"])
    base = 0.35 * F.col("open") + 0.25 * F.col("text").cast("int") + 0.25 * F.col("consistent").cast("int")

    def best(left: DataFrame, weights: DataFrame, place: int) -> DataFrame:
        cover = weights.groupBy(owner, key).agg(F.sum("w").alias("c"))
        top = cover.groupBy(owner).agg(F.max("c").alias("most"))
        scored = left.join(cover, [owner, key], "left").join(top, owner, "left")
        score = F.round(base + 0.15 * F.coalesce(F.try_divide("c", "most"), F.lit(0.0)), 12)
        x = F.min(F.struct((-score).alias("s"), F.col(key).alias("k"), F.col("tokens").alias("t"))).alias("x")
        return scored.groupBy(owner).agg(x).select(owner, F.col("x.k").alias(key), F.lit(place).alias("place"), F.col("x.t").alias("tokens"))

    first = materialize(best(items, worth, 1), "focal")
    covered = first.select(owner, F.explode("tokens").alias("t"))
    rest = worth.join(covered, [owner, "t"], "left_anti")
    second = best(items.join(first.select(owner, key), [owner, key], "left_anti"), rest, 2)
    return first.unionByName(second).select(owner, key, "place")


def margin_sample(candidates: DataFrame, targets: dict[tuple[str, str], int], key: str, places: Sequence[str], size: int, seed: int) -> DataFrame:
    """Greedy sample of ``size`` records that brings the counts of (dimension, category) close to ``targets``.

    Each step adds the record that lowers most: sum |count - target| / max(target, 1), plus .05 and .02 for each
    further record of the same first and second place; ties go to the smallest seeded hash.

    A record's cost depends only on its categories and places, so few records can ever be chosen: of each combination of
    categories and second place, the first record of each of the ``size + 1`` first places met first by hash (at most
    ``size`` of them can have been used), and the ``size`` records of smallest hash.  They are picked out in two
    rankings, however large ``size`` is, and the steps are then made over them on the driver: at most ``2 * size + 1``
    rows for each combination.
    """
    dims = sorted({dim for dim, _ in targets})
    first, second = places
    rank = F.sha2(F.concat_ws("\x00", F.lit(str(seed)), key), 256)
    names = [f"d{i}" for i in range(len(dims))]
    pool = candidates.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(dims, names)], F.col(first).alias("p0"), F.col(second).alias("p1"), rank.alias("r"))
    pool = materialize(pool.filter("k IS NOT NULL"), "margin-pool")
    cell, row = [*names, "p1"], F.struct("r", "k")
    by_place = pool.groupBy(*cell, "p0").agg(F.min(row).alias("x")).select(*cell, "p0", "x.r", "x.k")
    one_each = first_rows(by_place, cell, [F.col("r"), F.col("k")], size + 1).select("k", *names, "p0", "p1", "r")
    lowest = first_rows(pool, cell, [F.col("r"), F.col("k")], size).select("k", *names, "p0", "p1", "r")
    rows = sorted(one_each.unionByName(lowest).distinct().collect(), key=lambda x: (x["r"], x["k"]))
    numbers = {target: i for i, target in enumerate(targets)}
    codes = np.array([[numbers.get((d, x[n]), -1) for d, n in zip(dims, names)] for x in rows], dtype=np.int64).reshape(len(rows), len(dims))
    place_codes = [{p: i for i, p in enumerate(sorted({x[c] for x in rows if x[c] is not None}))} for c in ("p0", "p1")]
    at = np.array([[-1 if x[c] is None else place_codes[i][x[c]] for i, c in enumerate(("p0", "p1"))] for x in rows], dtype=np.int64).reshape(len(rows), 2)
    seen = [np.zeros(len(p) + 1, bool) for p in place_codes]  # the last entry stands for no place and is never seen
    counts, left, chosen = dict.fromkeys(targets, 0), np.ones(len(rows), bool), []
    while len(chosen) < size and left.any():
        cost = np.zeros(len(rows))
        for (dim, cat), target in targets.items():
            change = (abs(counts[dim, cat] + 1 - target) - abs(counts[dim, cat] - target)) / max(target, 1)
            cost += np.where(codes[:, dims.index(dim)] == numbers[dim, cat], change, 0.0)
        for i, weight in enumerate((0.05, 0.02)):
            cost += np.where(seen[i][at[:, i]], weight, 0.0)
        best = int(np.argmin(np.where(left, np.round(cost, 12), np.inf)))  # rows are in order of hash
        left[best] = False
        chosen.append(rows[best]["k"])
        for dim, n in zip(dims, names):
            if (dim, rows[best][n]) in counts:
                counts[dim, rows[best][n]] += 1
        for i in range(2):
            if at[best, i] >= 0:
                seen[i][at[best, i]] = True
    spark = candidates.sparkSession
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(chosen)], f"{key} {candidates.schema[key].dataType.simpleString()}, selection_order int")
