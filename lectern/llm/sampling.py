"""Problem 1: a sample whose category shares match targets in several dimensions, by divisor-method priorities.

Each record gets a random place among those of its cell (its combination of categories) and the priority
``(place - 0.5) / target of the cell``; the records of smallest priority are kept (Webster's divisor method: an
exhausted cell simply has no further priorities, so its seats go to the others).  Cell targets come from the
dimension targets by proportional fitting over the cells that have records.  Records that fill a category's
minimum come before all others.

A priority depends on nothing but cell and place.  So how many places of each cell are kept follows from the cells'
counts alone, without a ranking of all records of a pool, and only places within cells are computed on records, by all
tasks together however many of them a cell has.  Where rounding leaves a target short that other cells could fill,
seats are exchanged between cells, one or two at a time, as long as that lowers what is missing in all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rank import midrank_place

#: Share given to a category no target names, so that its records are used only where nothing else is left.
UNTARGETED = 1e-6
FITTING_ROUNDS = 50


def place(seed: int, *keys: Column | str) -> Column:
    """A random number fixed by the seed and the record's key, whatever the partitioning."""
    return F.xxhash64(F.lit(seed), *keys)


def cell_targets(pdf: pd.DataFrame, dimensions: Sequence[str]) -> np.ndarray:
    """Proportional fitting of one pool's cells (as many as category combinations, never as many as records)."""
    want = [pdf[f"share_{d}"].fillna(UNTARGETED).to_numpy(float) for d in dimensions]
    weight = np.ones(len(pdf))
    codes = [pd.factorize(pdf[d].fillna("\0"))[0] for d in dimensions]
    for _ in range(FITTING_ROUNDS):
        for share, code in zip(want, codes):
            total = np.bincount(code, weight)
            goal = np.zeros(len(total))
            goal[code] = np.maximum(share, UNTARGETED)
            weight *= (goal / goal.sum() / np.maximum(total, 1e-300))[code]
    return np.maximum(weight / weight.sum() * pdf["sample_size"].to_numpy(float), 1e-9)


def seats_of_cells(available: np.ndarray, target: np.ndarray, size: int, least: np.ndarray | None = None) -> np.ndarray:
    """How many places of each cell are among the ``size`` smallest priorities, ``least`` of each coming first.

    Equal priorities of different cells go to the cell that comes first.
    """
    least = np.zeros_like(available) if least is None else np.minimum(least, available)
    if least.sum() >= size:
        return seats_of_cells(least, target, size) if least.sum() > size else least
    if available.sum() <= size:
        return available.copy()

    def within(limit: float) -> np.ndarray:
        return np.maximum(least, np.minimum(available, np.floor(limit * target + 0.5)).astype(np.int64))

    low, high = 0.0, float(((available + 1) / target).max())
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if within(middle).sum() <= size else (low, middle)
    seats = within(low)
    while seats.sum() < size:  # what the last step of the search can't part: a seat a cell at most
        following = np.where(seats < available, (seats + 0.5) / target, np.inf)
        seats[int(np.argmin(following))] += 1
    return seats


def exchanged(seats: np.ndarray, least: np.ndarray, available: np.ndarray, member: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Seats after exchanges between cells that lower what the goals are short of in all.

    ``member[m, c]`` is 1 where cell ``c`` counts for goal ``m``.  A step moves seats between two cells, or between two
    pairs of cells; as every step lowers a whole number, there are no more steps than seats.
    """
    seats, cells = seats.copy(), len(seats)
    a, b = np.nonzero(~np.eye(cells, dtype=bool))
    change = member[:, b] - member[:, a]

    def missing(have: np.ndarray) -> np.ndarray:
        return np.maximum(goal[:, None] - have, 0).sum(0)

    def step(have: np.ndarray, now: np.ndarray) -> list[int] | None:
        allowed = (seats[a] > least[a]) & (seats[b] < available[b])
        gain = np.where(allowed, now - missing(have[:, None] + change), -1)
        if gain.size and gain.max() > 0:
            return [int(gain.argmax())]
        for first in np.flatnonzero(allowed):
            after = seats.copy()
            after[a[first]] -= 1
            after[b[first]] += 1
            fits = (after[a] > least[a]) & (after[b] < available[b])
            gain = np.where(fits, now - missing(have[:, None] + change[:, [first]] + change), -1)
            if gain.max() > 0:
                return [int(first), int(gain.argmax())]
        return None

    least_missing = int(np.maximum(goal - member @ available, 0).sum())  # of records that there aren't
    while len(goal) and cells > 1:
        have = member @ seats
        now = missing(have[:, None])[0]
        moves = step(have, now) if now > least_missing else None
        if moves is None:
            return seats
        delta, moved = change[:, moves].sum(1), np.zeros(cells, np.int64)
        np.subtract.at(moved, a[moves], 1)
        np.add.at(moved, b[moves], 1)
        # As often at once as no goal turns from short to met or back, and no cell runs out.
        spare = have - goal
        bounds = [(spare[m] // -delta[m]) for m in np.flatnonzero(delta < 0) if spare[m] > 0] + [(-spare[m] // delta[m]) for m in np.flatnonzero(delta > 0) if spare[m] < 0]
        bounds += [(seats[c] - least[c]) // -moved[c] for c in np.flatnonzero(moved < 0)] + [(available[c] - seats[c]) // moved[c] for c in np.flatnonzero(moved > 0)]
        seats = seats + moved * max(1, int(min(bounds, default=1)))
    return seats


def _plan(dimensions: Sequence[str]):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(dimensions), na_position="last").reset_index(drop=True)
        target, available = cell_targets(pdf, dimensions), pdf["available"].to_numpy(np.int64)
        size = int(pdf["sample_size"].iloc[0])
        least, members, goals = np.zeros(len(pdf), np.int64), [], []
        for d in dimensions:
            for category in pdf[d].dropna().unique():
                own = (pdf[d] == category).to_numpy()
                minimum, goal = pdf.loc[own, f"minimum_{d}"].iloc[0], pdf.loc[own, f"count_{d}"].iloc[0]
                if minimum == minimum and minimum > 0:
                    least[own] = np.maximum(least[own], seats_of_cells(available[own], target[own], int(minimum)))
                if goal == goal and goal > 0:
                    members.append(own)
                    goals.append(int(goal))
        seats = seats_of_cells(available, target, size, least)
        seats = exchanged(seats, np.minimum(least, seats), available, np.array(members, np.int64).reshape(-1, len(pdf)), np.array(goals, np.int64))
        return pdf.assign(cell_target=target, seats=seats, least=np.minimum(least, seats))

    return plan


def sample_to_targets(records: DataFrame, targets: DataFrame, key: str, pool: str, dimensions: Sequence[str], seed: int = 20240917) -> DataFrame:
    """Chosen records: ``key``, ``pool``, the dimensions, ``priority`` and ``is_floor`` (counted towards a minimum).

    ``targets`` has ``pool, dimension, category, sample_size, target_count, target_share, minimum_count``, one row per
    category.

    Defined results: a pool without targets gives no sample; a record with a null pool is left out; a record whose
    category is null or not named by any target is chosen only when named ones run out; a pool with fewer records
    than its sample size is taken whole; the key must be unique, equal keys are separate records with equal chances;
    empty frames give an empty sample; further columns of ``records`` are ignored, whatever their names.
    """
    names, given = [pool, *dimensions], key
    records = records.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__d{i}") for i, c in enumerate(names)])
    targets = targets.select(F.col(pool).alias("__d0"), "dimension", "category", "sample_size", "target_count", "target_share", "minimum_count")
    named_as = {c: f"__d{i}" for i, c in enumerate(names)}
    targets = targets.replace(named_as, subset=["dimension"])
    key, pool, dimensions = "__key", "__d0", [f"__d{i + 1}" for i in range(len(dimensions))]
    base = records.filter(F.col(pool).isNotNull())
    sizes = targets.filter(F.col(pool).isNotNull()).groupBy(pool).agg(F.max("sample_size").alias("sample_size"))
    cells = base.groupBy(pool, *dimensions).agg(F.count("*").alias("available")).join(sizes, pool)
    for d in dimensions:
        t = targets.filter(F.col("dimension") == d).groupBy(pool, F.col("category").alias(d))
        t = t.agg(F.max("target_share").alias(f"share_{d}"), F.max("minimum_count").cast("double").alias(f"minimum_{d}"), F.max("target_count").cast("double").alias(f"count_{d}"))
        cells = cells.join(t, [pool, d], "left")
    kinds = {c: cells.schema[c].dataType.simpleString() for c in cells.columns}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", cell_target double, seats long, least long"
    planned = cells.groupBy(pool).applyInPandas(_plan(dimensions), schema).filter("seats > 0").select(pool, *dimensions, "cell_target", "seats", "least")

    same_cell = [pool, *dimensions]
    placed = midrank_place(base.withColumn("r", place(seed, key)), same_cell, ["r", key], "p")
    named = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(planned[c]) for c in same_cell])
    kept = placed.join(planned, named).filter(F.col("p") <= F.col("seats")).select(placed["*"], "cell_target", "least")
    out = kept.withColumns({"priority": (F.col("p") - 0.5) / F.col("cell_target"), "is_floor": F.col("p") <= F.col("least")})
    return out.select(F.col(key).alias(given), *[F.col(f"__d{i}").alias(c) for i, c in enumerate(names)], "priority", "is_floor")


def sample_report(records: DataFrame, chosen: DataFrame, targets: DataFrame, pool: str, dimensions: Sequence[str]) -> DataFrame:
    """Every target with what is available, what was drawn, and whether target and minimum are met.

    ``reason`` says why a target is missed: ``too_few`` where its pool lacks records of the category, ``jointly`` where
    it has enough and no exchange of one or two seats meets this target without missing another by as much.
    """

    def counts(frame: DataFrame, name: str) -> DataFrame:
        by_cell = frame.groupBy(pool, *dimensions).agg(F.count("*").alias("n"))
        pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions]))
        return by_cell.select(pool, "n", pairs.alias("x")).groupBy(pool, "x.dimension", "x.category").agg(F.sum("n").alias(name))

    keys = [pool, "dimension", "category"]
    out = targets.join(counts(records, "available"), keys, "left").join(counts(chosen, "drawn"), keys, "left").fillna(0, ["available", "drawn"])
    missed = F.col("drawn") < F.col("target_count")
    return out.withColumns({
        "reason": F.when(missed & (F.col("available") < F.col("target_count")), "too_few").when(missed, "jointly"),
        "short_of_target": F.greatest(F.col("target_count") - F.col("drawn"), F.lit(0)),
        "minimum_met": F.col("drawn") >= F.least("minimum_count", "available"), "drawn_share": F.try_divide(F.col("drawn").cast("double"), F.col("sample_size")),
    })
