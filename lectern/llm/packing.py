"""Problem 8: items into containers of fixed capacity, neighbours along a space-filling curve together.

Projected document vectors are placed on a Hilbert curve; documents are range-sorted by their place on it (then by
key, so that equal vectors can be split over partitions), and every partition packs its stretch of the curve.  An item
goes into the open container it fits most tightly; at most OPEN containers are open at once, so memory doesn't grow
with the partition.  What is left open at the end of a partition is taken out again and packed with that of its
neighbours, STRETCHES partitions together, and so on until one partition is left: so the space left doesn't grow with the
number of partitions.  An item larger than the capacity is cut into full pieces and a rest; nothing else is ever cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import DIMENSIONS
from lectern.storage import materialize

BITS = 12
OPEN = 64
#: Partitions whose open containers are packed again together.
STRETCHES = 16


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d) with ``bits`` bits an axis, d * bits <= 62.

    The transposed form of each index comes from undoing excess work bit by bit, from the highest, and Gray coding.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_ERF = np.vectorize(erf, otypes=[float])


def _place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    axes = [f"v{i}" for i in range(DIMENSIONS)]
    for f in frames:
        even = 0.5 * (1 + _ERF(f[axes].to_numpy(float) / np.sqrt(2)))  # of unit variance: about uniform
        cells = np.clip((even * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        yield pd.DataFrame({"k": f["k"], "n_tokens": f["n_tokens"], "place": hilbert_key(cells)})


class OpenContainers:
    """Best fit among at most ``most`` open containers; when one more is needed the fullest is closed.

    ``put`` gives the container of an item, and that which was closed for it (full, or put aside), if any.
    """

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.free, self.count = capacity, most, [], 0

    def put(self, size: int) -> tuple[int, list[int]]:
        i, closed = bisect_left(self.free, (size, -1)), []
        if i < len(self.free):
            left, number = self.free.pop(i)
        else:
            left, number, self.count = self.capacity, self.count, self.count + 1
            if len(self.free) >= self.most:
                closed.append(self.free.pop(0)[1])
        if left > size:
            insort(self.free, (left - size, number))
        else:
            closed.append(number)
        return number, closed


_PACKED = ["part", "number", "open", "k", "piece", "pieces", "token_start", "n_tokens", "place"]


def _pack(capacity: int):
    """Pieces (of items of at least one token) into containers; those of containers open at the end come last, marked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        containers, held = OpenContainers(capacity, OPEN), {}  # rows of open containers: at most OPEN * capacity
        for f in frames:
            done = []
            for k, piece, pieces, start, n, place in f[["k", "piece", "pieces", "token_start", "n_tokens", "place"]].itertuples(index=False, name=None):
                number, closed = containers.put(n)
                held.setdefault(number, []).append((part, number, False, k, piece, pieces, start, n, place))
                for c in closed:
                    done += held.pop(c)
            yield pd.DataFrame(done, columns=_PACKED)
        yield pd.DataFrame([(*r[:2], True, *r[3:]) for rows in held.values() for r in rows], columns=_PACKED)

    return run


def pack(items: DataFrame, key: str, capacity: int, partitions: int | None = None) -> DataFrame:
    """(container_id, key, piece, pieces, token_start, n_tokens) of ``items(key, n_tokens, v0..)``.

    Defined results: an item of exactly the capacity fills one container and isn't cut; items of no tokens go into one of
    the others' containers; items with a null key are packed like any other; repeated keys are separate items; no
    items give no containers; the capacity must be positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = items.schema[key].dataType.simpleString()
    placed = items.select(F.col(key).alias("k"), "n_tokens", *[f"v{i}" for i in range(DIMENSIONS)]).mapInPandas(_place, f"k {kind}, n_tokens long, place long")
    placed = materialize(placed, "pack-places")  # the range partitioner reads it twice
    pieces = F.ceil(F.col("n_tokens") / capacity).cast("int")
    cut = placed.filter("n_tokens > 0").withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    start = (F.col("piece") - 1).cast("long") * capacity
    rest = cut.select("k", "piece", "pieces", start.alias("token_start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).alias("n_tokens"), "place")
    schema = f"part int, number long, open boolean, k {kind}, piece int, pieces int, token_start long, n_tokens long, place long"
    levels, parts = [], partitions
    while True:
        ordered = (rest.repartitionByRange(parts, "place", "k") if parts else rest.repartitionByRange("place", "k")).sortWithinPartitions("place", "k", "piece")
        packed = materialize(ordered.mapInPandas(_pack(capacity), schema), "pack-level")
        parts = packed.select("part").distinct().count()
        levels.append(packed.filter("NOT open" if parts > 1 else "true").withColumn("level", F.lit(len(levels))))
        if parts <= 1:
            break
        rest, parts = packed.filter("open").select("k", "piece", "pieces", "token_start", "n_tokens", "place"), -(-parts // STRETCHES)
    out = reduce(DataFrame.unionByName, levels).select(F.concat_ws("-", "level", "part", "number").alias("container_id"), "k", "piece", "pieces", "token_start", "n_tokens")
    first = out.agg(F.coalesce(F.min("container_id"), F.lit("0-0-0")).alias("container_id"))  # one row
    blank = placed.filter("n_tokens = 0").select("k", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("long").alias("token_start"), "n_tokens").crossJoin(F.broadcast(first))
    every = out.unionByName(blank)
    return every.select("container_id", F.col("k").alias(key), "piece", "pieces", "token_start", "n_tokens")
