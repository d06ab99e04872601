"""Buckets of any size, compared pair by pair without any task that holds a whole bucket.

Postings are shuffled once, by key, sorted there by the JVM, and read as a stream of whole buckets, whose pairs are
formed and tested as arrays.  A crowded bucket is handed on instead: it is dealt into blocks, and every two of its blocks
are compared by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Pairs that are formed and tested at once.
PAIRS = 1 << 20

Arrays = dict[str, np.ndarray]
Keep = Callable[[Arrays, Arrays], np.ndarray]


def _arrays(batches: list[pa.RecordBatch]) -> Arrays:
    return {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in batches[0].schema.names}


def _changes(rows: Arrays, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first one does."""
    n = len(next(iter(rows.values())))
    out = np.ones(n, bool)
    if n:
        out[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names])
    return out


def _in_groups(last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group, some at a time; ``last`` is the end of each row's group."""
    rows = np.arange(len(last))
    each = last - rows - 1
    parts = np.cumsum(each) // PAIRS
    for r in np.split(rows, np.flatnonzero(np.diff(parts)) + 1):
        n = each[r]
        first = np.repeat(r, n)
        yield first, first + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _tested(rows: Arrays, pairs: Iterator[tuple[np.ndarray, np.ndarray]], member: str, keep: Keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in pairs:
        if len(i):
            ok = keep({c: v[i] for c, v in rows.items()}, {c: v[j] for c, v in rows.items()})
            a, b = rows[member][i[ok]], rows[member][j[ok]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            differ = lo != hi
            if differ.any():
                both = np.unique(np.stack([lo[differ], hi[differ]]), axis=1)
                yield both[0], both[1]


def _whole_buckets(key: str, member: str, block: int, keep: Keep, names: list[str]):
    """Pairs of the buckets of a sorted partition; rows of crowded ones come back as they are, without a pair."""

    def paired(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[empty for _ in names]], names=["a", "b", *names])

    def crowd(rows: Arrays) -> pa.RecordBatch:
        n = len(rows[key])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.array(rows[c]) for c in names]], names=["a", "b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None  # rows of the last bucket so far; the key of a bucket that is being handed on
        for b in batches:
            if not b.num_rows:
                continue
            rows = _arrays([b])
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            rows = {c: v[changed] for changed in [_changes(rows, names)] for c, v in rows.items()}  # repeated postings
            if crowded is not None and rows[key][0] != crowded:
                crowded = None
            start = np.flatnonzero(_changes(rows, [key]))
            yield from done({c: v[: start[-1]] for c, v in rows.items()}, start[:-1], crowded)
            held = {c: v[start[-1] :] for c, v in rows.items()}
            if crowded is not None and held[key][0] != crowded:
                crowded = None
            if crowded is not None or len(held[key]) > block:
                crowded = held[key][0]
                yield crowd({c: v[:-1] for c, v in held.items()})  # the last one stays, to know repeated postings
                held = {c: v[-1:] for c, v in held.items()}
        if held is not None:
            yield from done(held, np.zeros(1, np.int64), crowded)

    def done(rows: Arrays, start: np.ndarray, crowded) -> Iterator[pa.RecordBatch]:
        """Whole buckets, all but the first of them from their first row on."""
        if not len(start):
            return
        size = np.diff(np.append(start, len(rows[key])))
        over = (size > block) | ((rows[key][start] == crowded) if crowded is not None else False)
        many = np.repeat(over, size)
        if many.any():
            yield crowd({c: v[many] for c, v in rows.items()})
        few = np.repeat(~over & (size > 1), size)
        if few.any():
            rows = {c: v[few] for c, v in rows.items()}
            begin = np.flatnonzero(_changes(rows, [key]))
            n = np.diff(np.append(begin, len(rows[key])))
            for a, b in _tested(rows, _in_groups(np.repeat(begin + n, n)), member, keep):
                yield paired(a, b)

    return run


def _units(member: str, keep: Keep, names: list[str]):
    """Pairs of units: within one block, or between two."""

    def pairs(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if len(left) + len(right) < len(side):
            yield from _in_groups(np.full(len(side), len(side)))
        for r in np.array_split(left, max(1, len(left) * len(right) // PAIRS + 1)):
            yield np.repeat(r, len(right)), np.tile(right, len(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _arrays(held)
            side = rows["__side"]
            for a, b in _tested({c: rows[c] for c in names}, pairs(side), member, keep):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            unit = b.column("__unit").to_numpy()
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(unit)) + 1) if b.num_rows else ():
                one = b.slice(int(part[0]), len(part))
                if held and held[0].column("__unit")[0].as_py() != unit[part[0]]:
                    yield from flush()
                    held = []
                held.append(one)
        if held:
            yield from flush()

    return run


def bucket_pairs(postings: DataFrame, key: str, member: str, block: int, keep: Keep, label: str) -> DataFrame:
    """(a, b) with ``a < b`` of the members of postings that share ``key`` and pass ``keep``; a pair may come repeatedly.

    ``postings`` has no columns but long ones without nulls; equal postings count once.  ``keep`` gets the columns of the
    first and of the second posting of many pairs as arrays and must hold either way round.  No task compares more than
    about ``block`` postings with as many; a posting is copied once for each block of its key.
    """
    names = [key, member, *[c for c in postings.columns if c not in (key, member)]]
    ordered = postings.select(*names).repartition(key).sortWithinPartitions(*names)
    schema = ", ".join(f"`{c}` long" for c in ("a", "b", *names))
    out = materialize(ordered.mapInArrow(_whole_buckets(key, member, block, keep, names), schema), f"{label}-met")
    crowd = out.filter("a IS NULL").select(*names)
    blocks = crowd.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    dealt = crowd.join(blocks, key).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    units = dealt.select(*names, "__own", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    side = F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
    split = units.select(F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other")).alias("__unit"), side.cast("long").alias("__side"), *names)
    many = split.repartition("__unit").sortWithinPartitions("__unit").mapInArrow(_units(member, keep, names), "a long, b long")
    return out.filter("a IS NOT NULL").select("a", "b").unionByName(many)
