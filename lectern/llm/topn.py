"""Problem 7: the N best items of every group, by merging stored sorted runs with a loser tree.

Every partition of the input is a run: it is sorted by group, score and tie key, and only the first N items of each
group are stored.  The stored runs are then merged, FAN_IN at a time and in as many levels as that takes, so that a task
meets at most ``FAN_IN * N`` items of a group however many runs there are and however large the group is.  A merging
task reads its runs in order of group as a stream and holds one stretch of whole groups; a loser tree picks the next
item among the runs, and after N outputs of a group every run seeks to its next group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import materialize

#: Runs that are merged at once.
FAN_IN = 64


class LoserTree:
    """Tournament over k sorted runs; ``pop`` costs one comparison per level.

    ``heads[i]`` is the current key of run i, or None when the run is exhausted (it then loses to all).
    Equal keys go to the run of smaller number.
    """

    def __init__(self, heads: list) -> None:
        self.k = max(1, len(heads))
        self.heads = list(heads) + [None] * (self.k - len(heads))
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        """Play run i up to the first empty seat (while the tree is built)."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def winner(self) -> int | None:
        w = self.tree[0]
        return None if self.heads[w] is None else w

    def replace(self, i: int, key) -> None:
        """Give the winner's run its next key and replay its path."""
        self.heads[i] = key
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner


def merge_runs(runs: list[tuple[list, list, list]], n: int) -> Iterator[tuple[int, int]]:
    """(run, row) of the first ``n`` rows of each group over sorted runs (groups, negated scores, ties)."""
    at = [0] * len(runs)

    def head(i: int):
        g, s, t = runs[i]
        return (g[at[i]], s[at[i]], t[at[i]]) if at[i] < len(g) else None

    tree = LoserTree([head(i) for i in range(len(runs))])
    group, taken = None, 0
    while (w := tree.winner()) is not None:
        g = runs[w][0][at[w]]
        if g != group:
            group, taken = g, 0
        if taken < n:
            yield w, at[w]
            taken += 1
            at[w] += 1
        else:  # this run seeks to its next group; at most n rows of a group are in a run
            at[w] = bisect_right(runs[w][0], g, at[w], min(len(runs[w][0]), at[w] + n))
        tree.replace(w, head(w))


def _run_head(n: int, group: str):
    """The first n rows of each group of a sorted partition, with the number of the run they come from."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group)
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = g[0].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
            rank = np.where(start >= 0, np.arange(b.num_rows) - start, seen + np.arange(b.num_rows))
            last, seen = g[-1].as_py(), int(rank[-1]) + 1
            kept = b.filter(pa.array(rank < n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.num_rows, run, np.int32)), *kept.columns], names=["__run", *kept.schema.names])

    return head


def _starts(b: pa.RecordBatch, fan_in: int) -> np.ndarray:
    """Whether a row begins another group or another set of runs than the row before it; the first one does."""
    bucket = b.column("__run").to_numpy(zero_copy_only=False) // fan_in
    new = np.ones(b.num_rows, bool)
    g = b.column("__g")
    new[1:] = pc.not_equal(g.slice(1), g.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) | (bucket[1:] != bucket[:-1])
    return new


def _merge(n: int, fan_in: int):
    """First n rows of each group of each set of ``fan_in`` runs; rows come sorted by group, run, score and tie key."""

    def merged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = np.cumsum(_starts(t, fan_in))
        run = t.column("__run").to_numpy(zero_copy_only=False)
        score, tie = t.column("__s").to_pylist(), t.column("__t").to_pylist()
        order = np.argsort(run, kind="stable")
        rows = [idx.tolist() for idx in np.split(order, np.flatnonzero(np.diff(run[order])) + 1)]
        runs = [(group[idx].tolist(), [score[i] for i in idx], [tie[i] for i in idx]) for idx in rows]
        picked = t.take(pa.array([rows[r][i] for r, i in merge_runs(runs, n)], pa.int64()))
        bucket = picked.column("__run").to_numpy(zero_copy_only=False) // fan_in
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *picked.columns[1:]], names=picked.schema.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ends = [(b.column("__g")[i].as_py(), b.column("__run")[i].as_py() // fan_in) for i in (0, b.num_rows - 1)]
            if held and ends[0] != last:
                yield from merged(held)
                held = []
            if ends[0] != ends[1]:
                cut = int(np.flatnonzero(_starts(b, fan_in))[-1])
                yield from merged([*held, b.slice(0, cut)])
                held, b = [], b.slice(cut)
            held.append(b)
            last = ends[1]
        if held:
            yield from merged(held)

    return merge


def top_n_per_group(df: DataFrame, group: str, score: Column | str, tie: str, n: int) -> DataFrame:
    """Rows of ``df`` that are among the ``n`` of highest ``score`` in their ``group``; ties to the smaller ``tie``.

    Defined results: rows with a null group, a null tie key, or a score that is null or NaN take no part; rows
    equal in group, score and tie key count as separate items; an empty frame gives an empty frame with the same
    columns; extra columns travel along whatever their names.  ``group`` and ``tie`` are compared by code point, ``score`` as a double.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = (F.col(score) if isinstance(score, str) else score).cast("double")
    own = [f"c{i}" for i in range(len(df.columns))]  # the frame's own names can be anything
    picked = df.select(F.col(group).alias("__g"), (-s).alias("__s"), F.col(tie).alias("__t"), "*")
    keyed = picked.toDF("__g", "__s", "__t", *own).filter("__g IS NOT NULL AND __t IS NOT NULL AND __s IS NOT NULL AND NOT isnan(__s)")
    runs = keyed.sortWithinPartitions("__g", "__s", "__t")
    schema = T.StructType([T.StructField("__run", T.IntegerType()), *keyed.schema.fields])
    level = materialize(runs.mapInArrow(_run_head(n, "__g"), schema), "topn-runs")
    n_runs = (level.agg(F.max("__run")).first()[0] or 0) + 1
    while True:  # once for up to FAN_IN runs
        bucket = (F.col("__run") / F.lit(FAN_IN)).cast("int")
        sets = level.repartition("__g", bucket) if n_runs > FAN_IN else level.repartition("__g")
        level = sets.sortWithinPartitions("__g", "__run", "__s", "__t").mapInArrow(_merge(n, FAN_IN), schema)
        n_runs = -(-n_runs // FAN_IN)
        if n_runs == 1:
            return level.select(*own).toDF(*df.columns)
