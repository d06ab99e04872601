import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import tokens as T
from lectern.llm.packing import hilbert_key, pack


def test_hilbert_neighbours_touch():
    side, d = 8, 2
    grid = np.array([(x, y) for x in range(side) for y in range(side)])
    for points, bits in ((grid, 3), (np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)]), 2)):
        key = hilbert_key(points, bits)
        assert sorted(key) == list(range(len(points)))
        path = points[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    assert d == 2


def items(spark, n=2000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 5, 30, 60, 99, 100, 101, 250]) if rnd.random() < 0.1 else rnd.randrange(1, 40), *[rnd.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, n_tokens long, v0 float, v1 float, v2 float, v3 float")


def test_everything_is_packed_once_and_tightly(spark):
    rows, df = items(spark)
    out = pack(df.withColumn("place", F.lit(1)), "k", 100, 4).collect()
    held, load = {}, {}
    for r in out:
        held.setdefault(r.k, []).append((r.piece, r.token_start, r.n_tokens, r.pieces))
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 100
    for k, n, *_ in rows:
        pieces = sorted(held[k])
        assert sum(p[2] for p in pieces) == n and len(pieces) == max(1, -(-n // 100)) == pieces[0][3]
        assert [p[1] for p in pieces] == [100 * i for i in range(len(pieces))]
    assert sum(load.values()) / (100 * len(load)) > 0.97


def test_space_left_does_not_grow_with_partitions(spark):
    _, df = items(spark, 3000, 4)
    fill = []
    for parts in (1, 40):
        out = pack(df, "k", 100, parts).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
        assert max(r.n for r in out) <= 100
        fill.append(sum(r.n for r in out) / (100 * len(out)))
    assert fill[1] > fill[0] - 0.01 and fill[0] > 0.97


def test_items_of_no_tokens_share_a_container(spark):
    rows = [(i, 0 if i % 3 else 20, 0.0, 0.0, 0.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, n_tokens long, v0 float, v1 float, v2 float, v3 float")
    out = pack(df, "k", 100, 3)
    assert out.count() == 60 and out.select("container_id").distinct().count() == 4
    assert {tuple(r) for r in pack(df.filter("n_tokens = 0"), "k", 100).select("container_id", "piece", "pieces", "n_tokens").collect()} == {("0-0-0", 1, 1, 0)}


def test_equal_vectors_null_keys_and_empty(spark):
    rows = [(None if i % 2 else 1, 10, 0.0, 0.0, 0.0, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, n_tokens long, v0 float, v1 float, v2 float, v3 float")
    out = pack(df, "k", 100, 2).collect()
    assert len(out) == 50 and len({r.container_id for r in out}) in (5, 6)
    assert pack(df.filter(F.lit(False)), "k", 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, "k", 0)


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")
def test_token_sizes_round_trip(spark):
    texts = ["", "Hello world", "naïve ß Ωμέγα Привет", "a" * 5000, None, "​  \n\n x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    got = {r.k: r.n_tokens for r in T.measured(df, "t", ["k"]).collect()}
    with open(T.VOCABULARY, "rb") as f:
        enc = T.encoding(f.read())
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t is not None)
