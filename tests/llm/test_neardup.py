import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import neardup
from lectern.llm.graph import connected_components
from lectern.llm.neardup import CELLS, class_postings, told_apart, distinct_shingles, distinct_words, near_duplicate_groups, near_duplicate_pairs, ring_condition


def words(rnd, n, vocabulary=60):
    return [f"w{min(int(rnd.expovariate(0.08)), vocabulary)}" for _ in range(n)]


def brute(rows, threshold, band=False):
    sets = [(k, set(t.split()), b) for k, t, b in rows if t is not None and t.split() and b is not None]
    out = set()
    for i, (k, s, b) in enumerate(sets):
        for m, u, c in sets[i + 1 :]:
            if k != m and (not band or abs(b - c) <= 1) and len(s & u) / len(s | u) >= threshold:
                out.add((min(k, m), max(k, m)))
    return out


def sample(seed, n=250):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            ws = rnd.choice(rows)[1].split()
            ws = [w for w in ws if rnd.random() > 0.1] + words(rnd, rnd.randrange(3))
            rnd.shuffle(ws)
        else:
            ws = words(rnd, rnd.randrange(1, 25))
        rows.append((i, " ".join(ws) or "w1", rnd.randrange(2000, 2006)))
    return rows + [(9001, "", 2001), (9002, None, 2001), (9003, "w1 w2 w3", None)]


def test_against_brute_force(spark):
    for threshold, n_words, banded in ((0.7, 1, True), (0.6, 3, False), (0.8, 2, False), (0.5, 1, True)):
        rows = sample(int(threshold * 100))
        df = spark.createDataFrame(rows, "id long, t string, y int").withColumn("h", F.lit(1)).repartition(5)
        got = near_duplicate_pairs(df, "id", distinct_words("t"), threshold, "t", n_words, F.col("y") if banded else None)
        assert {(r.id_a, r.id_b) for r in got.collect()} == brute(rows, threshold, banded)


def test_groups_against_the_pairs(spark):
    rows = sample(11) + [(500 + i, "same words here", 2003) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string, y int").repartition(4)
    pairs = brute(rows, 0.7, True)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r.id: (r.group_id, r.n_links) for r in near_duplicate_groups(df, "id", distinct_words("t"), 0.7, "t", 1, F.col("y")).collect()}
    assert {k: len(v) for k, v in near.items()} == {k: n for k, (_, n) in got.items()}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start][0] == min(seen)
    assert near_duplicate_groups(df.filter(F.lit(False)), "id", distinct_words("t"), 0.7, "t", 1, F.col("y")).count() == 0


def test_shingles_copies_and_a_very_long_text(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "a b c d e"), (2, "A <i>b</i> c, d e!"), (3, "a b"), (4, long), (5, long + " tail"), (6, None), (1, "a b c d e")]
    df = spark.createDataFrame(rows, "id long, t string")
    sizes = [r.n for r in df.select(F.size(distinct_shingles("t", 3)).alias("n")).collect()]
    assert sizes[:4] == [3, 3, 0, 29_998]
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", distinct_shingles("t", 3), 0.6, "t", 3).collect()}
    assert got == {(1, 2), (4, 5)}
    assert near_duplicate_pairs(df.filter(F.lit(False)), "id", distinct_words("t"), 0.6, "t", 1).count() == 0


def test_the_ring_never_drops_a_pair_within_the_bound():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        a = rng.integers(-(2**63), 2**63 - 1, 3)
        b = a.copy()
        for bit in rng.integers(0, 192, rng.integers(0, 60)):
            b[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
        rows.append([int(x) for x in (*a, *b)] + [int(sum(int(x ^ y) & (2**64 - 1) != 0 and bin(int(x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b)))])
    words = np.array([r[:6] for r in rows], np.int64)
    d = np.array([r[6] for r in rows])
    for tau in (5, 20, 40):
        for parts in (1, 2, 4):
            kept = ring_condition(words.T[:3], words.T[3:], np.full(len(rows), tau), parts)
            assert kept[d <= tau].all() and not kept[d > tau].any()


def test_components_against_union_find(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_copies_have_the_postings_of_one(spark):
    rows = [(i, "many words that are the same here", 2003 + i % 2) for i in range(600)] + [(900 + i, "many words that are the same there", 2003) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string, band long").withColumn("tokens", distinct_words("t")).withColumn("h", F.xxhash64(F.array_sort("tokens")))
    got = [set(map(tuple, class_postings(x.select("h", "band", "tokens"), np.zeros(CELLS, np.int64), 0.7, 1, True).collect())) for x in (df.repartition(7), df.dropDuplicates(["h", "band"]))]
    assert len(got[0]) == 3 * 2 * 3 and got[0] == got[1]
    assert class_postings(df.repartition(7).select("h", "band", "tokens"), np.zeros(CELLS, np.int64), 0.7, 1, True).count() <= 7 * 18


def test_crowded_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    for threshold, n_words, banded in ((0.7, 1, True), (0.6, 3, False)):
        rows = [r for r in sample(21) if banded or r[2] is not None]
        df = spark.createDataFrame(rows, "id long, t string, y int").repartition(3)
        got = near_duplicate_pairs(df, "id", distinct_words("t"), threshold, "t", n_words, F.col("y") if banded else None)
        assert {(r.id_a, r.id_b) for r in got.collect()} == brute(rows, threshold, banded)


def test_sets_of_one_hash_are_told_apart(spark):
    rows = [(1, [5, 6], 0, 77, 1), (2, [5, 6], 0, 77, 1), (3, [8], 0, 77, 2), (4, [9], 0, 78, 3)]
    got = {r.id: r.h for r in told_apart(spark.createDataFrame(rows, "id long, tokens array<long>, band long, h long, h2 long"), "t").collect()}
    assert got[1] == got[2] != got[3] and got[4] == 78 and len(set(got.values())) == 3
