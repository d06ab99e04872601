import random

from pyspark.sql import functions as F

from lectern.operators.select import candidate_pool, focal_pair, margin_sample, representative


def items(spark, seed=1, n=60):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["p", "p", "q"]), f"W{i:03d}", rnd.choice([None, 2000, 2010, 2020]), rnd.choice([None, 1.0, 50.0, 99.0]), sorted({f"topic:{rnd.randrange(12)}" for _ in range(rnd.randrange(5))}), rnd.choice([0.0, 0.5, 1.0]), rnd.random() < 0.5, rnd.random() < 0.5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "o string, k string, recency int, influence double, tokens array<string>, open double, text boolean, consistent boolean")


def greedy(rows, counts):
    left, out, covered = sorted(rows, key=lambda r: r[1]), [], set()
    for reason, n in counts:
        for _ in range(n):
            if not left:
                break
            key = {"recent": lambda r: (-(r[2] if r[2] is not None else -1), r[1]), "influential": lambda r: (-(r[3] if r[3] is not None else -1), r[1]), "diversifying": lambda r: (-len(set(r[4]) - covered), -len(r[4]), r[1])}[reason]
            best = min(left, key=key)
            left.remove(best)
            out.append((best[1], reason))
            covered |= set(best[4])
    return out


def test_representatives_against_brute_force(spark):
    rows, df = items(spark)
    got = representative(df.repartition(5), "o", "k").collect()
    for o in ("p", "q"):
        mine = {(r.k, r.reason) for r in got if r.o == o}
        want = set(greedy([r for r in rows if r[0] == o], [("recent", 3), ("influential", 2), ("diversifying", 2)]))
        assert {x for x in mine if x[1] != "random"} == want and len(mine) == 8 and len({k for k, _ in mine}) == 8


def test_pool_and_small_owners(spark):
    rows, df = items(spark, 2)
    got = candidate_pool(df, "o", "k", 12).collect()
    for o in ("p", "q"):
        assert {(r.k, r.reason) for r in got if r.o == o} == set(greedy([r for r in rows if r[0] == o], [("recent", 6), ("influential", 4), ("diversifying", 2)]))
    assert representative(df.filter("k = 'W000'"), "o", "k").count() == 1 and representative(df.filter(F.lit(False)), "o", "k").count() == 0


def test_focal_pair_against_brute_force(spark):
    rows, df = items(spark, 3)
    got = {(r.o, r.place): r.k for r in focal_pair(df, "o", "k").collect()}
    for o in ("p", "q"):
        own, covered, used = [r for r in rows if r[0] == o], set(), set()
        df_ = {t: sum(t in r[4] for r in own) for r in own for t in r[4]}
        for place in (1, 2):
            cover = {r[1]: sum(1 / df_[t] for t in r[4] if t not in covered) for r in own}
            most = max(cover.values())
            best = min((r for r in own if r[1] not in used), key=lambda r: (-round(0.35 * r[5] + 0.25 * r[6] + 0.25 * r[7] + 0.15 * (cover[r[1]] / most if most else 0), 12), r[1]))
            assert got[o, place] == best[1]
            used.add(best[1])
            covered |= set(best[4])


def test_margin_sample_meets_targets_and_spreads(spark):
    df = spark.createDataFrame([(f"k{i}", "xy"[i % 2], f"i{i % 5}", "r") for i in range(40)], "k string, d string, inst string, reg string")
    out = margin_sample(df, {("d", "x"): 3, ("d", "y"): 2}, "k", ["inst", "reg"], 5, 1)
    chosen = df.join(out, "k").collect()
    assert sum(r.d == "x" for r in chosen) == 3 and len({r.inst for r in chosen}) == 5
    again = margin_sample(df.orderBy(F.desc("k")).repartition(3), {("d", "x"): 3, ("d", "y"): 2}, "k", ["inst", "reg"], 5, 1)
    assert {r.k for r in again.collect()} == {r.k for r in chosen}
    assert margin_sample(df.limit(2), {("d", "x"): 3}, "k", ["inst", "reg"], 5, 1).count() == 2


def test_margin_sample_against_every_record_each_step(spark):
    import hashlib

    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(f"k{i:03d}", rnd.choice(["x", "y", None]), rnd.choice(["i1", "i2", "i3", f"j{i}", None]), rnd.choice(["r1", "r2", None])) for i in range(80)]
        targets, size = {("d", "x"): 7, ("d", "y"): 5}, 20
        mark = {k: hashlib.sha256(f"{seed}\x00{k}".encode()).hexdigest() for k, *_ in rows}
        counts, seen, left, want = dict.fromkeys(targets, 0), [set(), set()], list(rows), []
        for _ in range(size):
            def cost(r):
                now = {t: (abs(counts["d", t] + 1 - n) - abs(counts["d", t] - n)) / n for (_, t), n in targets.items()}
                return (round(now.get(r[1], 0.0) + 0.05 * (r[2] in seen[0]) + 0.02 * (r[3] in seen[1]), 12), mark[r[0]])
            best = min(left, key=cost)
            left.remove(best)
            want.append(best[0])
            if ("d", best[1]) in counts:
                counts["d", best[1]] += 1
            for s, p in zip(seen, best[2:]):
                if p is not None:
                    s.add(p)
        df = spark.createDataFrame(rows, "k string, d string, inst string, reg string").repartition(3)
        got = margin_sample(df, targets, "k", ["inst", "reg"], size, seed)
        assert [r.k for r in got.orderBy("selection_order").collect()] == want


def test_margin_sample_of_a_thousand_seats(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("d"), F.concat(F.lit("i"), F.col("id") % 300).alias("inst"), F.lit("r").alias("reg"))
    out = df.join(margin_sample(df, {("d", "x"): 600, ("d", "y"): 400}, "k", ["inst", "reg"], 1000, 3), "k")
    assert {r.d: r["count"] for r in out.groupBy("d").count().collect()} == {"x": 600, "y": 400} and out.select("inst").distinct().count() == 300
