"""Problem 9: sources mixed to target weights, by raking token weights to several marginals.

Tokens are counted by cell (source, language, topic).  Proportional fitting turns the counts into weights whose source
shares are the targets while language and topic shares stay those of the corpus; a source can be repeated only so
often, so its weight is cut off at that and what is missing is reported, not given to others.  A cell's weight over
its tokens is the expected number of copies of its documents; each document gets its whole part, and one more with the
rest as probability.  The draw is systematic: one random start a source, and one running total over all of its
documents in order of size, so that even a source of few documents comes close to its target.  The running total is
kept in whole units and carried over range partitions, so it is the same however the documents are spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rank import sorted_runs

#: Rounds of raking at most; it ends before, once no weight moves by more than SETTLED of itself.
ROUNDS, SETTLED = 200, 1e-9
#: Languages kept apart: codes of two or three letters; anything else is one group, so cells stay few.
LANGUAGE_CODE = r"^[a-z]{2,3}$"
#: Units a copy is counted in by the running total: sums stay whole numbers up to 2^39 documents of a source.
UNITS = 1 << 24


def language(c: str) -> Column:
    code = F.lower(F.trim(F.split(F.col(c), r"[-_]")[0]))
    return F.when(code.rlike(LANGUAGE_CODE), code).otherwise("other")


def topic() -> Column:
    """One of eight topics: the signs of three projected dimensions."""
    return sum(((F.col(f"v{i}") >= 0).cast("int") * (1 << i) for i in range(1, 3)), (F.col("v0") >= 0).cast("int"))


@dataclass
class MixPlan:
    cells: pd.DataFrame  # source, lang, topic, tokens, rate
    sources: pd.DataFrame  # source, target_share, max_repeats, tokens, wanted, planned
    rounds: int = 0  # of raking
    residual: float = 0.0  # largest relative error of a language's or topic's weight in the end


def filled(weight: np.ndarray, cap: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights scaled within each group to sum to its goal, none above its cap: what a capped cell can't take goes to
    the group's others.  Ends after as many steps as cells at most, since each caps another one."""
    whole = np.bincount(code, cap, len(goal)) <= goal * (1 + 1e-12)
    weight = weight * (goal / np.maximum(np.bincount(code, weight, len(goal)), 1e-300))[code]
    weight = np.where(whole[code], cap, np.minimum(weight, cap))
    for _ in range(len(weight)):
        free = weight < cap
        room = goal - np.bincount(code, np.where(free, 0.0, weight), len(goal))
        held = np.bincount(code, np.where(free, weight, 0.0), len(goal))
        scaled = np.where(free, weight * (room / np.maximum(held, 1e-300))[code], weight)
        weight = np.minimum(scaled, cap)
        if not (scaled > cap).any():
            break
    return weight


def met_total(targets: pd.DataFrame, tokens: pd.Series) -> float:
    """The largest mix in which every source that has tokens can give its share."""
    most = targets["source"].map(tokens).fillna(0) * targets["max_repeats"]
    able = (most > 0) & (targets["target_share"] > 0)
    return float((most[able] / targets["target_share"][able]).min()) if able.any() else 0.0


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float | None = None) -> MixPlan:
    """Rates of cells (a row per source, language and topic) for targets (a row per source).

    The mix is to have ``total`` tokens: by default as many as the named sources have.
    """
    cells = cells[cells["source"].isin(targets["source"]) & (cells["tokens"] > 0)].reset_index(drop=True)
    own = cells.groupby("source")["tokens"].sum()
    sources = targets.assign(tokens=targets["source"].map(own).fillna(0).astype("int64"))
    corpus = float(sources["tokens"].sum())
    sources["wanted"] = sources["target_share"] * (corpus if total is None else total)
    most = (sources["tokens"] * sources["max_repeats"]).astype(float)
    sources["planned"] = np.minimum(sources["wanted"], most)
    if not len(cells):
        return MixPlan(cells.assign(rate=pd.Series(dtype=float)), sources)
    weight = cells["tokens"].to_numpy(float)
    cap = weight * cells["source"].map(sources.set_index("source")["max_repeats"]).to_numpy(float)
    goal_total = float(sources["planned"].sum())
    margins = [(pd.factorize(cells[c])[0], cells.groupby(c, sort=False)["tokens"].sum().to_numpy(float) / corpus * goal_total) for c in ("lang", "topic")]
    s_code, s_names = pd.factorize(cells["source"])
    s_goal = sources.set_index("source")["planned"].reindex(s_names).to_numpy(float)
    for rounds in range(1, ROUNDS + 1):
        before = weight
        for code, goal in margins:
            weight = np.minimum(weight * (goal / np.maximum(np.bincount(code, weight), 1e-9))[code], cap)
        weight = filled(weight, cap, s_code, s_goal)  # sources last, and exactly
        if (np.abs(weight - before) <= SETTLED * np.maximum(before, 1e-9)).all():
            break
    residual = max(float(np.max(np.abs(np.bincount(code, weight) - goal) / np.maximum(goal, 1e-9))) for code, goal in margins)
    return MixPlan(cells.assign(rate=weight / cells["tokens"].to_numpy(float)), sources, rounds, residual)


def mix(documents: DataFrame, targets: pd.DataFrame, key: str, seed: int = 7, total: str = "corpus") -> tuple[DataFrame, MixPlan]:
    """``documents(key, source, lang, topic, n_tokens)`` with ``copies`` of those in the mix, and the plan.

    With ``total="corpus"`` the mix is to be as large as the named sources are, and sources that can't give their share
    leave it smaller; with ``"met"`` it is only as large as lets every source that has documents give its share.
    Cells are collected: sources named by targets times language codes times eight topics.

    Defined results: documents of no named source (null too) and documents without tokens are left out; a named source
    without documents is short of its whole target; repeated keys are separate documents with equal chances; an empty
    frame gives an empty mix; further columns are ignored; targets must name a source once.
    """
    if total not in ("corpus", "met"):
        raise ValueError("total is corpus or met")
    documents = documents.select(key, "source", "lang", "topic", "n_tokens")
    spark = documents.sparkSession
    named = documents.join(F.broadcast(spark.createDataFrame(targets[["source"]].drop_duplicates())), "source", "left_semi")  # a row per target
    cells = named.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    plan = rake(cells, targets, met_total(targets, cells.groupby("source")["tokens"].sum()) if total == "met" else None)
    rows = [(r.source, r.lang, int(r.topic), float(r.rate)) for r in plan.cells.itertuples(index=False)]
    rates = spark.createDataFrame(rows, "source string, lang string, topic int, rate double")
    rated = named.filter("n_tokens > 0").join(F.broadcast(rates), ["source", "lang", "topic"])  # a row per cell
    rest = F.round((F.col("rate") - F.floor("rate")) * UNITS).cast("long")
    runs = sorted_runs(rated.withColumns({"__rest": rest, "__draw": F.xxhash64(F.lit(seed + 1), key)}), ["source", "n_tokens", "__draw", key], "mix-runs")
    before = Window.partitionBy("source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # over a row per source and partition
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source"), F.lit(UNITS))
    offsets = runs.groupBy("source", "__run").agg(F.sum("__rest").alias("__sum")).select("source", "__run", (F.coalesce(F.sum("__sum").over(before), F.lit(0)) + begin).alias("__before"))
    inside = Window.partitionBy("__run", "source").orderBy("n_tokens", "__draw", key).rowsBetween(Window.unboundedPreceding, 0)
    drawn = runs.withColumn("__sum", F.sum("__rest").over(inside)).join(offsets, ["source", "__run"])
    upto = F.col("__before") + F.col("__sum")
    copies = F.floor("rate") + F.floor(upto / UNITS) - F.floor((upto - F.col("__rest")) / UNITS)
    return drawn.withColumn("copies", copies.cast("int")).filter("copies > 0").select(key, "source", "lang", "topic", "n_tokens", "copies"), plan


def mix_report(drawn: DataFrame, plan: MixPlan) -> DataFrame:
    """Every source with its target, what was planned, and the share it really has of the mix.

    ``is_short``: the mix has fewer tokens of the source than wanted although it holds every copy allowed.
    """
    spark = drawn.sparkSession
    rows = list(plan.sources[["source", "target_share", "max_repeats", "tokens", "wanted", "planned"]].itertuples(index=False, name=None))
    plain = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows]
    sources = spark.createDataFrame(plain, "source string, target_share double, max_repeats int, tokens long, wanted double, planned double")
    taken = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    total = F.sum("mixed_tokens").over(_everything())
    out = sources.join(taken, "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    spent = F.col("mixed_tokens") >= F.col("tokens") * F.col("max_repeats")
    return out.withColumns({"is_short": spent & (F.col("mixed_tokens") < F.col("wanted") * (1 - 1e-9)), "actual_share": F.try_divide(F.col("mixed_tokens").cast("double"), total)})


def marginal_report(drawn: DataFrame, plan: MixPlan) -> DataFrame:
    """(dimension, category, wanted_share, actual_share, rounds, residual) of sources, languages and topics.

    ``wanted_share`` of a source is its target, of a language or topic its share of the corpus; ``residual`` is the
    largest relative error that raking left in a language or topic.
    """
    spark, rows = drawn.sparkSession, []
    for dimension in ("source", "lang", "topic"):
        have = plan.cells.groupby(dimension)["tokens"].sum() / max(float(plan.cells["tokens"].sum()), 1.0)
        wanted = dict(zip(plan.sources["source"], plan.sources["target_share"])) if dimension == "source" else have.to_dict()
        rows += [(dimension, str(category), float(share), plan.rounds, float(plan.residual)) for category, share in wanted.items()]
    want = spark.createDataFrame(rows, "dimension string, category string, wanted_share double, rounds int, residual double")
    cells = drawn.groupBy("source", "lang", "topic").agg(F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("category")) for c in ("source", "lang", "topic")]))
    got = cells.select("n", each.alias("x")).groupBy("x.dimension", "x.category").agg(F.sum("n").alias("n"))
    out = want.join(got, ["dimension", "category"], "left").fillna(0.0, ["n"])
    total = F.sum("n").over(Window.partitionBy("dimension"))  # a row per category
    return out.select("dimension", "category", "wanted_share", F.try_divide("n", total).alias("actual_share"), "rounds", "residual")


def _everything():
    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over a row per source
