"""Ranks, percentiles and neighbours that hold for groups of any size.

A window over one group sorts that group in one task.  The functions here range-partition over (group, order) instead
and carry a few numbers per partition, so that a group holding most rows is still ranked by all tasks together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import materialize


def sorted_runs(df: DataFrame, keys: Sequence[str], label: str = "runs") -> DataFrame:
    """``df`` range-partitioned by ``keys`` with the number of the partition in ``__run``; written, so that it stays so."""
    return materialize(df.repartitionByRange(*keys).withColumn("__run", F.spark_partition_id()), label)


def _null_safe(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def midrank(df: DataFrame, strata: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """(strata, value, percentile, stratum_size) of each distinct value: 100 * (below + equal / 2) / size.

    Null and NaN values have no percentile and don't count.  Equal values are counted together before anything is
    shuffled in order; the running total of a stratum is that within a partition plus the totals of the partitions
    before it.  A null stratum is a stratum like any other.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = sorted_runs(clean.groupBy(*strata, value).agg(F.count("*").alias("__n")), [*strata, value], "midrank")
    totals = counts.groupBy(*strata, "__run").agg(F.sum("__n").alias("__t"))  # a row per stratum and partition it touches
    before = Window.partitionBy(*strata).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1) if strata else Window.partitionBy(F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offsets = totals.select(*strata, F.col("__run"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"), F.sum("__t").over(whole).alias("stratum_size"))
    inside = Window.partitionBy("__run", *strata).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__below", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    joined = ranked.join(offsets, _null_safe(ranked, offsets, ["__run", *strata]))
    pct = (F.col("__below") + F.col("__before") + F.col("__n") / 2) * 100.0 / F.col("stratum_size")
    return joined.select(*[ranked[c] for c in strata], ranked[value], pct.alias(name), "stratum_size")


def with_midrank(df: DataFrame, strata: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """``df`` with the percentile of its value in its stratum; null where it has no value.

    Rows without a value aren't joined.  The join is a plain one, so a value that very many rows share is split by the
    engine where it is skewed.
    """
    table = midrank(df, strata, value, name).drop("stratum_size")
    renamed = table.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*strata, value])], name)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    have, lack = df.filter(known), df.filter(~F.coalesce(known, F.lit(False)))
    on = have[value] == renamed[f"__k{len(strata)}"]
    for i, c in enumerate(strata):
        on = on & have[c].eqNullSafe(renamed[f"__k{i}"])
    ranked = have.join(renamed, on, "left").select(have["*"], name)
    return ranked.unionByName(lack.withColumn(name, F.lit(None).cast("double")))


def cascading_midrank(df: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], value: str, least: int) -> DataFrame:
    """``df`` with ``stratum`` (the name of a level) and ``percentile`` of its value there.

    A row's stratum is the first level whose columns it all has and whose group has at least ``least`` values; the last
    level must have no columns and takes the rest.  All members of a group count in it, whatever their own stratum is.
    Counts of values at all levels are made in one aggregation, and each row is joined to one of them only.
    """
    if not levels or levels[-1][1]:
        raise ValueError("the last level must have no columns")
    keyed = df
    for name, columns in levels:
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        keyed = keyed.withColumn(f"__key_{name}", F.when(there, F.to_json(F.struct(F.lit(name).alias("level"), *columns))))
    members = keyed.select(F.explode(F.array(*[F.col(f"__key_{name}") for name, _ in levels])).alias("__stratum"), F.col(value).alias("__value")).filter("__stratum IS NOT NULL")
    table = materialize(midrank(members, ["__stratum"], "__value"), "cascade")
    sizes = table.groupBy("__stratum").agg(F.max("stratum_size").alias("__size"))
    chosen, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, columns in reversed(levels):
        if columns:
            keyed = keyed.join(sizes.select(F.col("__stratum").alias(f"__key_{name}"), F.col("__size").alias(f"__size_{name}")), f"__key_{name}", "left")
        enough = F.coalesce(F.col(f"__size_{name}"), F.lit(0)) >= least if columns else F.lit(True)
        chosen, key = F.when(enough, name).otherwise(chosen), F.when(enough, F.col(f"__key_{name}")).otherwise(key)
    placed = keyed.select(*df.columns, chosen.alias("stratum"), key.alias("__stratum"))
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    have, lack = placed.filter(known), placed.filter(~F.coalesce(known, F.lit(False)))
    percentiles = table.select(F.col("__stratum").alias("__s"), F.col("__value").alias("__of"), "percentile")
    ranked = have.join(percentiles, (F.col("__stratum") == F.col("__s")) & (F.col(value) == F.col("__of")), "left")
    return ranked.select(*df.columns, "stratum", "percentile").unionByName(lack.select(*df.columns, "stratum", F.lit(None).cast("double").alias("percentile")))


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``prev_<column>`` of the row before it in its group; null for the first.

    The last row of every partition (a row per partition) is handed to the next one.
    """
    runs = sorted_runs(df, [*group, *order], "previous")
    w = Window.partitionBy("__run", *group).orderBy(*order)
    own = runs.withColumns({f"__p_{c}": F.lag(F.struct(F.col(c))).over(w) for c in columns}).withColumn("__first", F.row_number().over(w) == 1)
    last = runs.groupBy("__run").agg(F.max(F.struct(*group, *order, *[F.col(c).alias(f"v_{c}") for c in columns])).alias("x"))
    following = F.lead("__run").over(Window.partitionBy(F.lit(0)).orderBy("__run"))  # of the partitions that have rows
    last = last.select(following.alias("__lrun"), *[F.col(f"x.{g}").alias(f"__g_{g}") for g in group], *[F.col(f"x.v_{c}").alias(f"__v_{c}") for c in columns])
    on = (own["__run"] == last["__lrun"]) & own["__first"]
    for g in group:
        on = on & own[g].eqNullSafe(last[f"__g_{g}"])
    joined = own.join(last, on, "left")
    return joined.select(*df.columns, *[F.when(F.col("__first"), F.col(f"__v_{c}")).otherwise(F.col(f"__p_{c}.{c}")).alias(f"prev_{c}") for c in columns])


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows of each group with their place in ``place``; ``order`` must settle all ties.

    Places are cut off in salted parts of a group first, so at most ``salts * n`` rows of a group meet in a task.
    """
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))).filter(F.col("place") <= n)
    return part.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n).drop("__salt")


def hash_rank_id(df: DataFrame, prefix: str, key: str, version: str, name: str = "anonymous_id") -> DataFrame:
    """Ids ``<prefix>-<rank>`` by rank of ``sha256(version NUL key)`` within the prefix, three digits at least."""
    hashed = df.withColumn("__h", F.sha2(F.concat(F.lit(version + "\x00"), F.col(key)), 256))
    place = midrank_place(hashed, [prefix], ["__h", key])
    return place.withColumn(name, F.format_string("%s-%03d", F.col(prefix), F.col("place"))).drop("__h", "place")


def midrank_place(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in its group, by all tasks together."""
    runs = sorted_runs(df, [*group, *order], "place")
    totals = runs.groupBy(*group, "__run").agg(F.count("*").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__o_{g}") for g in group], F.col("__run").alias("__orun"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    ranked = runs.withColumn("__at", F.row_number().over(Window.partitionBy("__run", *group).orderBy(*order)))
    on = ranked["__run"] == offsets["__orun"]
    for g in group:
        on = on & ranked[g].eqNullSafe(offsets[f"__o_{g}"])
    return ranked.join(offsets, on).select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))
