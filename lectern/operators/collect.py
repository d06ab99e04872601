"""Collection operators: records of pages in order, first seen wins, discovery sets united, screening and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str], discovered_by: str | None = None) -> DataFrame:
    """The first row of each key by ``order``, with the sorted set of all values of ``discovered_by``.

    Rows with a null key are left out; equal orders are settled by the kept values.
    """
    first = F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("k"))).alias("x")
    sets = [F.array_sort(F.collect_set(discovered_by)).alias("discovered_by")] if discovered_by else []
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(first, *sets)
    return g.select(key, *[F.col(f"x.k.{c}").alias(c) for c in keep], *(["discovered_by"] if discovered_by else []))


def status_cascade(rules: Sequence[tuple[Column, str]], passed: str) -> Column:
    """The name of the first rule that fails (is not true), or ``passed``."""
    out = F.lit(passed)
    for ok, name in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def collection_summary(df: DataFrame, key: str, valid: Column, by: Sequence[str]) -> DataFrame:
    """One row: fetched, valid, invalid, duplicates removed, and distinct values of ``by``."""
    return df.agg(
        F.count("*").alias("n_fetched"), F.count_if(valid).alias("n_valid"), (F.count("*") - F.count_if(valid)).alias("n_invalid"),
        (F.count_if(valid) - F.countDistinct(F.when(valid, F.col(key)))).alias("n_duplicates"), *[F.countDistinct(c).alias(f"n_{c}") for c in by],
    )


def cursor_chain(pages: DataFrame, cursor: str, next_cursor: str, most_rounds: int = 40) -> DataFrame:
    """(cursor, steps) of pages reachable from ``*`` along next cursors; a cycle is an error.

    Pointer doubling: rounds grow with the logarithm of the chain, each is one join of pages with themselves.
    """
    from lectern.storage import materialize

    links = materialize(pages.select(F.col(next_cursor).alias("at"), F.col(cursor).alias("up"), F.lit(1).cast("long").alias("steps")).filter("at IS NOT NULL"), "chain")
    for _ in range(most_rounds):
        up = links.select(F.col("at").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"))
        joined = links.join(up, "up", "left")
        if joined.filter("up2 IS NOT NULL").isEmpty():
            break
        links = materialize(joined.select("at", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps")), "chain")
        if not links.filter("at = up").isEmpty():
            raise ValueError("the pages' cursors form a cycle")
    else:
        raise RuntimeError("the chain of pages did not end")
    return links.filter("up = '*'").select(F.col("at").alias("cursor"), "steps").unionByName(pages.filter(F.col(cursor) == "*").select(F.col(cursor).alias("cursor"), F.lit(0).cast("long").alias("steps")).distinct())
