"""Column expressions that many operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern: white space as Unicode has it.
SPACE = r"(?U)\s+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare_id(c: Column | str) -> Column:
    """Last path segment of a provider id given bare or as a URL; blank is null."""
    trimmed = F.regexp_replace(F.trim(as_column(c)), r"/+$", "")
    return F.nullif(F.trim(F.element_at(F.split(trimmed, "/"), -1)), F.lit(""))


def clean(c: Column | str) -> Column:
    """Trimmed text (white space as Unicode has it); blank is null."""
    c = as_column(c)
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def first_nonblank(*cs: Column | str) -> Column:
    return F.coalesce(*[clean(c) for c in cs])


def squeeze(c: Column | str) -> Column:
    """Lower-case letters only, for comparing freely typed category names."""
    return F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}]", "")


def slug(c: Column | str) -> Column:
    """``Free Spelling`` or ``free-spelling`` to ``free_spelling``; blank is null."""
    inner = F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(inner, r"^_+|_+$", ""), F.lit(""))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest by ``order`` (nulls lowest).

    Only ``keys``, ``order`` and ``keep`` are shuffled; rows with a null key form one group like any other.
    Rows equal in ``order`` are settled by the kept values themselves, so the result never depends on
    partitioning (kept values must then be orderable types).
    """
    ranked = F.struct(*[as_column(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("kept"))
    picked = df.groupBy(*keys).agg(F.max(ranked).alias("picked"))
    return picked.select(*keys, *[F.col(f"picked.kept.{c}").alias(c) for c in keep])
