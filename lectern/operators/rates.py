"""Rates over labelled claims: (condition, email, label) rows, one per claim, and (email, n_words).

All of them are two-level: counts per email first, so that an email's words count once and the second level is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.labels import is_factual, is_severe


def per_email(claims: DataFrame, group: Sequence[str], email: str, label: str, blacklist: bool = False) -> DataFrame:
    """Counts per group and email; labels that are null count only towards ``n_claims``."""
    return claims.groupBy(*group, email).agg(
        F.count("*").alias("n_claims"), F.count_if(is_factual(label, blacklist)).alias("n_factual"), F.count_if(is_severe(label)).alias("n_severe"),
        F.count_if(F.coalesce(F.col(label) == "supported", F.lit(False))).alias("n_supported"), F.count(label).alias("n_labelled"),
    )


def condition_metrics(claims: DataFrame, words: DataFrame, group: Sequence[str], email: str, label: str, blacklist: bool = False) -> DataFrame:
    """Per group: emails, claims, severe-error rate, supported statements per 100 words, rate of emails with a severe error.

    Rates are null where their denominator is empty.  Emails without a word count count no words; the email-level
    rate is over emails with at least one factual claim.
    """
    each = per_email(claims, group, email, label, blacklist).join(words, email, "left")
    return each.groupBy(*group).agg(
        F.count("*").alias("n_emails"), F.sum("n_claims").alias("n_claims"), F.sum("n_factual").alias("n_factual"), F.sum("n_severe").alias("n_severe"),
        F.try_divide(F.sum("n_severe").cast("double"), F.sum("n_factual")).alias("severe_error_rate"),
        F.try_divide(F.sum("n_supported") * 100.0, F.sum(F.coalesce("n_words", F.lit(0)))).alias("supported_density"),
        F.try_divide(F.count_if((F.col("n_severe") > 0) & (F.col("n_factual") > 0)).cast("double"), F.count_if(F.col("n_factual") > 0)).alias("email_severe_rate"),
    )


def label_rates(claims: DataFrame, group: Sequence[str], label: str, targets: Sequence[str]) -> DataFrame:
    """Share of each target label among the factual ones of a group (of all labels for targets that aren't factual)."""
    factual = F.count_if(is_factual(label))
    return claims.groupBy(*group).agg(*[F.try_divide(F.count_if(F.coalesce(F.col(label) == t, F.lit(False))).cast("double"), factual).alias(f"{t}_rate") for t in targets])


def edit_rates(edits: DataFrame, group: Sequence[str], action: str) -> DataFrame:
    """Deletions, and rewrites or softenings, among the edits of a group; a group without edits has no row."""
    n = F.count("*")
    return edits.groupBy(*group).agg(
        n.alias("n_edits"), F.count_if(F.col(action) == "delete").alias("n_deleted"), F.try_divide(F.count_if(F.col(action) == "delete").cast("double"), n).alias("delete_rate"),
        F.try_divide(F.count_if(F.col(action).isin("rewrite", "soften")).cast("double"), n).alias("rewrite_rate"),
    )


def wide_counts(df: DataFrame, row: str, column: str, counts: Mapping[str, Column]) -> DataFrame:
    """One row per ``row``, and for every value of ``column`` that occurs a column ``<value>_<name>`` of each count; 0 where
    there is nothing.  Rows with a null in ``column`` belong to no column."""
    df = df.filter(F.col(column).isNotNull())
    wide = df.groupBy(row).pivot(column).agg(*[c.alias(name) for name, c in counts.items()])
    if len(counts) == 1:  # the engine names such columns by their value alone
        wide = wide.select(row, *[F.col(f"`{c}`").alias(f"{c}_{next(iter(counts))}") for c in wide.columns if c != row])
    return wide.fillna(0)


def leave_one_out(totals: DataFrame, group: str, left_out: str, sums: Sequence[str]) -> DataFrame:
    """For each value of ``left_out``, the sums of all its siblings in the group: total minus own, no join of the rows."""
    whole = totals.groupBy(group).agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    return totals.join(whole, group).select(group, left_out, *[(F.col(f"all_{s}") - F.col(s)).alias(s) for s in sums])
