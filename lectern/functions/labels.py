"""Claim labels: their spellings and the sets that rates are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.columns import as_column

# The labels, those that are no statement of fact, and the severe ones.
LABELS = ("supported", "partially_supported", "overstated", "unsupported", "contradicted", "outside_evidence_scope", "subjective_or_generic")
NON_FACTUAL = ("outside_evidence_scope", "subjective_or_generic")
SEVERE = ("unsupported", "contradicted")
FACTUAL = tuple(x for x in LABELS if x not in NON_FACTUAL)


def normalize_label(c: Column | str) -> Column:
    """Trimmed, lower case, spaces and hyphens as underscores; null where that is no label."""
    n = F.translate(F.lower(F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")), " -", "__")
    return F.when(n.isin(*LABELS), n)


def is_factual(c: Column | str, blacklist: bool = False) -> Column:
    """Known factual labels; with ``blacklist`` everything that isn't known to be non-factual."""
    c = as_column(c)
    return c.isNotNull() & ~c.isin(*NON_FACTUAL) if blacklist else F.coalesce(c.isin(*FACTUAL), F.lit(False))


def is_severe(c: Column | str) -> Column:
    return F.coalesce(as_column(c).isin(*SEVERE), F.lit(False))
