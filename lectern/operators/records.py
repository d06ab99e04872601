"""Rules over single records and small groups of them: cells of text tables, dates, topics, locations, packets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import as_column, clean

# States of open access, and words that tell a domain, in the order they are tried.
OPEN_STATES, CLOSED_STATES = ("diamond", "gold", "green", "hybrid", "bronze"), ("closed",)
DOMAIN_WORDS = {
    "CS": ("computer", "engineering"),
    "BIO": ("medicine", "medical", "health", "biolog", "neuroscience"),
    "PSY": ("psycholog", "cognitive"),
    "PHY": ("physical", "physics", "mathemat", "chemistry", "astronom"),
}
OTHER_DOMAIN = "SSH"


def csv_cell(c: Column | str) -> Column:
    """A value as a cell of a text table: null as the empty string, truth values in lower case."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def truth_cell(c: Column | str) -> Column:
    """``true`` and ``false`` in any case to a truth value; anything else is null."""
    t = F.lower(F.trim(as_column(c)))
    return F.when(t == "true", True).when(t == "false", False)


def date_key(date: Column | str, year: Column | str) -> Column:
    """YYYYMMDD of a date that has eight digits, else the year times 10,000 where it is 1 to 9999, else null."""
    digits = F.replace(as_column(date), F.lit("-"), F.lit(""))
    y = as_column(year)
    return F.when(digits.rlike(r"^[0-9]{8}$"), digits.cast("int")).when(y.between(1, 9999), y.cast("int") * 10_000)


def first_domain(text: Column | str, words: Mapping[str, Sequence[str]] = DOMAIN_WORDS, other: str = OTHER_DOMAIN) -> Column:
    """The first domain one of whose words is contained in the text, whatever stands around it."""
    t = F.lower(F.coalesce(as_column(text), F.lit("")))
    out = F.lit(other)
    for name, parts in reversed(list(words.items())):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(t, F.lit(part))
        out = F.when(hit, name).otherwise(out)
    return out


def distinct_by_id(items: Column | str, key: str, label: str) -> Column:
    """The array without later items of an id met before; items without an id stay, told apart by place and label."""
    items = as_column(items)
    key_of = lambda x, i: F.coalesce(clean(x[key]), F.concat(F.lit("missing-id:"), i.cast("string"), F.lit(":"), F.coalesce(x[label], F.lit(""))))
    keys = F.transform(items, key_of)
    return F.filter(items, lambda x, i: F.array_position(keys, key_of(x, i)) == i + 1)


def breadth(items: Column | str, keys: Sequence[str]) -> Column:
    """Number of different values of the first key that any item has a value of; spelling of case and blanks aside."""
    items = as_column(items)

    def different(key: str) -> Column:
        values = F.transform(items, lambda x: F.lower(clean(x[key])))
        return F.size(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))

    sizes = [different(k) for k in keys]
    out = F.lit(0)
    for n in reversed(sizes):
        out = F.when(n > 0, n).otherwise(out)
    return out


def tags_or(direct: Column | str, fallback: Column | str) -> Column:
    """The sorted different tags of a ``|``-joined cell, or those of another where it has none."""

    def tags(c: Column | str) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(as_column(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_sort(F.array_distinct(parts))

    return F.when(F.size(tags(direct)) > 0, tags(direct)).otherwise(tags(fallback))


def open_observation(flag: Column | str, state: Column | str) -> Column:
    """Whether a work is open, by its flag and its state; null where neither says or they contradict each other."""
    f, s = as_column(flag), F.lower(clean(state))
    by_state = F.when(s.isin(*OPEN_STATES), True).when(s.isin(*CLOSED_STATES), False)
    return F.when(f.isNotNull() & by_state.isNotNull() & (f != by_state), None).otherwise(F.coalesce(f, by_state))


def location_score(observed: Column, primary: Column, locations: Column) -> Column:
    """Best open location: 1.0 with a link to the document, 0.9 to a page, 0.5 for an open work without any, else 0."""
    link = lambda c: F.coalesce(F.lower(F.trim(c)).rlike("^https?://"), F.lit(False))
    all_of = F.array_append(F.coalesce(locations, F.array(primary)), primary)
    score = lambda x: F.when(~F.coalesce(x["is_oa"], F.lit(False)), 0.0).when(link(x["pdf_url"]), 1.0).when(link(x["landing_page_url"]), 0.9).otherwise(0.0)
    best = F.coalesce(F.array_max(F.transform(all_of, score)), F.lit(0.0))
    closed = F.coalesce(~observed, F.lit(False))
    return F.when(closed, 0.0).when(best > 0, best).when(F.coalesce(observed, F.lit(False)), 0.5).otherwise(0.0)


def reason_histogram(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """(reason, n) of the conditions that hold (null counts as not), each row counting for all of its reasons."""
    met = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]))
    return df.select(F.explode(met).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def mixed_topics(df: DataFrame, group: str, topic: str, least: int, share: float) -> DataFrame:
    """Groups with at least ``least`` different topics of which none has ``share`` of all; null topics don't count."""
    counts = df.filter(F.col(group).isNotNull() & F.col(topic).isNotNull()).groupBy(group, topic).agg(F.count("*").alias("n"))
    per = counts.groupBy(group).agg(F.count("*").alias("n_topics"), (F.max("n") / F.sum("n")).alias("top_share"))
    return per.filter((F.col("n_topics") >= least) & (F.col("top_share") < share))


def not_contained(part: DataFrame, whole: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_missing) of groups with members of ``part`` that ``whole`` doesn't have."""
    missing = part.select(group, member).distinct().join(whole.select(group, member).distinct(), [group, member], "left_anti")
    return missing.groupBy(group).agg(F.count("*").alias("n_missing"))
