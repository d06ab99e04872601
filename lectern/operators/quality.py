"""Checks as data: every rule yields a frame of (check_name, entity, detail) rows, and rules are unioned."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import materialize

#: Names that are sought in one pass over the texts.
NAMES_AT_ONCE = 500_000
ERROR = "check_name string, entity string, detail string"


def errors(df: DataFrame, check: str, entity: Column | str, detail: Column) -> DataFrame:
    e = F.col(entity) if isinstance(entity, str) else entity
    return df.select(F.lit(check).alias("check_name"), e.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def not_unique(df: DataFrame, key: str, check: str) -> DataFrame:
    """Keys in more than one row; a null key counts as one key."""
    return errors(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), check, key, F.col("n"))


def malformed(df: DataFrame, key: str, pattern: str, check: str) -> DataFrame:
    return errors(df.filter(F.col(key).isNull() | ~F.col(key).rlike(pattern)).select(key).distinct(), check, key, F.lit(pattern))


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str, check: str) -> DataFrame:
    """Keys without a parent (a left anti join on distinct keys); null keys are no reference."""
    keys = df.select(F.col(key).alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    return errors(keys.join(parents.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti"), check, "k", F.col("n"))


def wrong_count(df: DataFrame, group: str, least: int, most: int, check: str) -> DataFrame:
    """Groups with fewer or more distinct rows than allowed."""
    return errors(df.groupBy(group).agg(F.count("*").alias("n")).filter(~F.col("n").between(least, most)), check, group, F.col("n"))


def differing_sets(a: DataFrame, b: DataFrame, group: str, member: str, check: str) -> DataFrame:
    """Groups whose member sets differ; compared by order-free hash sums and counts, so no set is ever gathered."""
    def sums(df: DataFrame, tag: str) -> DataFrame:
        d = df.select(group, member).distinct()
        return d.groupBy(group).agg(F.count(member).alias(f"n_{tag}"), F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias(f"h_{tag}"))

    both = sums(a, "a").join(sums(b, "b"), group, "full")
    return errors(both.filter(~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b")))), check, group, F.concat_ws("/", F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))))


def unreferenced(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer comparison of keys: (side, n) of those only left, only right, and on both sides."""
    x, y = a.select(*key).distinct().withColumn("in_a", F.lit(True)), b.select(*key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").otherwise("both")
    return x.join(y, list(key), "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def searched_form(text: str) -> str:
    """NFKC, casefolded, a single blank for whatever stands between letters and digits."""
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


_searched = F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None else searched_form(t)), T.StringType())


def _scan(names: Broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in names.value:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column("__text").to_pylist()):
                met = {n for _, n in automaton.iter(searched_form(t))} if t else ()
                rows += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "searched"])

    return run


def containing_names(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, least_letters: int = 4) -> DataFrame:
    """(key, name) of texts that contain a name anywhere, glued to other letters or not, in the form of ``searched_form``.

    The texts are scanned for up to NAMES_AT_ONCE names in one pass (an automaton that finds all of them together), and
    once more for every further so many names; no text is shuffled or held against single names.  Names of fewer
    characters than the bound aren't looked for; null texts and names match nothing.
    """
    spark = texts.sparkSession
    wanted = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().withColumn("searched", _searched("name"))
    wanted = materialize(wanted.filter(F.length("searched") >= least_letters), "names-searched")
    parts = -(-wanted.count() // NAMES_AT_ONCE)
    t = texts.select(F.col(key).alias("__of"), F.col(text).alias("__text"))
    schema = f"__of {texts.schema[key].dataType.simpleString()}, searched string"
    met = [t.sparkSession.createDataFrame([], schema)]
    for part in range(parts):
        own = wanted.filter(F.pmod(F.xxhash64("searched"), F.lit(parts)) == part).select("searched").distinct()
        found = [r[0] for r in own.collect()]  # about NAMES_AT_ONCE
        if found:
            met.append(t.mapInArrow(_scan(spark.sparkContext.broadcast(found), "__of"), schema))
    hits = reduce(DataFrame.unionByName, met)
    return hits.join(wanted, "searched").select(F.col("__of").alias(key), "name").distinct()
