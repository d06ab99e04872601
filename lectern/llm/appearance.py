"""Bindings of problem 10 to documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lookalike import CYRILLIC, FULL_WIDTH, GREEK, INVISIBLE, JOINED, SINGLETONS, SPACES, composed, decomposed, lookalike_classes, lookalike_pairs, plain_form
from lectern.sources.tables import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    members = lookalike_classes(table(spark, d, "documents"), "doc_id", "text")
    return lookalike_pairs(members, "doc_id")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents in a class of look-alikes, with the document whose text stands for all."""
    return lookalike_classes(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "canonical_key")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its text in the one consistent form; members of a class share the canonical member's."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    members = lookalike_classes(docs, "doc_id", "text").select("doc_id", "canonical_key")
    standing = members.select(F.col("canonical_key")).distinct().join(docs.withColumnRenamed("doc_id", "canonical_key").withColumnRenamed("text", "canonical_text"), "canonical_key")
    joined = docs.join(members.join(standing, "canonical_key"), "doc_id", "left")
    form = plain_form(decomposed(F.coalesce("canonical_text", "text")))
    return joined.select("doc_id", composed(form).alias("consistent_text"), F.col("canonical_key").isNotNull().alias("had_lookalike"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _skeleton_sql(c: str) -> str:
    """DuckDB composes letters but can't part them, so composed look-alikes are parted one by one."""
    single = FULL_WIDTH | CYRILLIC | GREEK | SINGLETONS
    out = c
    for x in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        parted = unicodedata.normalize("NFD", x)
        if len(parted) > 1 and parted[0] in single:
            out = f"replace({out}, {_sql_text(x)}, {_sql_text(parted)})"
    source, target = "".join(single) + SPACES + INVISIBLE, "".join(single.values()) + " " * len(SPACES)
    for joined, letters in JOINED.items():
        out = f"replace({out}, {_sql_text(joined)}, {_sql_text(letters)})"
    return f"nfc_normalize(trim(translate({out}, {_sql_text(source)}, {_sql_text(target)}), ' \t'))"


_SKELETONS = f"s AS (SELECT doc_id, text, {_skeleton_sql('text')} AS skeleton FROM documents WHERE text IS NOT NULL)"

P10_FOUND_ORACLE = f"""
WITH {_SKELETONS}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.skeleton = b.skeleton AND a.doc_id < b.doc_id AND a.text <> b.text
"""

# Members of a class, with the smallest document whose text is its own skeleton (nearly), else the smallest of all.
P10_CLASSES_ORACLE = f"""
WITH {_SKELETONS}, c AS (
  SELECT skeleton, arg_min(doc_id, [(nfc_normalize(text) <> skeleton)::BIGINT, doc_id]) AS canonical_key FROM s GROUP BY skeleton HAVING count(DISTINCT text) > 1)
SELECT doc_id, canonical_key FROM s JOIN c USING (skeleton)
"""
