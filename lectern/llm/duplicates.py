"""Bindings of problem 6 to works_page and evidence_papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, latest
from lectern.llm.neardup import distinct_shingles, distinct_words, near_duplicate_groups, near_duplicate_pairs
from lectern.sources.tables import table

TITLE_SHARE, ABSTRACT_SHARE = 0.7, 0.6
ABSTRACT_RUN = 3


def _works(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works_page").select(F.regexp_extract(bare_id("id"), r"(\d+)$", 1).try_cast("long").alias("record"), "title", "publication_year", "retrieved_at", "row_id")
    return latest(w.filter("record IS NOT NULL"), ["record"], ["retrieved_at", "row_id"], ["title", "publication_year"]).filter("title IS NOT NULL AND publication_year IS NOT NULL")


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_papers").select("paper_key", "abstract", "retrieved_at").filter("paper_key IS NOT NULL")
    return latest(e, ["paper_key"], ["retrieved_at"], ["abstract"]).filter("abstract IS NOT NULL")


def _titles(spark: SparkSession, d: str) -> dict:
    return {"df": _works(spark, d), "key": "record", "tokens": distinct_words("title"), "threshold": TITLE_SHARE, "label": "dup-title", "words": 1, "band": F.col("publication_year")}


def _texts(spark: SparkSession, d: str) -> dict:
    return {"df": _abstracts(spark, d), "key": "paper_key", "tokens": distinct_shingles("abstract", ABSTRACT_RUN), "threshold": ABSTRACT_SHARE, "label": "dup-abstract", "words": 3}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    titles, texts = near_duplicate_pairs(**_titles(spark, d)), near_duplicate_pairs(**_texts(spark, d))
    return titles.select(F.lit("work").alias("record_type"), "id_a", "id_b").unionByName(texts.select(F.lit("abstract").alias("record_type"), "id_a", "id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record in a group: its group (the smallest id of those linked, directly or not) and its links."""
    titles, texts = near_duplicate_groups(**_titles(spark, d)), near_duplicate_groups(**_texts(spark, d))
    return titles.select(F.lit("work").alias("record_type"), F.col("id").alias("record"), "group_id", "n_links").unionByName(texts.select(F.lit("abstract").alias("record_type"), F.col("id").alias("record"), "group_id", "n_links"))


_PAIRS = r"""
w AS (
  SELECT k, list_distinct(regexp_extract_all(lower(regexp_replace(title, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+')) AS t, publication_year AS y
  FROM (SELECT *, TRY_CAST(regexp_extract(id, '(\d+)/*$', 1) AS BIGINT) AS k,
               row_number() OVER (PARTITION BY regexp_extract(id, '([^/]+)/*$', 1) ORDER BY retrieved_at DESC, row_id DESC) AS rn FROM works_page)
  WHERE rn = 1 AND k IS NOT NULL AND title IS NOT NULL AND publication_year IS NOT NULL),
ww AS (SELECT k, y, t, len(t) AS n, unnest(t) AS x FROM w),
wp AS (
  SELECT a.k AS id_a, b.k AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM ww a JOIN ww b ON a.x = b.x AND a.k < b.k AND abs(a.y - b.y) <= 1 GROUP BY ALL),
e0 AS (
  SELECT paper_key AS k, regexp_extract_all(lower(regexp_replace(abstract, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS ws
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY retrieved_at DESC) AS rn FROM evidence_papers)
  WHERE rn = 1 AND abstract IS NOT NULL),
e AS (SELECT k, list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) AS t FROM e0 WHERE len(ws) >= 3),
ee AS (SELECT k, len(t) AS n, unnest(t) AS x FROM e),
ep AS (
  SELECT a.k AS id_a, b.k AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM ee a JOIN ee b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
pairs AS (SELECT 'work' AS record_type, id_a, id_b FROM wp WHERE c / (na + nb - c) >= 0.7
  UNION ALL SELECT 'abstract', id_a, id_b FROM ep WHERE c / (na + nb - c) >= 0.6)
"""

P6_FOUND_ORACLE = f"WITH {_PAIRS} SELECT * FROM pairs"

#: Groups by walking the links from every record.
P6_GROUPS_ORACLE = f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT record_type, id_a AS a, id_b AS b FROM pairs UNION ALL SELECT record_type, id_b, id_a FROM pairs),
r AS (SELECT record_type, a AS record, b AS met FROM l UNION SELECT r.record_type, r.record, l.b FROM r JOIN l ON l.record_type = r.record_type AND l.a = r.met)
SELECT r.record_type, r.record, least(min(r.met), r.record) AS group_id, any_value(n.n) AS n_links FROM r JOIN (SELECT record_type, a, count(*) AS n FROM l GROUP BY ALL) n ON n.record_type = r.record_type AND n.a = r.record
GROUP BY r.record_type, r.record"""
