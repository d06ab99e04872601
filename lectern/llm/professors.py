"""Bindings of problem 1 to professors and sample_targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import latest, squeeze
from lectern.llm.sampling import sample_report, sample_to_targets
from lectern.sources.tables import table

POOL, DIMENSIONS = "candidate_pool_version", ["career_stage", "visibility_band"]


def career_stage(c: str) -> Column:
    """Free spellings to assistant, associate, full; anything else is null."""
    s = squeeze(c)
    return F.when(s.startswith("assoc"), "associate").when(s.startswith("assist") | s.startswith("asst"), "assistant").when(s.contains("full"), "full")


def visibility_band(c: str) -> Column:
    s = squeeze(c)
    return F.when(s.startswith("low"), "low").when(s.startswith("med"), "medium").when(s.startswith("high"), "high")


def professors(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each professor with spellings normalised."""
    rows = table(spark, d, "professors").filter("professor_id IS NOT NULL")
    last = latest(rows, ["professor_id"], ["updated_at", "row_id"], [POOL, *DIMENSIONS])
    return last.withColumns({"career_stage": career_stage("career_stage"), "visibility_band": visibility_band("visibility_band")})


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample_to_targets(professors(spark, d), table(spark, d, "sample_targets"), "professor_id", POOL, DIMENSIONS)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target beside what the drawn sample holds."""
    p = professors(spark, d)
    targets = table(spark, d, "sample_targets")
    return sample_report(p, sample_to_targets(p, targets, "professor_id", POOL, DIMENSIONS), targets, POOL, DIMENSIONS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the sample misses because their pool has too few professors of the category."""
    return p1_report(spark, d).filter("reason = 'too_few'").select(POOL, "dimension", "category")


_PROFESSORS = """
p AS (
  SELECT candidate_pool_version,
    CASE WHEN s LIKE 'assoc%' THEN 'associate' WHEN s LIKE 'assist%' OR s LIKE 'asst%' THEN 'assistant' WHEN s LIKE '%full%' THEN 'full' END AS career_stage,
    CASE WHEN b LIKE 'low%' THEN 'low' WHEN b LIKE 'med%' THEN 'medium' WHEN b LIKE 'high%' THEN 'high' END AS visibility_band
  FROM (
    SELECT *, regexp_replace(lower(career_stage), '[^a-z]', '', 'g') AS s, regexp_replace(lower(visibility_band), '[^a-z]', '', 'g') AS b,
           row_number() OVER (PARTITION BY professor_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS rn
    FROM professors WHERE professor_id IS NOT NULL) WHERE rn = 1)
"""

P1_FOUND_ORACLE = f"""
WITH {_PROFESSORS}, c AS (
  SELECT candidate_pool_version, 'career_stage' AS dimension, career_stage AS category, count(*) AS n FROM p GROUP BY ALL
  UNION ALL SELECT candidate_pool_version, 'visibility_band', visibility_band, count(*) FROM p GROUP BY ALL)
SELECT t.candidate_pool_version, t.dimension, t.category
FROM sample_targets t LEFT JOIN c USING (candidate_pool_version, dimension, category)
WHERE coalesce(c.n, 0) < t.target_count
"""
