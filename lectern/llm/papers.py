"""Bindings of problem 7 to candidate_papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import latest
from lectern.llm.topn import top_n_per_group
from lectern.sources.tables import table

PAPERS_PER_PROFESSOR = 8


def scored_papers(spark: SparkSession, d: str) -> DataFrame:
    """One row per (professor, paper): the score of the row collected last, where it is one."""
    rows = table(spark, d, "candidate_papers").select("professor_id", "paper_id", "complexity_score", "collected_at", "ingested_at", "row_id")
    rows = rows.filter(F.col("professor_id").isNotNull() & F.col("paper_id").isNotNull())
    last = latest(rows, ["professor_id", "paper_id"], ["collected_at", "ingested_at", "row_id"], ["complexity_score"])
    s = F.col("complexity_score")
    return last.filter(s.isNotNull() & ~F.isnan(s) & s.between(0, 100))


def p7_selected(spark: SparkSession, d: str) -> DataFrame:
    """The selected papers with their scores."""
    return top_n_per_group(scored_papers(spark, d), "professor_id", "complexity_score", "paper_id", PAPERS_PER_PROFESSOR)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_selected(spark, d).select("professor_id", "paper_id")


P7_ORACLE = """
WITH latest AS (
  SELECT professor_id, paper_id, complexity_score,
         row_number() OVER (PARTITION BY professor_id, paper_id
                            ORDER BY collected_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn
  FROM candidate_papers WHERE professor_id IS NOT NULL AND paper_id IS NOT NULL),
ranked AS (
  SELECT professor_id, paper_id, complexity_score,
         row_number() OVER (PARTITION BY professor_id ORDER BY complexity_score DESC, paper_id) AS rk
  FROM latest
  WHERE rn = 1 AND complexity_score IS NOT NULL AND NOT isnan(complexity_score) AND complexity_score BETWEEN 0 AND 100)
SELECT {columns} FROM ranked WHERE rk <= 8
"""
