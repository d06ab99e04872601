"""Bindings of problem 4 to evidence_papers and paper_features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import clean, latest
from lectern.llm import readability as R
from lectern.sources.tables import table
from lectern.storage import materialize

LIMIT_GRADE = 8.0


def graded(spark: SparkSession, d: str) -> DataFrame:
    """(paper_key, features, grade by the formula, given grade) of all abstracts."""
    papers = table(spark, d, "evidence_papers").select("paper_key", "retrieved_at", clean("abstract").alias("abstract"))
    papers = latest(papers.filter("paper_key IS NOT NULL"), ["paper_key"], ["retrieved_at"], ["abstract"]).filter("abstract IS NOT NULL")
    given = table(spark, d, "paper_features").groupBy("paper_key").agg(F.max("readability_difficulty").alias("given_grade"))
    shaped = materialize(R.text_shape(papers, "abstract").drop("abstract").join(given, "paper_key", "left"), "abstract-words")
    familiar = R.familiar_words(shaped, "given_grade")
    features = R.formula_features(shaped, familiar, ["paper_key", "given_grade"])
    coefficients, _ = R.fit_formula(features, "given_grade", "paper_key")
    return features.withColumn("grade", R.formula_grade(coefficients))


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """A school grade for every abstract, with the features it comes from and the given grade beside it."""
    return graded(spark, d).select("paper_key", "n_words", "unfamiliar", "sentence_length", "grade", "given_grade")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts by whole school grade."""
    return p4_levels(spark, d).groupBy(F.floor("grade").cast("int").alias("school_grade")).agg(F.count("*").alias("n_abstracts"), F.avg("unfamiliar").alias("mean_unfamiliar"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts that the formula puts at grade 8 or lower."""
    return graded(spark, d).filter(F.col("grade") <= LIMIT_GRADE).select("paper_key")
