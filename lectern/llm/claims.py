"""Bindings of problem 3 to claims_to_label and claim_labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import as_column, clean, squeeze
from lectern.llm.consensus import annotator_reliability, consensus
from lectern.sources.tables import table
from lectern.storage import materialize

# The labels of a claim.
LABELS = ("supported", "partially_supported", "overstated", "unsupported", "contradicted", "outside_evidence_scope", "subjective_or_generic")


def label(c: Column | str) -> Column:
    """A free spelling to its label, letters only (a slash read as "or") and with at most one typing error; else null."""
    s = squeeze(F.replace(as_column(c), F.lit("/"), F.lit("or")))
    return F.coalesce(
        *[F.when(s == name.replace("_", ""), name) for name in LABELS],
        *[F.when(F.levenshtein(s, F.lit(name.replace("_", ""))) <= 1, name) for name in LABELS],
    )


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(item, annotator, label): the last label of each annotator for each claim, where it is one.

    Labels in claims_to_label have no time and count as older than those in claim_labels.
    """
    sheet, more = table(spark, d, "claims_to_label"), table(spark, d, "claim_labels")
    parts = [sheet.select(F.col("claim_id").alias("item"), clean(f"annotator_{i}").alias("annotator"), F.col(f"label_annotator_{i}").alias("raw"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("row_id").alias("n")) for i in (1, 2)]
    parts.append(more.select(F.col("claim_id").alias("item"), clean("annotator_id").alias("annotator"), F.col("label").alias("raw"), F.col("labelled_at").cast("timestamp_ntz").alias("at"), F.col("label_id").alias("n")))
    rows = reduce(DataFrame.unionByName, parts).withColumn("label", label("raw")).filter("item IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL")
    last = rows.groupBy("item", "annotator").agg(F.max(F.struct(F.col("at").isNotNull(), "at", "n", "label")).alias("x"))
    return last.select("item", "annotator", F.col("x.label").alias("label"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = materialize(votes(spark, d), "claim-votes")
    return v, materialize(annotator_reliability(v, len(LABELS)), "claim-annotators")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[1]


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with its label; an adjudicated label is kept, a claim without any vote gets the commonest label."""
    v, reliability = _parts(spark, d)
    voted = consensus(v, reliability, len(LABELS)).withColumnRenamed("item", "claim_id")
    sheet = table(spark, d, "claims_to_label")
    known = sheet.select("claim_id", label("final_label").alias("final"), "row_id").filter("claim_id IS NOT NULL")
    known = known.unionByName(table(spark, d, "claim_labels").select("claim_id").filter("claim_id IS NOT NULL"), allowMissingColumns=True)
    settled = known.groupBy("claim_id").agg(F.max_by("final", F.when(F.col("final").isNotNull(), F.col("row_id"))).alias("final"))
    commonest = v.groupBy("label").count().agg(F.max_by("label", F.struct("count", "label")).alias("commonest"))
    out = settled.join(voted, "claim_id", "left").crossJoin(F.broadcast(commonest))  # one row
    return out.select("claim_id", F.coalesce("final", "label", "commonest", F.lit(LABELS[0])).alias("label"), F.col("final").isNotNull().alias("adjudicated"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "agreement", "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_consensus(spark, d).select("claim_id", "label")
