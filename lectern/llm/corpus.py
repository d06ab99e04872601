"""Bindings of problems 8 and 9 to documents, pack_settings and mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import slug
from lectern.llm.mixing import language, marginal_report, mix, mix_report, topic
from lectern.llm.packing import pack
from lectern.llm.tokens import VOCABULARY, measured
from lectern.sources.tables import table
from lectern.storage import materialize


def p8_packing(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's pieces with their containers."""
    capacity = table(spark, d, "pack_settings").agg(F.max("capacity_tokens")).first()[0]
    return pack(measured(table(spark, d, "documents"), "text", ["doc_id"], vocabulary), "doc_id", int(capacity))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: their number, tokens, and the share of space left."""
    capacity = table(spark, d, "pack_settings").agg(F.max("capacity_tokens").cast("double").alias("capacity"))
    each = p8_packing(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"))
    total = each.agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("fullest"))
    return total.crossJoin(F.broadcast(capacity)).withColumn("space_left", 1 - F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("capacity")))  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return p8_packing(spark, d).filter((F.col("pieces") > 1) & (F.col("piece") == 1)).select("doc_id")


def _mixed(spark: SparkSession, d: str, total: str = "corpus"):
    docs = table(spark, d, "documents").select("doc_id", "text", slug("source").alias("source"), language("lang").alias("lang"))
    sized = measured(docs, "text", ["doc_id", "source", "lang"]).withColumn("topic", topic()).select("doc_id", "source", "lang", "topic", "n_tokens")
    targets = table(spark, d, "mix_targets").filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas()
    return mix(materialize(sized, "mix-sizes"), targets, "doc_id", total=total)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the mix with the number of their copies."""
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(*_mixed(spark, d))


def p9_met_report(spark: SparkSession, d: str) -> DataFrame:
    """The same for a mix only as large as lets every source with documents give its share."""
    return mix_report(*_mixed(spark, d, "met"))


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of sources, languages and topics, and how far raking settled."""
    return marginal_report(*_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the drawn mix holds every copy allowed and still less than their share."""
    return p9_report(spark, d).filter("is_short").select("source")
