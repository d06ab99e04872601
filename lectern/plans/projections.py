"""Flat views of nested provider records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, clean
from lectern.operators.project import canonical_ids, content_hash, drop_fields
from lectern.sources.tables import table


def institution_projection(spark, d):
    """Every institution mention of a profile row, flat."""
    a = table(spark, d, "authors_page").select("row_id", F.posexplode("last_known_institutions").alias("pos", "i")).filter("i IS NOT NULL")
    return a.select("row_id", "pos", bare_id("i.id").alias("institution"), clean("i.display_name").alias("name"), "i.country_code", "i.type", F.size(F.coalesce("i.lineage", F.array().cast("array<string>"))).alias("n_lineage"))


def work_projection(spark, d):
    """Flat work rows: ids, year, open access, source, numbers of authors and references."""
    w = table(spark, d, "works_page")
    return w.select("row_id", bare_id("id").alias("work"), "publication_year", "open_access.is_oa", bare_id("primary_location.source.id").alias("source"), F.when(F.col("authorships").isNull(), 0).otherwise(F.size("authorships")).alias("n_authors"), F.when(F.col("referenced_works").isNull(), 0).otherwise(F.size("referenced_works")).alias("n_references"))


def topic_flattening(spark, d):
    """Topics of works with their place and score."""
    w = table(spark, d, "works_page").select("row_id", F.posexplode("topics").alias("pos", "t")).filter("t.id IS NOT NULL")
    return w.select("row_id", "pos", bare_id("t.id").alias("topic"), F.trim("t.display_name").alias("name"), F.round("t.score", 6).alias("score"))


def anonymised_authors(spark, d):
    """Profiles without names and personal ids at any depth; what is left is counted and hashed."""
    a = drop_fields(table(spark, d, "authors_page"), ["display_name", "display_name_alternatives", "orcid", "ids"])
    return canonical_ids(a).select("row_id", F.col("id").alias("author"), F.try_element_at("last_known_institutions", F.lit(1))["id"].alias("institution"), F.size(F.array_distinct(F.coalesce("topics.id", F.array().cast("array<string>")))).alias("n_topics"))


def request_hashes(spark, d):
    """Content hashes of stored pages."""
    return table(spark, d, "raw_pages").select("page_id", content_hash(["endpoint", "payload"]).alias("request_hash"))


def queries():
    return {f.__name__: f for f in (institution_projection, work_projection, topic_flattening, anonymised_authors, request_hashes)}


def oracle_sql():
    b = "nullif(regexp_extract({}, '([^/]+)/*$', 1), '')".format
    return {
        "institution_projection": f"WITH x AS (SELECT row_id, unnest(last_known_institutions) AS i, (generate_subscripts(last_known_institutions, 1) - 1)::INT AS pos FROM authors_page) SELECT row_id, pos, {b('i.id')} AS institution, nullif(trim(i.display_name), '') AS name, i.country_code AS country_code, i.type AS type, coalesce(len(i.lineage), 0)::INT AS n_lineage FROM x WHERE i IS NOT NULL",
        "work_projection": f"SELECT row_id, {b('id')} AS work, publication_year, open_access.is_oa AS is_oa, {b('primary_location.source.id')} AS source, coalesce(len(authorships), 0)::INT AS n_authors, coalesce(len(referenced_works), 0)::INT AS n_references FROM works_page",
        "topic_flattening": f"WITH x AS (SELECT row_id, unnest(topics) AS t, (generate_subscripts(topics, 1) - 1)::INT AS pos FROM works_page) SELECT row_id, pos, {b('t.id')} AS topic, trim(t.display_name) AS name, round(t.score, 6) AS score FROM x WHERE t.id IS NOT NULL",
        "request_hashes": "SELECT page_id, sha256(CASE WHEN endpoint IS NULL THEN json_object('payload', payload) WHEN payload IS NULL THEN json_object('endpoint', endpoint) ELSE json_object('endpoint', endpoint, 'payload', payload) END::VARCHAR) AS request_hash FROM raw_pages",
        "anonymised_authors": f"SELECT row_id, {b('id')} AS author, {b('last_known_institutions[1].id')} AS institution, coalesce(len(list_distinct(list_transform(topics, lambda x: {b('x.id')}))) + (len(list_filter(topics, lambda x: x.id IS NULL)) > 0)::INT, 0)::INT AS n_topics FROM authors_page",
    }
