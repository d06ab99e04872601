"""Percentiles, strata, anonymous ids and first-N limits over candidate_papers, paper_features and professors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, latest
from lectern.functions.rank import cascading_midrank, first_rows, hash_rank_id, midrank, midrank_place, with_midrank, with_previous
from lectern.operators.portfolio import tier
from lectern.sources.tables import table
from lectern.storage import materialize

STRATUM_LEAST = 30


def papers(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each (professor, paper): scores outside 0..100 or NaN are null; field from the id's prefix."""
    c = table(spark, d, "candidate_papers").filter("professor_id IS NOT NULL AND paper_id IS NOT NULL")
    keep = ["publication_year", "citation_count", "complexity_score", "citation_percentile_field_year", "abstract_available", "open_access", "ownership_verified", "topic_ids", "method_tags", "selected", "focal"]
    last = latest(c, ["professor_id", "paper_id"], ["collected_at", "ingested_at", "row_id"], keep)
    s = F.col("complexity_score")
    return last.withColumns({"complexity_score": F.when(s.between(0, 100) & ~F.isnan(s), s), "field": F.split("professor_id", "-")[0]})


def midrank_percentile(spark, d):
    """Percentile of each score among all papers of a field; ties share the middle rank."""
    out = midrank(papers(spark, d), ["field"], "complexity_score")
    return out.select("field", "complexity_score", F.round("percentile", 9).alias("percentile"), "stratum_size")


def strata_cascade(spark, d):
    """Percentile within the first stratum with enough scored members: field and year, domain and year, year, all.

    A paper's domain is that of its first topic: the topic's id without its last three digits."""
    topic = F.split(F.coalesce("topic_ids", F.lit("")), r"\|")[0]
    domain = F.when(topic.rlike(r"^T\d{4,}$"), F.expr("left(split(topic_ids, '[|]')[0], length(split(topic_ids, '[|]')[0]) - 3)"))
    p = papers(spark, d).select("professor_id", "paper_id", "field", "publication_year", domain.alias("domain"), "complexity_score")
    levels = [("field_year", ["field", "publication_year"]), ("domain_year", ["domain", "publication_year"]), ("year", ["publication_year"]), ("global", [])]
    out = cascading_midrank(materialize(p, "strata"), levels, "complexity_score", STRATUM_LEAST)
    return out.select("professor_id", "paper_id", "stratum", F.round("percentile", 9).alias("percentile"))


def popularity_percentiles(spark, d):
    """Percentile of citations among papers of the same year and field, and of the same year."""
    p = papers(spark, d).filter("citation_count >= 0 AND publication_year IS NOT NULL").select("professor_id", "paper_id", "field", "publication_year", "citation_count")
    p = materialize(p, "popularity")
    out = with_midrank(with_midrank(p, ["field", "publication_year"], "citation_count", "a"), ["publication_year"], "citation_count", "b")
    return out.select("professor_id", "paper_id", F.round("a", 9).alias("field_year_percentile"), F.round("b", 9).alias("year_percentile"))


# Weights of the complexity score.
WEIGHTS = {"technical_vocabulary_density": 0.30, "method_count": 0.25, "dataset_or_population_count": 0.15, "result_or_experiment_count": 0.20, "readability_difficulty": 0.10}


def complexity_score(spark, d):
    """Weighted percentiles of a paper's features; null where one of them is."""
    f = table(spark, d, "paper_features").select("paper_key", *WEIGHTS).filter("paper_key IS NOT NULL")
    out = materialize(f, "features")
    for c in WEIGHTS:
        out = with_midrank(out, [], c, f"p_{c}")
    total = sum((F.col(f"p_{c}") * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return out.select("paper_key", F.round(total, 9).alias("score"))


def tiers(spark, d):
    """Papers by tier of their percentile among all papers."""
    p = papers(spark, d).select("professor_id", "paper_id", "complexity_score")
    ranked = with_midrank(materialize(p, "tiers"), [], "complexity_score", "x")
    return ranked.groupBy(tier("x", 30, 70).alias("tier")).agg(F.count("*").alias("n_papers"))


def hash_rank_ids(spark, d):
    """Anonymous ids of professors: rank of a salted hash within the field's prefix."""
    p = table(spark, d, "professors").filter("professor_id IS NOT NULL").select("professor_id", F.split("professor_id", "-")[0].alias("prefix")).distinct()
    return hash_rank_id(p, "prefix", "professor_id", "ids-v1").select("professor_id", "anonymous_id")


def first_n_profiles(spark, d):
    """All paper rows of the twenty professors seen first (by row id)."""
    c = table(spark, d, "candidate_papers").filter("professor_id IS NOT NULL").select("row_id", "professor_id")
    first = c.groupBy("professor_id").agg(F.min("row_id").alias("seen")).orderBy("seen").limit(20)
    return c.join(F.broadcast(first.select("professor_id")), "professor_id").groupBy("professor_id").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))  # 20 rows


def recency_ranking(spark, d):
    """The five newest papers of each professor, ties to the smaller id, unknown years last."""
    p = papers(spark, d).select("professor_id", "paper_id", F.coalesce("publication_year", F.lit(-1)).alias("y"))
    return first_rows(p, ["professor_id"], [F.desc("y"), F.col("paper_id")], 5).select("professor_id", "paper_id", "place")


def influence_ranking(spark, d):
    p = papers(spark, d).select("professor_id", "paper_id", F.coalesce(F.when(~F.isnan("citation_percentile_field_year"), F.col("citation_percentile_field_year")), F.lit(-1.0)).alias("x"))
    return first_rows(p, ["professor_id"], [F.desc("x"), F.col("paper_id")], 5).select("professor_id", "paper_id", "place")


def ordinal_ids(spark, d):
    """Emails numbered in order, E-0001 on, by all tasks together."""
    e = table(spark, d, "claims_to_label").filter("email_id IS NOT NULL").select("email_id").distinct()
    return midrank_place(e, [], ["email_id"]).select("email_id", F.format_string("E-%04d", "place").alias("ordinal_id"))


def first_claims_per_professor(spark, d):
    c = table(spark, d, "claims_to_label").filter("professor_id IS NOT NULL AND claim_id IS NOT NULL").select("professor_id", "claim_id").distinct()
    return first_rows(c, ["professor_id"], [F.col("claim_id")], 3).select("professor_id", "claim_id", "place")


def year_gaps(spark, d):
    """Years between consecutive papers of a professor: mean gap, in order of year and id."""
    p = papers(spark, d).filter("publication_year IS NOT NULL").select("professor_id", "publication_year", "paper_id")
    gaps = with_previous(p, ["professor_id"], ["publication_year", "paper_id"], ["publication_year"])
    return gaps.groupBy("professor_id").agg(F.count("prev_publication_year").alias("n_gaps"), F.round(F.avg(F.col("publication_year") - F.col("prev_publication_year")), 9).alias("mean_gap"))


def lineitem_price_percentile(spark, d):
    """The same percentile over another table: prices of parts within their brand."""
    out = midrank(table(spark, d, "part"), ["p_brand"], "p_retailprice")
    return out.select("p_brand", "p_retailprice", F.round("percentile", 9).alias("percentile"))


PAPERS_SQL = """
pp AS (
  SELECT * EXCLUDE (rn, complexity_score), CASE WHEN complexity_score BETWEEN 0 AND 100 AND NOT isnan(complexity_score) THEN complexity_score END AS complexity_score, split_part(professor_id, '-', 1) AS field
  FROM (SELECT *, row_number() OVER (PARTITION BY professor_id, paper_id ORDER BY collected_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn
        FROM candidate_papers WHERE professor_id IS NOT NULL AND paper_id IS NOT NULL) WHERE rn = 1)
"""


def _pct(part: str, v: str, where: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    comma = f"{part}, {v}" if part else v
    return f"(rank() OVER ({over}ORDER BY {v}) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY {comma})) * 100.0::DOUBLE / count(*) OVER ({over})"


def queries():
    names = [
        midrank_percentile, strata_cascade, popularity_percentiles, complexity_score, tiers, hash_rank_ids, first_n_profiles, recency_ranking, influence_ranking, ordinal_ids,
        first_claims_per_professor, year_gaps, lineitem_price_percentile,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    scored = "sc AS (SELECT * FROM pp WHERE complexity_score IS NOT NULL)"
    feats = ", ".join(f"f_{c} AS (SELECT paper_key, {_pct('', c)} AS x FROM paper_features WHERE {c} IS NOT NULL AND NOT isnan({c}::DOUBLE) AND paper_key IS NOT NULL)" for c in WEIGHTS)
    return {
        "midrank_percentile": f"WITH {PAPERS_SQL}, {scored}, r AS (SELECT field, complexity_score, {_pct('field', 'complexity_score')} AS p, count(*) OVER (PARTITION BY field) AS n FROM sc) SELECT DISTINCT field, complexity_score, round(p, 9) AS percentile, n AS stratum_size FROM r",
        "strata_cascade": f"""WITH {PAPERS_SQL}, dp AS (
              SELECT *, CASE WHEN regexp_matches(string_split(topic_ids, '|')[1], '^T\\d{{4,}}$') THEN left(string_split(topic_ids, '|')[1], length(string_split(topic_ids, '|')[1]) - 3) END AS domain FROM pp),
            r AS (SELECT professor_id, paper_id, {_pct('field, publication_year', 'complexity_score')} AS a, {_pct('domain, publication_year', 'complexity_score')} AS a2,
              {_pct('publication_year', 'complexity_score')} AS b, {_pct('', 'complexity_score')} AS c FROM dp WHERE complexity_score IS NOT NULL),
            n AS (SELECT *, CASE WHEN publication_year IS NOT NULL THEN count(complexity_score) OVER (PARTITION BY field, publication_year) ELSE 0 END AS nf,
              CASE WHEN publication_year IS NOT NULL AND domain IS NOT NULL THEN count(complexity_score) OVER (PARTITION BY domain, publication_year) ELSE 0 END AS nd,
              CASE WHEN publication_year IS NOT NULL THEN count(complexity_score) OVER (PARTITION BY publication_year) ELSE 0 END AS ny FROM dp),
            s AS (SELECT professor_id, paper_id, CASE WHEN nf >= {STRATUM_LEAST} THEN 'field_year' WHEN nd >= {STRATUM_LEAST} THEN 'domain_year' WHEN ny >= {STRATUM_LEAST} THEN 'year' ELSE 'global' END AS stratum FROM n)
            SELECT professor_id, paper_id, stratum, round(CASE stratum WHEN 'field_year' THEN a WHEN 'domain_year' THEN a2 WHEN 'year' THEN b ELSE c END, 9) AS percentile FROM s LEFT JOIN r USING (professor_id, paper_id)""",
        "popularity_percentiles": f"WITH {PAPERS_SQL}, c AS (SELECT * FROM pp WHERE citation_count >= 0 AND publication_year IS NOT NULL) SELECT professor_id, paper_id, round({_pct('field, publication_year', 'citation_count')}, 9) AS field_year_percentile, round({_pct('publication_year', 'citation_count')}, 9) AS year_percentile FROM c",
        "complexity_score": f"WITH {feats} SELECT p.paper_key, round(" + " + ".join(f"f_{c}.x * {w}::DOUBLE" for c, w in WEIGHTS.items()) + ", 9) AS score FROM (SELECT paper_key FROM paper_features WHERE paper_key IS NOT NULL) p " + " ".join(f"LEFT JOIN f_{c} ON p.paper_key = f_{c}.paper_key" for c in WEIGHTS),
        "tiers": f"WITH {PAPERS_SQL}, {scored}, r AS (SELECT professor_id, paper_id, {_pct('', 'complexity_score')} AS x FROM sc) SELECT CASE WHEN x IS NULL THEN NULL WHEN x < 30 THEN 'low' WHEN x < 70 THEN 'medium' ELSE 'high' END AS tier, count(*) AS n_papers FROM pp LEFT JOIN r USING (professor_id, paper_id) GROUP BY tier",
        "hash_rank_ids": "WITH p AS (SELECT DISTINCT professor_id, split_part(professor_id, '-', 1) AS prefix FROM professors WHERE professor_id IS NOT NULL) SELECT professor_id, format('{}-{:03d}', prefix, row_number() OVER (PARTITION BY prefix ORDER BY sha256('ids-v1' || chr(0) || professor_id), professor_id)) AS anonymous_id FROM p",
        "first_n_profiles": "WITH f AS (SELECT professor_id, min(row_id) AS first_row, count(*) AS n_rows FROM candidate_papers WHERE professor_id IS NOT NULL GROUP BY ALL ORDER BY first_row LIMIT 20) SELECT professor_id, n_rows, first_row FROM f",
        "recency_ranking": f"WITH {PAPERS_SQL}, r AS (SELECT professor_id, paper_id, row_number() OVER (PARTITION BY professor_id ORDER BY coalesce(publication_year, -1) DESC, paper_id)::INT AS place FROM pp) SELECT * FROM r WHERE place <= 5",
        "influence_ranking": f"WITH {PAPERS_SQL}, r AS (SELECT professor_id, paper_id, row_number() OVER (PARTITION BY professor_id ORDER BY coalesce(CASE WHEN NOT isnan(citation_percentile_field_year) THEN citation_percentile_field_year END, -1) DESC, paper_id)::INT AS place FROM pp) SELECT * FROM r WHERE place <= 5",
        "ordinal_ids": "WITH e AS (SELECT DISTINCT email_id FROM claims_to_label WHERE email_id IS NOT NULL) SELECT email_id, format('E-{:04d}', row_number() OVER (ORDER BY email_id)) AS ordinal_id FROM e",
        "first_claims_per_professor": "WITH c AS (SELECT DISTINCT professor_id, claim_id FROM claims_to_label WHERE professor_id IS NOT NULL AND claim_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY professor_id ORDER BY claim_id)::INT AS place FROM c) SELECT * FROM r WHERE place <= 3",
        "year_gaps": f"WITH {PAPERS_SQL}, g AS (SELECT professor_id, publication_year - lag(publication_year) OVER (PARTITION BY professor_id ORDER BY publication_year, paper_id) AS g FROM pp WHERE publication_year IS NOT NULL) SELECT professor_id, count(g) AS n_gaps, round(avg(g), 9) AS mean_gap FROM g GROUP BY professor_id",
        "lineitem_price_percentile": f"WITH r AS (SELECT p_brand, p_retailprice, {_pct('p_brand', 'p_retailprice')} AS p FROM part WHERE p_retailprice IS NOT NULL) SELECT DISTINCT p_brand, p_retailprice, round(p, 9) AS percentile FROM r",
    }
