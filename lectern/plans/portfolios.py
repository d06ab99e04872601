"""Portfolio measures: papers of a professor in candidate_papers, works of an author in works_page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, latest
from lectern.functions.rank import midrank_place, with_previous
from lectern.operators import portfolio as P
from lectern.plans.ranking import PAPERS_SQL, papers
from lectern.sources.tables import table
from lectern.storage import materialize


def _exploded(p: DataFrame, cell: str, name: str) -> DataFrame:
    x = p.select("professor_id", "paper_id", F.explode(F.split(F.coalesce(cell, F.lit("")), r"\|")).alias(name))
    return x.withColumn(name, F.trim(name)).filter(F.col(name) != "")


def topic_entropy(spark, d):
    t = _exploded(papers(spark, d), "topic_ids", "topic").groupBy("professor_id", "topic").agg(F.count("*").alias("n"))
    return P.normalized_entropy(t, ["professor_id"], "n", "entropy").select("professor_id", F.round("entropy", 9).alias("entropy"), F.col("entropy_classes").alias("n_topics"))


def method_diversity(spark, d):
    """Half entropy of methods, half their number out of twenty."""
    m = _exploded(papers(spark, d), "method_tags", "method").groupBy("professor_id", "method").agg(F.count("*").alias("n"))
    e = P.normalized_entropy(m, ["professor_id"], "n", "entropy")
    value = P.weighted_available_mean({"entropy": ("entropy", 0.5), "unique": (P.normalized_unique("entropy_classes", 20.0), 0.5)})
    return e.select("professor_id", F.round(value["value"], 9).alias("diversity"), F.col("entropy_classes").alias("n_methods"))


def research_breadth(spark, d):
    """Weighted mean of what is known of topic entropy, number of topics, methods, years and papers."""
    p = materialize(papers(spark, d), "breadth")
    t = P.normalized_entropy(_exploded(p, "topic_ids", "topic").groupBy("professor_id", "topic").agg(F.count("*").alias("n")), ["professor_id"], "n", "te")
    m = P.normalized_entropy(_exploded(p, "method_tags", "method").groupBy("professor_id", "method").agg(F.count("*").alias("n")), ["professor_id"], "n", "me")
    base = p.groupBy("professor_id").agg(F.count("*").alias("n"), F.countDistinct("publication_year").alias("years"))
    j = base.join(t, "professor_id", "left").join(m, "professor_id", "left")
    v = P.weighted_available_mean({
        "topic_entropy": ("te", 0.35), "topics": (P.normalized_count("te_classes", "n"), 0.25), "method_entropy": ("me", 0.20),
        "methods": (P.normalized_unique("me_classes", 20.0), 0.10), "years": (P.normalized_count("years", "n"), 0.10),
    })
    return j.select("professor_id", F.round(v["value"], 9).alias("breadth"), F.round(v["denominator"], 9).alias("denominator"), F.array_join(v["missing"], ",").alias("missing"))


def _topic_levels(p: DataFrame) -> DataFrame:
    """A paper's first topic and its coarser groups: the id without its last one, two and three digits."""
    t = F.split(F.coalesce("topic_ids", F.lit("")), r"\|")[0]
    t = F.when(t.rlike(r"^T\d{4,}$"), t)
    return p.select("professor_id", "paper_id", "publication_year", t.alias("topic")).withColumns({"subfield": F.expr("left(topic, length(topic) - 1)"), "field": F.expr("left(topic, length(topic) - 2)"), "domain": F.expr("left(topic, length(topic) - 3)")})


LEVELS = [("topic", 1.0), ("subfield", 0.85), ("field", 0.70), ("domain", 0.60)]


def pairwise_coherence(spark, d):
    """Mean topic similarity of all pairs of a professor's papers, without forming a pair."""
    c = _topic_levels(papers(spark, d)).filter("topic IS NOT NULL").groupBy("professor_id", *[x for x, _ in LEVELS]).agg(F.count("*").alias("n"))
    return P.pair_similarity(c, ["professor_id"], LEVELS, "n", "coherence").select("professor_id", "n_pairs", F.round("coherence", 9).alias("coherence"))


def temporal_evolution(spark, d):
    """Mean topic distance between consecutive papers, by year and id; null for fewer than two papers or one year."""
    p = _topic_levels(papers(spark, d)).filter("topic IS NOT NULL AND publication_year IS NOT NULL")
    x = with_previous(p, ["professor_id"], ["publication_year", "paper_id"], [c for c, _ in LEVELS])
    s = P.ladder([(F.col(c), F.col(f"prev_{c}"), w) for c, w in LEVELS])
    out = x.groupBy("professor_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("prev_topic").isNotNull(), 1 - s)).alias("m"), F.countDistinct("publication_year").alias("years"))
    return out.select("professor_id", F.round(F.when((F.col("n") >= 2) & (F.col("years") >= 2), F.col("m")), 9).alias("evolution"))


def temporal_distribution(spark, d):
    return papers(spark, d).groupBy("professor_id").agg(
        F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), (F.max("publication_year") - F.min("publication_year")).alias("span"),
        F.countDistinct("publication_year").alias("n_years"), F.count_if(F.col("publication_year").isNull()).alias("n_missing"),
    )


def complexity_distribution(spark, d):
    """Mean, median, lowest, highest and missing scores of each professor.

    The median comes from places that all tasks count together, so a professor of very many papers is in no one task."""
    p = materialize(papers(spark, d).select("professor_id", "paper_id", "complexity_score"), "distribution")
    c = F.col("complexity_score")
    base = p.groupBy("professor_id").agg(F.round(F.avg(c), 9).alias("mean"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.count_if(c.isNull()).alias("n_missing"), F.count(c).alias("n"))
    placed = midrank_place(p.filter(c.isNotNull()), ["professor_id"], ["complexity_score", "paper_id"]).join(base.select("professor_id", "n"), "professor_id")
    middle = placed.filter(F.col("place").between(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))
    median = middle.groupBy("professor_id").agg(F.round(F.avg(c), 9).alias("median"))
    return base.join(median, "professor_id", "left").select("professor_id", "mean", "median", "lowest", "highest", "n_missing")


def oa_rate(spark, d):
    """Share of open papers among those with an observation; unknown ones counted apart."""
    o = F.col("open_access")
    return papers(spark, d).groupBy("professor_id").agg(F.round(F.avg(o.cast("int")), 9).alias("oa_rate"), F.count_if(o.isNull()).alias("n_unknown"))


def oa_status_counts(spark, d):
    """Works by open-access status; a status that contradicts the flag counts as missing."""
    w = table(spark, d, "works_page").select("open_access.is_oa", "open_access.oa_status")
    s = F.when((F.col("is_oa") & (F.col("oa_status") == "closed")) | (~F.col("is_oa") & (F.col("oa_status") != "closed")), None).otherwise(F.col("oa_status"))
    return w.groupBy(s.alias("oa_status")).agg(F.count("*").alias("n_works"))


def evidence_completeness(spark, d):
    """Mean of five rates: known topic, method, year, score, and an abstract."""
    b = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    rates = [b(F.trim("topic_ids") != ""), b(F.trim("method_tags") != ""), b(F.col("publication_year").isNotNull()), b(F.col("complexity_score").isNotNull()), b(F.col("abstract_available"))]
    return papers(spark, d).groupBy("professor_id").agg(F.round(sum(rates[1:], rates[0]) / 5, 9).alias("completeness"))


def visibility(spark, d):
    """Mean citation percentile over 100."""
    x = F.col("citation_percentile_field_year")
    return papers(spark, d).groupBy("professor_id").agg(F.round(F.avg(F.when(~F.isnan(x) & x.between(0, 100), x)) / 100, 9).alias("visibility"))


def synthesis_difficulty(spark, d):
    """Weighted mean of entropy, incoherence, mean score and evolution as far as known, and its tier."""
    e, c, v, m = topic_entropy(spark, d), pairwise_coherence(spark, d), temporal_evolution(spark, d), complexity_distribution(spark, d)
    j = m.join(e, "professor_id", "left").join(c, "professor_id", "left").join(v, "professor_id", "left")
    x = P.weighted_available_mean({"entropy": ("entropy", 0.3), "incoherence": (1 - F.col("coherence"), 0.3), "complexity": (F.col("mean") / 100, 0.2), "evolution": ("evolution", 0.2)})["value"]
    return j.select("professor_id", F.round(x, 7).alias("difficulty"), P.tier(F.round(x, 7), 0.33, 0.67).alias("tier"))


def collaboration(spark, d):
    """Per author: works, mean number of authors, different co-authors, share of works with several institutions.

    Co-author counts are distinct pairs, found by a join of a work's authors with each other (as many as a work has).
    """
    w = table(spark, d, "works_page").select(bare_id("id").alias("work"), "retrieved_at", "row_id", F.transform("authorships", lambda x: F.struct(bare_id(x["author"]["id"]).alias("a"), F.filter(F.transform(x["institutions"], lambda i: bare_id(i["id"])), lambda i: i.isNotNull()).alias("i"))).alias("au"))
    w = latest(w.filter("work IS NOT NULL"), ["work"], ["retrieved_at", "row_id"], ["au"])
    w = w.select("work", F.array_distinct(F.filter(F.transform("au", lambda x: x["a"]), lambda a: a.isNotNull())).alias("authors"), F.size(F.array_distinct(F.flatten(F.filter(F.transform("au", lambda x: x["i"]), lambda i: i.isNotNull())))).alias("n_inst"))
    each = w.filter(F.size("authors") > 0).select("work", F.explode("authors").alias("author"), "authors", F.size("authors").alias("n"), "n_inst")
    base = each.groupBy("author").agg(F.count("*").alias("n_works"), F.round(F.avg("n"), 9).alias("mean_authors"), F.round(F.avg((F.col("n_inst") > 1).cast("int")), 9).alias("multi_institution_rate"))
    partners = each.select("author", F.explode("authors").alias("other")).filter("author <> other").distinct().groupBy("author").agg(F.count("*").alias("n_coauthors"))
    return base.join(partners, "author", "left").fillna(0, ["n_coauthors"])


def topic_clusters(spark, d):
    """Topics of all author profiles: label (the smallest of its names), number of profiles, mean score."""
    a = table(spark, d, "authors_page").select(bare_id("id").alias("author"), F.explode("topics").alias("t"))
    t = a.select("author", bare_id("t.id").alias("topic"), "t.display_name", "t.score").filter("topic IS NOT NULL AND author IS NOT NULL")
    return t.groupBy("topic").agg(F.min_by("display_name", F.struct(F.lower("display_name"), "display_name")).alias("label"), F.countDistinct("author").alias("n_authors"), F.round(F.avg("score"), 6).alias("mean_score"))


def coverage_potential(spark, d):
    """Per paper: sum of 1 / document frequency of its tokens within the professor's papers, over the largest such sum."""
    p = materialize(papers(spark, d).select("professor_id", "paper_id", "topic_ids"), "coverage")
    t = _exploded(p, "topic_ids", "topic").distinct()
    df = t.groupBy("professor_id", "topic").agg((1.0 / F.count("*")).alias("w"))
    s = t.join(df, ["professor_id", "topic"]).groupBy("professor_id", "paper_id").agg(F.sum("w").alias("s"))
    top = s.groupBy("professor_id").agg(F.max("s").alias("most"))
    return s.join(top, "professor_id").select("professor_id", "paper_id", F.round(F.col("s") / F.col("most"), 9).alias("potential"))


def embedding_spread(spark, d):
    """Mean pairwise cosine similarity of the vectors of each label, from the norm of their sum: no pair is formed."""
    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    norms = e.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("norm"))
    unit = e.join(norms.filter("norm > 0"), "vec_id").select("label", "vec_id", "i", (F.col("x").cast("double") / F.col("norm")).alias("u"))
    sums = unit.groupBy("label", "i").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return out.select("label", F.col("n").alias("n_vectors"), F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


_T = r"tp AS (SELECT professor_id, paper_id, trim(unnest(string_split(topic_ids, '|'))) AS topic FROM pp)"
_ENT = "SELECT professor_id, CASE WHEN count(*) = 1 THEN 0 ELSE -sum(n / t * log2(n / t)) / log2(count(*)) END AS e, count(*) AS k FROM (SELECT professor_id, {c}, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY professor_id)::DOUBLE AS t FROM {f} WHERE {c} <> '' GROUP BY professor_id, {c}) GROUP BY professor_id"
_LV = r"lv AS (SELECT professor_id, paper_id, publication_year, topic, left(topic, length(topic) - 1) AS subfield, left(topic, length(topic) - 2) AS field, left(topic, length(topic) - 3) AS domain FROM (SELECT professor_id, paper_id, publication_year, CASE WHEN regexp_matches(string_split(topic_ids, '|')[1], '^T\d{4,}$') THEN string_split(topic_ids, '|')[1] END AS topic FROM pp) WHERE topic IS NOT NULL)"
_M = r"mt AS (SELECT professor_id, paper_id, trim(unnest(string_split(method_tags, '|'))) AS method FROM pp)"


def queries():
    names = [
        topic_entropy, method_diversity, research_breadth, pairwise_coherence, temporal_evolution, temporal_distribution, complexity_distribution, oa_rate, oa_status_counts,
        evidence_completeness, visibility, synthesis_difficulty, collaboration, topic_clusters, coverage_potential, embedding_spread,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    ladder = "CASE WHEN {a}.topic = {b}.topic THEN 1.0 WHEN {a}.subfield = {b}.subfield THEN 0.85 WHEN {a}.field = {b}.field THEN 0.7 WHEN {a}.domain = {b}.domain THEN 0.6 ELSE 0 END::DOUBLE"
    coh = f"SELECT a.professor_id, count(*) AS n, avg({ladder.format(a='a', b='b')}) AS c FROM lv a JOIN lv b ON a.professor_id = b.professor_id AND a.paper_id < b.paper_id GROUP BY ALL"
    evo = "SELECT professor_id, CASE WHEN count(*) >= 2 AND count(DISTINCT publication_year) >= 2 THEN avg(dist) END AS v FROM (SELECT professor_id, publication_year, CASE WHEN p IS NULL THEN NULL WHEN topic = p THEN 0 WHEN subfield = left(p, length(p) - 1) THEN .15 WHEN field = left(p, length(p) - 2) THEN .3 WHEN domain = left(p, length(p) - 3) THEN .4 ELSE 1 END::DOUBLE AS dist FROM (SELECT *, lag(topic) OVER (PARTITION BY professor_id ORDER BY publication_year, paper_id) AS p FROM lv WHERE publication_year IS NOT NULL)) GROUP BY professor_id"
    b = "avg(coalesce({}, false)::INT)"
    return {
        "topic_entropy": f"WITH {PAPERS_SQL}, {_T} SELECT professor_id, round(e, 9) AS entropy, k AS n_topics FROM ({_ENT.format(c='topic', f='tp')})",
        "method_diversity": f"WITH {PAPERS_SQL}, {_M} SELECT professor_id, round((0.5::DOUBLE * e + 0.5::DOUBLE * least(1, k / 20.0::DOUBLE)) / 1.0, 9) AS diversity, k AS n_methods FROM ({_ENT.format(c='method', f='mt')})",
        "research_breadth": f"""WITH {PAPERS_SQL}, {_T}, {_M}, t AS ({_ENT.format(c='topic', f='tp')}), m AS ({_ENT.format(c='method', f='mt')}), b AS (SELECT professor_id, count(*) AS n, count(DISTINCT publication_year) AS y FROM pp GROUP BY ALL),
            v AS (SELECT professor_id, t.e AS a1, CASE WHEN n = 1 AND t.k IS NOT NULL THEN 0 WHEN n = 1 THEN 0 WHEN n > 1 THEN (t.k - 1) / (n - 1)::DOUBLE END AS a2, m.e AS a3, CASE WHEN m.k IS NULL THEN 1 ELSE least(1, m.k / 20.0::DOUBLE) END AS a4, CASE WHEN n = 1 THEN 0 ELSE (y - 1) / (n - 1)::DOUBLE END AS a5 FROM b LEFT JOIN t USING (professor_id) LEFT JOIN m USING (professor_id))
            SELECT professor_id, round((coalesce(.35 * a1, 0) + coalesce(.25 * a2, 0) + coalesce(.2 * a3, 0) + coalesce(.1 * a4, 0) + coalesce(.1 * a5, 0))::DOUBLE / w, 9) AS breadth, round(w, 9) AS denominator, miss AS missing
            FROM (SELECT *, ((a1 IS NOT NULL)::INT * .35::DOUBLE + (a2 IS NOT NULL)::INT * .25::DOUBLE + (a3 IS NOT NULL)::INT * .2::DOUBLE + (a4 IS NOT NULL)::INT * .1::DOUBLE + (a5 IS NOT NULL)::INT * .1::DOUBLE) AS w,
              concat_ws(',', CASE WHEN a1 IS NULL THEN 'topic_entropy' END, CASE WHEN a2 IS NULL THEN 'topics' END, CASE WHEN a3 IS NULL THEN 'method_entropy' END, CASE WHEN a4 IS NULL THEN 'methods' END, CASE WHEN a5 IS NULL THEN 'years' END) AS miss FROM v)""",
        "pairwise_coherence": f"WITH {PAPERS_SQL}, {_LV}, c AS ({coh}) SELECT professor_id, coalesce(n, 0) AS n_pairs, round(c, 9) AS coherence FROM (SELECT DISTINCT professor_id FROM lv) LEFT JOIN c USING (professor_id)",
        "temporal_evolution": f"WITH {PAPERS_SQL}, {_LV} SELECT professor_id, round(v, 9) AS evolution FROM ({evo})",
        "temporal_distribution": f"WITH {PAPERS_SQL} SELECT professor_id, min(publication_year) AS first_year, max(publication_year) AS last_year, max(publication_year) - min(publication_year) AS span, count(DISTINCT publication_year) AS n_years, count(*) FILTER (publication_year IS NULL) AS n_missing FROM pp GROUP BY professor_id",
        "complexity_distribution": f"WITH {PAPERS_SQL} SELECT professor_id, round(avg(complexity_score), 9) AS mean, round(median(complexity_score), 9) AS median, min(complexity_score) AS lowest, max(complexity_score) AS highest, count(*) FILTER (complexity_score IS NULL) AS n_missing FROM pp GROUP BY professor_id",
        "oa_rate": f"WITH {PAPERS_SQL} SELECT professor_id, round(avg(open_access::INT), 9) AS oa_rate, count(*) FILTER (open_access IS NULL) AS n_unknown FROM pp GROUP BY professor_id",
        "oa_status_counts": "SELECT CASE WHEN (open_access.is_oa AND open_access.oa_status = 'closed') OR (NOT open_access.is_oa AND open_access.oa_status <> 'closed') THEN NULL ELSE open_access.oa_status END AS oa_status, count(*) AS n_works FROM works_page GROUP BY 1",
        "evidence_completeness": f"WITH {PAPERS_SQL} SELECT professor_id, round(({' + '.join(b.format(x) for x in ('trim(topic_ids) <> %s' % repr(''), 'trim(method_tags) <> %s' % repr(''), 'publication_year IS NOT NULL', 'complexity_score IS NOT NULL', 'abstract_available'))}) / 5, 9) AS completeness FROM pp GROUP BY professor_id",
        "visibility": f"WITH {PAPERS_SQL} SELECT professor_id, round(avg(CASE WHEN NOT isnan(citation_percentile_field_year) AND citation_percentile_field_year BETWEEN 0 AND 100 THEN citation_percentile_field_year END) / 100, 9) AS visibility FROM pp GROUP BY professor_id",
        "synthesis_difficulty": f"""WITH {PAPERS_SQL}, {_T}, {_LV}, e AS ({_ENT.format(c='topic', f='tp')}), c AS ({coh}), v AS ({evo}), m AS (SELECT professor_id, avg(complexity_score) AS m FROM pp GROUP BY ALL),
            j AS (SELECT professor_id, round(e.e, 9) AS a1, 1 - round(c.c, 9) AS a2, round(m.m, 9) / 100 AS a3, round(v.v, 9) AS a4 FROM m LEFT JOIN e USING (professor_id) LEFT JOIN c USING (professor_id) LEFT JOIN v USING (professor_id)),
            x AS (SELECT professor_id, round((coalesce(.3 * a1, 0) + coalesce(.3 * a2, 0) + coalesce(.2 * a3, 0) + coalesce(.2 * a4, 0))::DOUBLE / nullif((a1 IS NOT NULL)::INT * .3::DOUBLE + (a2 IS NOT NULL)::INT * .3::DOUBLE + (a3 IS NOT NULL)::INT * .2::DOUBLE + (a4 IS NOT NULL)::INT * .2::DOUBLE, 0), 7) AS difficulty FROM j)
            SELECT professor_id, difficulty, CASE WHEN difficulty < .33 THEN 'low' WHEN difficulty < .67 THEN 'medium' WHEN difficulty IS NOT NULL THEN 'high' END AS tier FROM x""",
        "collaboration": """WITH w AS (SELECT regexp_extract(id, '([^/]+)/*$', 1) AS work, authorships, row_number() OVER (PARTITION BY regexp_extract(id, '([^/]+)/*$', 1) ORDER BY retrieved_at DESC, row_id DESC) AS rn FROM works_page),
            x AS (SELECT work, unnest(authorships) AS a FROM w WHERE rn = 1), a AS (SELECT DISTINCT work, regexp_extract(a.author.id, '([^/]+)/*$', 1) AS author FROM x WHERE regexp_extract(a.author.id, '([^/]+)/*$', 1) <> ''),
            i AS (SELECT work, count(DISTINCT regexp_extract(i.id, '([^/]+)/*$', 1)) FILTER (regexp_extract(i.id, '([^/]+)/*$', 1) <> '') AS n_inst FROM (SELECT work, unnest(a.institutions) AS i FROM x) GROUP BY work),
            n AS (SELECT work, count(*) AS n FROM a GROUP BY work), e AS (SELECT a.work, a.author, n.n, coalesce(i.n_inst, 0) AS n_inst FROM a JOIN n USING (work) LEFT JOIN i USING (work)),
            p AS (SELECT a.author, count(DISTINCT b.author) AS n_coauthors FROM a JOIN a b USING (work) WHERE a.author <> b.author GROUP BY a.author)
            SELECT author, count(*) AS n_works, round(avg(n), 9) AS mean_authors, round(avg((n_inst > 1)::INT), 9) AS multi_institution_rate, coalesce(any_value(p.n_coauthors), 0) AS n_coauthors FROM e LEFT JOIN p USING (author) GROUP BY author""",
        "topic_clusters": "WITH t AS (SELECT regexp_extract(id, '([^/]+)/*$', 1) AS author, unnest(topics) AS t FROM authors_page) SELECT regexp_extract(t.id, '([^/]+)/*$', 1) AS topic, arg_min(t.display_name, [lower(t.display_name), t.display_name]) AS label, count(DISTINCT author) AS n_authors, round(avg(t.score), 6) AS mean_score FROM t WHERE regexp_extract(t.id, '([^/]+)/*$', 1) <> '' AND author <> '' GROUP BY topic",
        "coverage_potential": f"WITH {PAPERS_SQL}, {_T}, t AS (SELECT DISTINCT * FROM tp WHERE topic <> ''), d AS (SELECT professor_id, topic, 1.0::DOUBLE / count(*) AS w FROM t GROUP BY ALL), s AS (SELECT professor_id, paper_id, sum(w) AS s FROM t JOIN d USING (professor_id, topic) GROUP BY ALL) SELECT professor_id, paper_id, round(s / max(s) OVER (PARTITION BY professor_id), 9) AS potential FROM s",
        "embedding_spread": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id), n AS (SELECT label, count(*) AS n_vectors FROM e GROUP BY label) SELECT n.label, n_vectors, round(avg(c), 6) AS mean_cosine FROM n LEFT JOIN p ON n.label = p.label GROUP BY ALL",
    }
