"""Record rules bound to the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, clean, latest
from lectern.functions.rank import first_rows
from lectern.functions.text import doi
from lectern.operators import records as R
from lectern.operators.quality import errors, report
from lectern.plans.ranking import PAPERS_SQL, papers
from lectern.sources.tables import table


def date_keys(spark, d):
    """Sort keys of publication dates, and how many of the works of a key there are."""
    w = table(spark, d, "works_page")
    return w.groupBy(R.date_key("publication_date", "publication_year").alias("date_key")).agg(F.count("*").alias("n_works"))


def csv_cells(spark, d):
    """Professor rows as cells of a text table, and what truth cells are read back as."""
    p = table(spark, d, "professors").select("row_id", *[R.csv_cell(c).alias(c) for c in ("professor_id", "academic_age_years", "collection_complete")])
    return p.withColumn("read_back", R.truth_cell("collection_complete"))


def domains_by_title(spark, d):
    """Works by the domain their title's words tell."""
    return table(spark, d, "works_page").groupBy(R.first_domain("title").alias("domain")).agg(F.count("*").alias("n_works"))


def distinct_topics(spark, d):
    """Topics of profile rows: how many, how many different ones, and of how many kinds."""
    a = table(spark, d, "authors_page").filter("topics IS NOT NULL")
    return a.select("row_id", F.size("topics").alias("n_topics"), F.size(R.distinct_by_id("topics", "id", "display_name")).alias("n_distinct"), R.breadth("topics", ["id", "display_name"]).alias("breadth"))


def controlled_tags(spark, d):
    """Papers by their method tags, or their topics where they have none."""
    c = table(spark, d, "candidate_papers")
    return c.groupBy(F.array_join(R.tags_or("method_tags", "topic_ids"), ",").alias("tags")).agg(F.count("*").alias("n_rows"))


def open_locations(spark, d):
    """Works by what is known of their being open and by their best open location."""
    w = table(spark, d, "works_page")
    seen = R.open_observation("open_access.is_oa", "open_access.oa_status")
    part = lambda x: F.struct(x["is_oa"].alias("is_oa"), x["pdf_url"].alias("pdf_url"), x["landing_page_url"].alias("landing_page_url"))
    locations = F.transform("locations", part)
    out = w.select(seen.alias("is_open"), R.location_score(seen, part(F.col("primary_location")), locations).alias("score"))
    return out.groupBy("is_open", "score").agg(F.count("*").alias("n_works"))


def lacking_fields(spark, d):
    """What collected papers lack, each counting for everything it lacks."""
    p, s = papers(spark, d), F.col("complexity_score")
    return R.reason_histogram(p, {
        "no_abstract": ~F.coalesce("abstract_available", F.lit(False)), "no_year": F.col("publication_year").isNull(), "no_score": s.isNull(), "not_open": ~F.col("open_access"), "not_verified": ~F.coalesce("ownership_verified", F.lit(False)),
    })


def topic_mixtures(spark, d):
    """Professors whose papers are of at least three groups of topics without a leading one; a group is a topic's id
    without its last digit."""
    topic = F.split(F.coalesce("topic_ids", F.lit("")), r"\|")[0]
    p = papers(spark, d).select("professor_id", F.when(topic.rlike(r"^T\d{4,}$"), topic).alias("topic")).withColumn("domain", F.expr("left(topic, length(topic) - 1)"))
    return R.mixed_topics(p, "professor_id", "domain", 3, 0.6).select("professor_id", "n_topics", F.round("top_share", 9).alias("top_share"))


def focal_not_selected(spark, d):
    """Professors with focal papers that aren't among the selected ones."""
    p = papers(spark, d)
    return R.not_contained(p.filter("focal"), p.filter("selected"), "professor_id", "paper_id")


def packet_problems(spark, d):
    """Evidence papers without DOI, abstract or source, packets with a paper id twice or with fewer than two papers."""
    e = table(spark, d, "evidence_papers").filter("paper_key IS NOT NULL AND professor_id IS NOT NULL")
    e = latest(e.select("paper_key", "professor_id", "paper_id", "doi", "abstract", "provenance", "retrieved_at"), ["paper_key"], ["retrieved_at"], ["professor_id", "paper_id", "doi", "abstract", "provenance"])
    per = e.groupBy("professor_id", "paper_id").agg(F.count("*").alias("n"))
    sizes = e.groupBy("professor_id").agg(F.count("*").alias("n"))
    return report([
        errors(e.filter(doi("doi").isNull()), "missing_doi", "paper_key", F.col("paper_id")), errors(e.filter(clean("abstract").isNull()), "empty_abstract", "paper_key", F.col("paper_id")),
        errors(e.filter(clean("provenance.source_url").isNull()), "missing_source", "paper_key", F.col("paper_id")),
        errors(per.filter("n > 1"), "repeated_paper_id", "professor_id", F.col("paper_id")), errors(sizes.filter("n < 2"), "few_papers", "professor_id", F.col("n")),
    ])


def ids_that_differ(spark, d):
    """Collected rows by whether the ids of their columns are one, and whether a work has one DOI throughout."""
    c = table(spark, d, "candidate_papers").select("paper_id", bare_id("openalex_work_id").alias("work"), doi("doi").alias("doi"))
    one = c.groupBy("paper_id").agg(F.countDistinct("doi").alias("n"))
    j = c.join(one, "paper_id", "left")
    same = F.when(F.col("paper_id").isNull() | F.col("work").isNull(), "unknown").when(F.col("paper_id") == F.col("work"), "same").otherwise("differ")
    return j.groupBy(same.alias("ids"), (F.coalesce("n", F.lit(0)) > 1).alias("several_dois")).agg(F.count("*").alias("n_rows"))


def latest_profiles_limited(spark, d):
    """The twenty profiles of smallest id among those with enough works, after repeated deliveries are settled."""
    a = table(spark, d, "authors_page").select(bare_id("id").alias("author"), "works_count", "retrieved_at", "row_id").filter("author IS NOT NULL")
    last = latest(a, ["author"], ["retrieved_at", "row_id"], ["works_count"])
    return last.filter("works_count >= 8").orderBy("author").limit(20)


def authorship_entries(spark, d):
    """Different (author, name) entries of works, authors without an id told by name alone."""
    w = table(spark, d, "works_page").select("row_id", F.explode("authorships").alias("a"))
    e = w.select("row_id", bare_id("a.author.id").alias("author"), F.lower(clean("a.author.display_name")).alias("name")).filter("author IS NOT NULL OR name IS NOT NULL").distinct()
    return e.groupBy("row_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("author").isNull()).alias("n_by_name"))


def recent_titles_in_order(spark, d):
    """The three most recent papers of each professor with their own rows' titles, in order of selection."""
    c = table(spark, d, "candidate_papers").filter("professor_id IS NOT NULL AND paper_id IS NOT NULL")
    rows = latest(c, ["professor_id", "paper_id"], ["collected_at", "ingested_at", "row_id"], ["title", "publication_year"])
    order = first_rows(rows.select("professor_id", "paper_id", F.coalesce("publication_year", F.lit(-1)).alias("y")), ["professor_id"], [F.desc("y"), F.col("paper_id")], 3)
    return order.join(rows, ["professor_id", "paper_id"]).select("professor_id", F.col("place").alias("selection_order"), "paper_id", "title")


def queries():
    names = [
        date_keys, csv_cells, domains_by_title, distinct_topics, controlled_tags, open_locations, lacking_fields, topic_mixtures, focal_not_selected, packet_problems, ids_that_differ,
        latest_profiles_limited, authorship_entries, recent_titles_in_order,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    bare = "nullif(regexp_extract({}, '([^/]+)/*$', 1), '')".format
    plain_doi = r"nullif(trim(regexp_replace(lower(trim({})), '^(?:https?://[^/]+/|doi:\s*)', '')), '')".format
    words = " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), '{'|'.join(w)}') THEN '{k}'" for k, w in R.DOMAIN_WORDS.items())
    tags = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')))".format
    seen = """CASE WHEN f IS NOT NULL AND s IS NOT NULL AND f <> s THEN NULL ELSE coalesce(f, s) END"""
    link = "coalesce(regexp_matches(lower(trim({})), '^https?://'), false)".format
    latest_pp = "(SELECT *, row_number() OVER (PARTITION BY professor_id, paper_id ORDER BY collected_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM candidate_papers WHERE professor_id IS NOT NULL AND paper_id IS NOT NULL)"
    return {
        "date_keys": """SELECT CASE WHEN regexp_full_match(replace(publication_date, '-', ''), '[0-9]{8}') THEN replace(publication_date, '-', '')::INT WHEN publication_year BETWEEN 1 AND 9999 THEN publication_year * 10000 END AS date_key, count(*) AS n_works
            FROM works_page GROUP BY 1""",
        "csv_cells": "SELECT row_id, coalesce(professor_id, '') AS professor_id, coalesce(academic_age_years::VARCHAR, '') AS academic_age_years, coalesce(collection_complete::VARCHAR, '') AS collection_complete, collection_complete AS read_back FROM professors",
        "domains_by_title": f"SELECT CASE {words} ELSE 'SSH' END AS domain, count(*) AS n_works FROM works_page GROUP BY 1",
        "distinct_topics": """WITH t AS (SELECT row_id, len(topics) AS n, unnest(topics) AS t FROM authors_page WHERE topics IS NOT NULL), g AS (
              SELECT row_id, any_value(n) AS n, count(DISTINCT nullif(trim(t.id), '')) + count(*) FILTER (nullif(trim(t.id), '') IS NULL) AS k, count(DISTINCT lower(nullif(trim(t.id), ''))) AS i, count(DISTINCT lower(nullif(trim(t.display_name), ''))) AS l FROM t GROUP BY row_id)
            SELECT a.row_id, len(a.topics)::INT AS n_topics, coalesce(k, 0)::INT AS n_distinct, coalesce(CASE WHEN i > 0 THEN i ELSE l END, 0)::INT AS breadth FROM authors_page a LEFT JOIN g USING (row_id) WHERE a.topics IS NOT NULL""",
        "controlled_tags": f"SELECT array_to_string(CASE WHEN len({tags('method_tags')}) > 0 THEN {tags('method_tags')} ELSE {tags('topic_ids')} END, ',') AS tags, count(*) AS n_rows FROM candidate_papers GROUP BY 1",
        "open_locations": f"""WITH o AS (SELECT row_id, primary_location AS p, locations AS l, open_access.is_oa AS f, CASE WHEN lower(trim(open_access.oa_status)) IN ('diamond', 'gold', 'green', 'hybrid', 'bronze') THEN true WHEN lower(trim(open_access.oa_status)) = 'closed' THEN false END AS s FROM works_page),
            x AS (SELECT row_id, p AS q FROM o UNION ALL SELECT row_id, unnest(l) FROM o),
            b AS (SELECT row_id, max(CASE WHEN NOT coalesce(q.is_oa, false) THEN 0 WHEN {link('q.pdf_url')} THEN 1.0 WHEN {link('q.landing_page_url')} THEN 0.9 ELSE 0 END) AS b FROM x GROUP BY row_id), r AS (SELECT {seen} AS is_open, b FROM o JOIN b USING (row_id))
            SELECT is_open, CASE WHEN NOT coalesce(is_open, true) THEN 0 WHEN b > 0 THEN b WHEN is_open THEN 0.5 ELSE 0 END::DOUBLE AS score, count(*) AS n_works FROM r GROUP BY ALL""",
        "lacking_fields": f"""WITH {PAPERS_SQL}, r AS (SELECT unnest(['no_abstract', 'no_year', 'no_score', 'not_open', 'not_verified']) AS reason, unnest([NOT coalesce(abstract_available, false), publication_year IS NULL, complexity_score IS NULL, NOT open_access, NOT coalesce(ownership_verified, false)]) AS b FROM pp)
            SELECT reason, count(*) AS n FROM r WHERE b GROUP BY reason""",
        "topic_mixtures": f"""WITH {PAPERS_SQL}, t AS (SELECT professor_id, left(string_split(topic_ids, '|')[1], length(string_split(topic_ids, '|')[1]) - 1) AS dom FROM pp WHERE regexp_matches(string_split(topic_ids, '|')[1], '^T\\d{{4,}}$')),
            c AS (SELECT professor_id, dom, count(*) AS n FROM t GROUP BY ALL) SELECT professor_id, count(*) AS n_topics, round(max(n) / sum(n)::DOUBLE, 9) AS top_share FROM c GROUP BY professor_id HAVING count(*) >= 3 AND max(n) / sum(n) < 0.6""",
        "focal_not_selected": f"WITH {PAPERS_SQL} SELECT professor_id, count(*) AS n_missing FROM pp WHERE focal AND NOT coalesce(selected, false) GROUP BY professor_id",
        "packet_problems": f"""WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY retrieved_at DESC) AS rn FROM evidence_papers WHERE paper_key IS NOT NULL AND professor_id IS NOT NULL) WHERE rn = 1)
            SELECT 'missing_doi' AS check_name, paper_key::VARCHAR AS entity, paper_id AS detail FROM e WHERE {plain_doi('doi')} IS NULL UNION ALL SELECT 'empty_abstract', paper_key::VARCHAR, paper_id FROM e WHERE abstract IS NULL OR regexp_full_match(abstract, '\\s*')
            UNION ALL SELECT 'missing_source', paper_key::VARCHAR, paper_id FROM e WHERE nullif(trim(provenance.source_url), '') IS NULL UNION ALL SELECT 'repeated_paper_id', professor_id, paper_id FROM e GROUP BY ALL HAVING count(*) > 1
            UNION ALL SELECT 'few_papers', professor_id, count(*)::VARCHAR FROM e GROUP BY professor_id HAVING count(*) < 2""",
        "ids_that_differ": f"""WITH c AS (SELECT paper_id, {bare('openalex_work_id')} AS work, {plain_doi('doi')} AS doi FROM candidate_papers), o AS (SELECT paper_id, count(DISTINCT doi) AS n FROM c WHERE paper_id IS NOT NULL GROUP BY ALL)
            SELECT CASE WHEN paper_id IS NULL OR work IS NULL THEN 'unknown' WHEN paper_id = work THEN 'same' ELSE 'differ' END AS ids, coalesce(n, 0) > 1 AS several_dois, count(*) AS n_rows FROM c LEFT JOIN o USING (paper_id) GROUP BY ALL""",
        "latest_profiles_limited": f"SELECT author, works_count FROM (SELECT {bare('id')} AS author, works_count, row_number() OVER (PARTITION BY {bare('id')} ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) AS rn FROM authors_page) WHERE rn = 1 AND author IS NOT NULL AND works_count >= 8 ORDER BY author LIMIT 20",
        "authorship_entries": f"""WITH e AS (SELECT DISTINCT row_id, {bare('a.author.id')} AS author, nullif(lower(trim(a.author.display_name)), '') AS name FROM (SELECT row_id, unnest(authorships) AS a FROM works_page))
            SELECT row_id, count(*) AS n_entries, count(*) FILTER (author IS NULL) AS n_by_name FROM e WHERE author IS NOT NULL OR name IS NOT NULL GROUP BY row_id""",
        "recent_titles_in_order": f"""WITH r AS (SELECT professor_id, paper_id, title, row_number() OVER (PARTITION BY professor_id ORDER BY coalesce(publication_year, -1) DESC, paper_id)::INT AS selection_order FROM {latest_pp} WHERE rn = 1)
            SELECT professor_id, selection_order, paper_id, title FROM r WHERE selection_order <= 3""",
    }
