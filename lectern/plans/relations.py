"""Joins, deduplication, consistency and quality checks over the domain tables and the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, latest
from lectern.functions.rank import first_rows
from lectern.functions.text import any_secret, doi, title_key
from lectern.operators import quality as Q
from lectern.operators.collect import collection_summary, cursor_chain, first_seen, status_cascade
from lectern.operators.select import candidate_pool, focal_pair, margin_sample, representative
from lectern.plans.ranking import PAPERS_SQL, papers
from lectern.sources.tables import table
from lectern.storage import materialize


def works(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works_page").select(bare_id("id").alias("work"), "title", doi("ids.doi").alias("doi"), title_key("title").alias("tk"), "retrieved_at", "row_id", "publication_year", "cited_by_count", "authorships")
    return latest(w.filter("work IS NOT NULL"), ["work"], ["retrieved_at", "row_id"], ["title", "doi", "tk", "publication_year", "cited_by_count", "authorships"])


def first_seen_dedupe(spark, d):
    """Institutions by first sight, with the countries they were met under."""
    a = table(spark, d, "authors_page").select("row_id", F.posexplode("last_known_institutions").alias("pos", "i"))
    rows = a.select("row_id", "pos", bare_id("i.id").alias("institution"), F.col("i.display_name").alias("display_name"), F.col("i.country_code").alias("country"))
    return first_seen(rows, "institution", ["row_id", "pos"], ["display_name"], "country").select("institution", "display_name", F.array_join("discovered_by", ",").alias("countries"))


def collection_totals(spark, d):
    w = table(spark, d, "works_page").select(bare_id("id").alias("work"), "type", "language")
    return collection_summary(w, "work", F.coalesce(F.col("work").rlike(r"^W\d+$"), F.lit(False)), ["type", "language"])


def screening_cascade(spark, d):
    """Profiles by the first thing they lack: works, an institution, topics."""
    a = table(spark, d, "authors_page")
    some = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast(a.schema[c].dataType)), lambda x: x["id"].isNotNull())
    status = status_cascade([(F.col("works_count") >= 8, "few_works"), (some("last_known_institutions"), "no_institution"), (some("topics"), "no_topics")], "complete")
    return a.groupBy(status.alias("status")).agg(F.count("*").alias("n_profiles"))


def publication_years(spark, d):
    """First and last year with works of each profile row, from its yearly counts."""
    a = table(spark, d, "authors_page")
    years = F.transform(F.filter("counts_by_year", lambda x: (x["works_count"] > 0) & x["year"].between(1500, 2100)), lambda x: x["year"])
    return a.select("row_id", F.array_min(years).alias("first_year"), F.array_max(years).alias("last_year"))


def author_projection(spark, d):
    """One flat row per profile row: bare id, first institution and topic, h-index."""
    a = table(spark, d, "authors_page")
    inst, topic = F.try_element_at("last_known_institutions", F.lit(1)), F.try_element_at("topics", F.lit(1))
    return a.select("row_id", bare_id("id").alias("author"), F.trim("display_name").alias("name"), bare_id(inst["id"]).alias("institution"), inst["country_code"].alias("country"), bare_id(topic["id"]).alias("topic"), F.col("summary_stats.h_index").alias("h_index"), F.size(F.coalesce("affiliations", F.array().cast(a.schema["affiliations"].dataType))).alias("n_affiliations"))


def overlap_profiles(spark, d):
    """Authors of works that more than one profile claims."""
    x = works(spark, d).select("work", F.explode("authorships").alias("a")).select("work", bare_id("a.author.id").alias("author")).filter("author IS NOT NULL").distinct()
    shared = x.groupBy("work").agg(F.count("*").alias("n")).filter("n > 1").select("work")
    return x.join(shared, "work", "left_semi").groupBy("author").agg(F.count("*").alias("n_shared"))


def doi_title_conflict(spark, d):
    """DOIs by whether works of different titles run under them."""
    w = works(spark, d).filter("doi IS NOT NULL AND tk IS NOT NULL").groupBy("doi").agg(F.countDistinct("tk").alias("n_titles"), F.count("*").alias("n_works"))
    return w.groupBy((F.col("n_titles") > 1).alias("several_titles")).agg(F.count("*").alias("n_dois"), F.sum("n_works").alias("n_works"))


def title_doi_conflict(spark, d):
    """Titles under which several DOIs run: copies of a work under other ids."""
    w = works(spark, d).filter("doi IS NOT NULL AND tk IS NOT NULL").groupBy("tk").agg(F.countDistinct("doi").alias("n_dois"), F.countDistinct("work").alias("n_works"))
    return w.filter("n_dois > 1")


def author_name_conflict(spark, d):
    """Author ids under which works print different names."""
    x = works(spark, d).select(F.explode("authorships").alias("a")).select(bare_id("a.author.id").alias("author"), F.lower(F.trim("a.raw_author_name")).alias("name")).filter("author IS NOT NULL AND name IS NOT NULL")
    return x.groupBy("author").agg(F.countDistinct("name").alias("n_names")).filter("n_names > 1")


def work_consistency(spark, d):
    """Issue codes of each work: no title, no year, shared DOI, repeated author id; and a status."""
    w = materialize(works(spark, d), "consistency")
    shared = w.filter("doi IS NOT NULL").groupBy("doi").agg(F.countDistinct("work").alias("n_doi"))
    ids = F.filter(F.transform("authorships", lambda x: bare_id(x["author"]["id"])), lambda x: x.isNotNull())
    j = w.join(shared, "doi", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("tk").isNull(), "missing_title"), F.when(F.col("publication_year").isNull(), "missing_year"),
        F.when(F.coalesce("n_doi", F.lit(0)) > 1, "shared_doi"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_author"),
    ))
    return j.select("work", F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) == 0, "consistent").when(F.size(issues) == 1, "check").otherwise("inconsistent").alias("status"))


def pool_selected_focal(spark, d):
    """Papers of a pool with the strongest of their flags: focal, selected, pool."""
    return papers(spark, d).groupBy(F.when(F.col("focal").eqNullSafe(True), "focal").when(F.col("selected").eqNullSafe(True), "selected").otherwise("pool").alias("role")).agg(F.count("*").alias("n_papers"))


def filter_grid(spark, d):
    """Every country with every institution type, sorted and numbered (both lists are short, distinct values)."""
    i = table(spark, d, "authors_page").select(F.explode("last_known_institutions").alias("i"))
    pairs = i.agg(F.array_sort(F.collect_set("i.country_code")).alias("c"), F.array_sort(F.collect_set("i.type")).alias("t"))
    return pairs.select(F.explode("c").alias("country"), "t").select("country", F.explode("t").alias("institution_type"))


def fk_antijoin(spark, d):
    p, a = table(spark, d, "professors"), table(spark, d, "authors_page").select(bare_id("id").alias("author"))
    c, e = table(spark, d, "candidate_papers"), table(spark, d, "evidence_papers")
    w = table(spark, d, "works_page").select(bare_id("id").alias("work"))
    return Q.report([
        Q.orphans(p.select(bare_id("openalex_author_id").alias("x")), "x", a, "author", "professor_without_profile"),
        Q.orphans(c, "professor_id", p, "professor_id", "paper_without_professor"),
        Q.orphans(e, "professor_id", p, "professor_id", "evidence_without_professor"),
        Q.orphans(c, "paper_id", w, "work", "paper_without_work"),
        Q.orphans(e, "paper_key", table(spark, d, "paper_features"), "paper_key", "evidence_without_features"),
        Q.orphans(table(spark, d, "documents"), "professor_id", c, "professor_id", "document_without_papers"),
        Q.orphans(table(spark, d, "claims_to_label"), "claim_id", table(spark, d, "claim_labels"), "claim_id", "claim_without_label"),
    ])


def fk_antijoin_star(spark, d):
    o, c, l, p = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "part"))
    return Q.report([
        Q.orphans(c, "c_custkey", o, "o_custkey", "customer_without_order"), Q.orphans(l, "l_orderkey", o, "o_orderkey", "line_without_order"), Q.orphans(p, "p_partkey", l, "l_partkey", "part_never_ordered"),
        Q.orphans(o, "o_orderkey", l, "l_orderkey", "order_without_line"),
    ])


def uniqueness(spark, d):
    return Q.report([
        Q.not_unique(table(spark, d, "works_page").select(bare_id("id").alias("work")), "work", "work_delivered_again"),
        Q.not_unique(table(spark, d, "professors"), "professor_id", "professor_again"), Q.not_unique(table(spark, d, "documents"), "doc_id", "document_again"),
        Q.malformed(table(spark, d, "professors"), "professor_id", r"^(CS|PSY|BIO)-\d{8}$", "professor_id_form"),
    ])


def required_counts(spark, d):
    """Professors whose number of selected papers isn't eight."""
    return Q.wrong_count(papers(spark, d).filter("selected"), "professor_id", 8, 8, "selected_papers")


def selection_set_equality(spark, d):
    """Professors whose selected papers and papers of highest score (the eight best) differ as sets."""
    p = papers(spark, d)
    best = first_rows(p.filter("complexity_score IS NOT NULL").select("professor_id", "paper_id", "complexity_score"), ["professor_id"], [F.desc("complexity_score"), F.col("paper_id")], 8)
    return Q.differing_sets(p.filter("selected"), best, "professor_id", "paper_id", "papers_differ")


def unreferenced_full_outer(spark, d):
    a = table(spark, d, "candidate_papers").select(bare_id("openalex_work_id").alias("work")).filter("work IS NOT NULL")
    b = table(spark, d, "works_page").select(bare_id("id").alias("work")).filter("work IS NOT NULL")
    return Q.unreferenced(a, b, ["work"])


def marker_check(spark, d):
    """Papers collected per professor against the count of the last marker (here: distinct ids against rows)."""
    c = table(spark, d, "candidate_papers").filter("professor_id IS NOT NULL").groupBy("professor_id").agg(F.count("*").alias("n_rows"), F.countDistinct("paper_id").alias("n_papers"), F.min("collected_at").alias("first_at"), F.max("collected_at").alias("last_at"))
    return c.select("professor_id", "n_rows", "n_papers", (F.col("n_rows") == F.col("n_papers")).alias("complete"), F.date_format("first_at", "yyyy-MM-dd").alias("first_day"), F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


def secret_scan(spark, d):
    """Documents with something that looks like a key or token, by source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(any_secret("text")).alias("n_suspect"))


def private_name_scan(spark, d):
    """Documents that name a person of any column that holds names, by source."""
    a, w, e = (table(spark, d, t) for t in ("authors_page", "works_page", "evidence_papers"))
    printed = w.select(F.explode("authorships").alias("a"))
    parts = [a.select(F.col("display_name").alias("n")), a.select(F.explode("display_name_alternatives").alias("n")), printed.select(F.col("a.raw_author_name").alias("n")), printed.select(F.col("a.author.display_name").alias("n")), e.select(F.explode("authors").alias("n"))]
    docs = table(spark, d, "documents")
    named = Q.containing_names(docs, "doc_id", "text", reduce(DataFrame.union, parts), "n").select("doc_id").distinct().withColumn("naming", F.lit(1))
    return docs.select("doc_id", "source").join(named, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count("naming").alias("n_naming"))


def topic_name_scan(spark, d):
    """Names of the profiles' topics that stand in documents."""
    names = table(spark, d, "authors_page").select(F.explode("topics").alias("t")).select("t.display_name")
    return Q.containing_names(table(spark, d, "documents"), "doc_id", "text", names, "display_name")


def error_report(spark, d):
    """All checks together, counted."""
    return Q.report([fk_antijoin(spark, d), uniqueness(spark, d), required_counts(spark, d)]).groupBy("check_name").agg(F.count("*").alias("n_errors"))


def replayed_authors(spark, d):
    """Records of the stored pages in order of page and position."""
    p = table(spark, d, "raw_pages").select("page_id", F.from_json("payload", "meta struct<next_cursor: string>, results array<struct<id: string, display_name: string>>").alias("j"))
    return p.select("page_id", F.posexplode("j.results").alias("pos", "r")).select("page_id", "pos", bare_id("r.id").alias("author"), F.col("r.display_name").alias("name")).filter("author IS NOT NULL")


def page_chain(spark, d):
    """Distance of each page from the first one along the cursors."""
    p = table(spark, d, "raw_pages").select("page_id", F.get_json_object("payload", "$.meta.next_cursor").alias("nxt"))
    p = p.select(F.when(F.col("page_id") == 1, "*").otherwise(F.concat(F.lit("cursor-"), "page_id")).alias("cur"), "nxt")
    return cursor_chain(p, "cur", "nxt")


def _items(spark, d) -> DataFrame:
    p = papers(spark, d)
    part = lambda c, kind: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    x = F.col("citation_percentile_field_year")
    return materialize(p.select(
        "professor_id", "paper_id", F.col("publication_year").alias("recency"), F.when(~F.isnan(x), x).alias("influence"), F.array_distinct(F.concat(part("topic_ids", "topic:"), part("method_tags", "method:"))).alias("tokens"),
        F.coalesce(F.col("open_access").cast("double"), F.lit(0.5)).alias("open"), F.coalesce("abstract_available", F.lit(False)).alias("text"), F.coalesce("ownership_verified", F.lit(False)).alias("consistent"),
    ), "items")


def representative_papers(spark, d):
    return representative(_items(spark, d), "professor_id", "paper_id")


def candidate_pools(spark, d):
    return candidate_pool(_items(spark, d), "professor_id", "paper_id")


def focal_pairs(spark, d):
    return focal_pair(_items(spark, d), "professor_id", "paper_id")


def margin_sampler(spark, d):
    """Twelve professors near equal shares of field, with few from one institution."""
    p = latest(table(spark, d, "professors").filter("professor_id IS NOT NULL"), ["professor_id"], ["updated_at", "row_id"], ["field", "institution_id", "candidate_pool_version"])
    return margin_sample(p, {("field", "cs_ai"): 4, ("field", "psychology"): 4, ("field", "biomedicine"): 4}, "professor_id", ["institution_id", "candidate_pool_version"], 12, 7)


def margin_targets(spark, d):
    """Achieved shares of a greedy sample beside its targets."""
    s = margin_sampler(spark, d)
    p = latest(table(spark, d, "professors").filter("professor_id IS NOT NULL"), ["professor_id"], ["updated_at", "row_id"], ["field"])
    t = spark.createDataFrame([("cs_ai", 4), ("psychology", 4), ("biomedicine", 4)], "field string, target int")
    n = s.join(p, "professor_id").groupBy("field").agg(F.count("*").alias("achieved"))
    return t.join(n, "field", "left").select("field", "target", F.coalesce("achieved", F.lit(0)).alias("achieved"), F.greatest(F.col("target") - F.coalesce("achieved", F.lit(0)), F.lit(0)).alias("unmet"))


_B = "regexp_extract({}, '([^/]+)/*$', 1)"
_WORKS = r"""
wk AS (SELECT * EXCLUDE (rn) FROM (SELECT regexp_extract(id, '([^/]+)/*$', 1) AS work, title, nullif(trim(regexp_replace(lower(trim(ids.doi)), '^(?:https?://[^/]+/|doi:\s*)', '')), '') AS doi,
  nullif(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS tk, publication_year, cited_by_count, authorships,
  row_number() OVER (PARTITION BY regexp_extract(id, '([^/]+)/*$', 1) ORDER BY retrieved_at DESC, row_id DESC) AS rn FROM works_page WHERE id IS NOT NULL) WHERE rn = 1),
wa AS (SELECT work, nullif(regexp_extract(a.author.id, '([^/]+)/*$', 1), '') AS author, lower(trim(a.raw_author_name)) AS name FROM (SELECT work, unnest(authorships) AS a FROM wk))
"""


def _orphan_sql(check, key, frm, parents):
    return f"SELECT '{check}' AS check_name, k::VARCHAR AS entity, count(*)::VARCHAR AS detail FROM (SELECT {key} AS k FROM {frm}) WHERE k IS NOT NULL AND k::VARCHAR <> '' AND k NOT IN (SELECT x FROM ({parents}) WHERE x IS NOT NULL) GROUP BY k"


def _scan_sql(names, by_source=False):
    """Full-width forms and no-break spaces stand for all that compatibility folding does to these texts."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    plain = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    form = lambda c: f"trim(regexp_replace(lower(translate(replace(replace(nfc_normalize({c}), 'ﬁ', 'fi'), 'ﬀ', 'ff'), '{wide}', '{plain}')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    found = f"""WITH n AS (SELECT n, {form('n')} AS k FROM ({names}) WHERE n IS NOT NULL), t AS (SELECT doc_id, {form('text')} AS t FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT doc_id, n AS name FROM t JOIN n ON length(k) >= 4 AND contains(t, k)"""
    if not by_source:
        return found
    return f"SELECT source, count(*) AS n_documents, count(f.doc_id) AS n_naming FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM ({found})) f USING (doc_id) GROUP BY source"


_FK = " UNION ALL ".join([
    _orphan_sql("professor_without_profile", _B.format("openalex_author_id"), "professors", f"SELECT {_B.format('id')} AS x FROM authors_page"),
    _orphan_sql("paper_without_professor", "professor_id", "candidate_papers", "SELECT professor_id AS x FROM professors"),
    _orphan_sql("evidence_without_professor", "professor_id", "evidence_papers", "SELECT professor_id AS x FROM professors"),
    _orphan_sql("paper_without_work", "paper_id", "candidate_papers", f"SELECT {_B.format('id')} AS x FROM works_page"),
    _orphan_sql("evidence_without_features", "paper_key", "evidence_papers", "SELECT paper_key AS x FROM paper_features"),
    _orphan_sql("document_without_papers", "professor_id", "documents", "SELECT professor_id AS x FROM candidate_papers"),
    _orphan_sql("claim_without_label", "claim_id", "claims_to_label", "SELECT claim_id AS x FROM claim_labels"),
])
_UNIQUE = f"""SELECT 'work_delivered_again' AS check_name, k AS entity, count(*)::VARCHAR AS detail FROM (SELECT nullif({_B.format('id')}, '') AS k FROM works_page) GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT 'professor_again', professor_id, count(*)::VARCHAR FROM professors GROUP BY professor_id HAVING count(*) > 1
    UNION ALL SELECT 'document_again', doc_id::VARCHAR, count(*)::VARCHAR FROM documents GROUP BY doc_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'professor_id_form', professor_id, '^(CS|PSY|BIO)-\\d{{8}}$' FROM professors WHERE professor_id IS NULL OR NOT regexp_matches(professor_id, '^(CS|PSY|BIO)-\\d{{8}}$')"""
_COUNTS = "SELECT 'selected_papers' AS check_name, professor_id AS entity, count(*)::VARCHAR AS detail FROM pp WHERE selected GROUP BY professor_id HAVING count(*) <> 8"


_ITEMS = """
it AS MATERIALIZED (SELECT professor_id, paper_id, publication_year AS recency, CASE WHEN NOT isnan(citation_percentile_field_year) THEN citation_percentile_field_year END AS influence,
  list_distinct(list_concat(list_transform(list_filter(string_split(coalesce(topic_ids, ''), '|'), lambda x: x <> ''), lambda x: 'topic:' || x), list_transform(list_filter(string_split(coalesce(method_tags, ''), '|'), lambda x: x <> ''), lambda x: 'method:' || x))) AS tokens,
  coalesce(open_access::INT::DOUBLE, 0.5) AS opn, coalesce(abstract_available, false)::INT AS txt, coalesce(ownership_verified, false)::INT AS con FROM pp)
"""


def _greedy_sql(steps):
    """Steps (reason, n) one after the other over the items of all professors; diversifying ones are made one by one."""
    by = {"recent": "coalesce(recency, -1) DESC, paper_id", "influential": "coalesce(influence, -1) DESC, paper_id", "random": "sha256('1' || chr(0) || professor_id || chr(0) || paper_id), paper_id",
          "diversifying": "len(list_filter(tokens, lambda x: NOT list_contains(coalesce(cov, []), x))) DESC, len(tokens) DESC, paper_id"}
    ctes, prev = ["s0 AS (SELECT professor_id, paper_id, '' AS reason, tokens FROM it WHERE false)"], "s0"
    for reason, n in [x for r, n in steps for x in ([(r, 1)] * n if r == "diversifying" else [(r, n)])]:
        name = f"s{len(ctes)}"
        ctes.append(f"""{name} AS MATERIALIZED (SELECT * FROM {prev} UNION ALL SELECT professor_id, paper_id, '{reason}', tokens FROM (
            SELECT i.professor_id, i.paper_id, i.tokens, row_number() OVER (PARTITION BY i.professor_id ORDER BY {by[reason].replace('paper_id', 'i.paper_id').replace('professor_id', 'i.professor_id')}) AS rn
            FROM it i LEFT JOIN (SELECT professor_id, list_distinct(flatten(list(tokens))) AS cov FROM {prev} GROUP BY professor_id) c ON c.professor_id = i.professor_id
            WHERE NOT EXISTS (SELECT 1 FROM {prev} o WHERE o.professor_id = i.professor_id AND o.paper_id = i.paper_id)) WHERE rn <= {n})""")
        prev = name
    return f"WITH {PAPERS_SQL}, {_ITEMS}, {', '.join(ctes)} SELECT professor_id, paper_id, reason FROM {prev}"


_FOCAL = f"""WITH {PAPERS_SQL}, {_ITEMS}, tk AS (SELECT professor_id, paper_id, unnest(tokens) AS t FROM it), w AS (SELECT professor_id, t, 1.0::DOUBLE / count(*) AS w FROM tk GROUP BY ALL),
worth AS MATERIALIZED (SELECT professor_id, paper_id, t, w FROM tk JOIN w USING (professor_id, t)),
c1 AS (SELECT professor_id, paper_id, sum(w) AS c FROM worth GROUP BY ALL), m1 AS (SELECT professor_id, max(c) AS m FROM c1 GROUP BY ALL),
f1 AS MATERIALIZED (SELECT * FROM (SELECT it.professor_id, it.paper_id, it.tokens, row_number() OVER (PARTITION BY it.professor_id ORDER BY round(0.35::DOUBLE * opn + 0.25::DOUBLE * txt + 0.25::DOUBLE * con + 0.15::DOUBLE * coalesce(c / m, 0), 12) DESC, it.paper_id) AS rn
  FROM it LEFT JOIN c1 USING (professor_id, paper_id) LEFT JOIN m1 USING (professor_id)) WHERE rn = 1),
rest AS (SELECT x.* FROM worth x JOIN f1 USING (professor_id) WHERE NOT list_contains(f1.tokens, x.t)), c2 AS (SELECT professor_id, paper_id, sum(w) AS c FROM rest GROUP BY ALL), m2 AS (SELECT professor_id, max(c) AS m FROM c2 GROUP BY ALL),
f2 AS (SELECT * FROM (SELECT it.professor_id, it.paper_id, row_number() OVER (PARTITION BY it.professor_id ORDER BY round(0.35::DOUBLE * opn + 0.25::DOUBLE * txt + 0.25::DOUBLE * con + 0.15::DOUBLE * coalesce(c / m, 0), 12) DESC, it.paper_id) AS rn
  FROM it LEFT JOIN c2 USING (professor_id, paper_id) LEFT JOIN m2 USING (professor_id) WHERE NOT EXISTS (SELECT 1 FROM f1 WHERE f1.professor_id = it.professor_id AND f1.paper_id = it.paper_id)) WHERE rn = 1)
SELECT professor_id, paper_id, 1 AS place FROM f1 UNION ALL SELECT professor_id, paper_id, 2 FROM f2"""


def queries():
    names = [
        first_seen_dedupe, collection_totals, screening_cascade, publication_years, author_projection, overlap_profiles, doi_title_conflict, author_name_conflict, work_consistency,
        pool_selected_focal, filter_grid, fk_antijoin, fk_antijoin_star, uniqueness, required_counts, selection_set_equality, unreferenced_full_outer, marker_check, secret_scan,
        private_name_scan, topic_name_scan, title_doi_conflict, error_report, replayed_authors, page_chain, representative_papers, candidate_pools, focal_pairs, margin_sampler, margin_targets,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    b = _B.format
    return {
        "first_seen_dedupe": f"WITH x AS (SELECT row_id, unnest(last_known_institutions) AS i, generate_subscripts(last_known_institutions, 1) AS pos FROM authors_page), y AS (SELECT {b('i.id')} AS institution, row_id, pos, i.display_name AS display_name, i.country_code AS c FROM x WHERE {b('i.id')} <> '') SELECT institution, arg_min(coalesce(display_name, chr(0)), [row_id, pos]) AS display_name, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS countries FROM y GROUP BY institution",
        "collection_totals": f"WITH w AS (SELECT nullif({b('id')}, '') AS work, type, language FROM works_page) SELECT count(*) AS n_fetched, count(*) FILTER (regexp_matches(work, '^W\\d+$')) AS n_valid, count(*) - count(*) FILTER (regexp_matches(work, '^W\\d+$')) AS n_invalid, count(*) FILTER (regexp_matches(work, '^W\\d+$')) - count(DISTINCT CASE WHEN regexp_matches(work, '^W\\d+$') THEN work END) AS n_duplicates, count(DISTINCT type) AS n_type, count(DISTINCT language) AS n_language FROM w",
        "screening_cascade": "SELECT CASE WHEN NOT coalesce(works_count >= 8, false) THEN 'few_works' WHEN len(list_filter(coalesce(last_known_institutions, []), lambda x: x.id IS NOT NULL)) = 0 THEN 'no_institution' WHEN len(list_filter(coalesce(topics, []), lambda x: x.id IS NOT NULL)) = 0 THEN 'no_topics' ELSE 'complete' END AS status, count(*) AS n_profiles FROM authors_page GROUP BY 1",
        "publication_years": "WITH y AS (SELECT row_id, list_transform(list_filter(counts_by_year, lambda x: x.works_count > 0 AND x.year BETWEEN 1500 AND 2100), lambda x: x.year) AS y FROM authors_page) SELECT row_id, list_min(y) AS first_year, list_max(y) AS last_year FROM y",
        "author_projection": f"SELECT row_id, nullif({b('id')}, '') AS author, trim(display_name) AS name, nullif({b('last_known_institutions[1].id')}, '') AS institution, last_known_institutions[1].country_code AS country, nullif({b('topics[1].id')}, '') AS topic, summary_stats.h_index AS h_index, coalesce(len(affiliations), 0)::INT AS n_affiliations FROM authors_page",
        "overlap_profiles": f"WITH {_WORKS}, x AS (SELECT DISTINCT work, author FROM wa WHERE author IS NOT NULL), s AS (SELECT work FROM x GROUP BY work HAVING count(*) > 1) SELECT author, count(*) AS n_shared FROM x SEMI JOIN s USING (work) GROUP BY author",
        "doi_title_conflict": f"WITH {_WORKS}, g AS (SELECT doi, count(DISTINCT tk) > 1 AS several_titles, count(*) AS n FROM wk WHERE doi IS NOT NULL AND tk IS NOT NULL GROUP BY doi) SELECT several_titles, count(*) AS n_dois, sum(n)::BIGINT AS n_works FROM g GROUP BY 1",
        "author_name_conflict": f"WITH {_WORKS} SELECT author, count(DISTINCT name) AS n_names FROM wa WHERE author IS NOT NULL AND name IS NOT NULL GROUP BY author HAVING count(DISTINCT name) > 1",
        "work_consistency": f"""WITH {_WORKS}, s AS (SELECT doi, count(DISTINCT work) AS n FROM wk WHERE doi IS NOT NULL GROUP BY doi), r AS (SELECT work, count(author) > count(DISTINCT author) AS rep FROM wa GROUP BY work),
            i AS (SELECT work, list_filter([CASE WHEN tk IS NULL THEN 'missing_title' END, CASE WHEN publication_year IS NULL THEN 'missing_year' END, CASE WHEN coalesce(s.n, 0) > 1 THEN 'shared_doi' END, CASE WHEN r.rep THEN 'repeated_author' END], lambda x: x IS NOT NULL) AS i FROM wk LEFT JOIN s USING (doi) LEFT JOIN r USING (work))
            SELECT work, array_to_string(i, ',') AS issues, CASE len(i) WHEN 0 THEN 'consistent' WHEN 1 THEN 'check' ELSE 'inconsistent' END AS status FROM i""",
        "pool_selected_focal": f"WITH {PAPERS_SQL} SELECT CASE WHEN focal THEN 'focal' WHEN selected THEN 'selected' ELSE 'pool' END AS role, count(*) AS n_papers FROM pp GROUP BY 1",
        "filter_grid": "WITH i AS (SELECT unnest(last_known_institutions) AS i FROM authors_page), c AS (SELECT DISTINCT i.country_code AS country FROM i WHERE i.country_code IS NOT NULL), t AS (SELECT DISTINCT i.type AS institution_type FROM i WHERE i.type IS NOT NULL) SELECT * FROM c, t",
        "fk_antijoin": _FK,
        "fk_antijoin_star": " UNION ALL ".join([_orphan_sql("customer_without_order", "c_custkey", "customer", "SELECT o_custkey AS x FROM orders"), _orphan_sql("line_without_order", "l_orderkey", "lineitem", "SELECT o_orderkey AS x FROM orders"), _orphan_sql("part_never_ordered", "p_partkey", "part", "SELECT l_partkey AS x FROM lineitem"), _orphan_sql("order_without_line", "o_orderkey", "orders", "SELECT l_orderkey AS x FROM lineitem")]),
        "uniqueness": _UNIQUE,
        "required_counts": f"WITH {PAPERS_SQL} {_COUNTS}",
        "selection_set_equality": f"""WITH {PAPERS_SQL}, a AS (SELECT professor_id, list_sort(list(paper_id)) AS s FROM pp WHERE selected GROUP BY ALL),
            b AS (SELECT professor_id, list_sort(list(paper_id)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY professor_id ORDER BY complexity_score DESC, paper_id) AS r FROM pp WHERE complexity_score IS NOT NULL) WHERE r <= 8 GROUP BY ALL)
            SELECT 'papers_differ' AS check_name, professor_id AS entity, coalesce(len(a.s), 0) || '/' || coalesce(len(b.s), 0) AS detail FROM a FULL JOIN b USING (professor_id) WHERE a.s IS DISTINCT FROM b.s""",
        "unreferenced_full_outer": f"WITH a AS (SELECT DISTINCT nullif({b('openalex_work_id')}, '') AS work FROM candidate_papers WHERE openalex_work_id IS NOT NULL), b AS (SELECT DISTINCT nullif({b('id')}, '') AS work FROM works_page WHERE id IS NOT NULL) SELECT CASE WHEN b.work IS NULL THEN 'only_left' WHEN a.work IS NULL THEN 'only_right' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.work = b.work WHERE coalesce(a.work, b.work) IS NOT NULL GROUP BY 1",
        "marker_check": "SELECT professor_id, count(*) AS n_rows, count(DISTINCT paper_id) AS n_papers, count(*) = count(DISTINCT paper_id) AS complete, strftime(min(collected_at), '%Y-%m-%d') AS first_day, strftime(max(collected_at), '%Y-%m-%d') AS last_day FROM candidate_papers WHERE professor_id IS NOT NULL GROUP BY professor_id",
        "secret_scan": r"""WITH t AS (SELECT source, text, lower(text) AS l FROM documents) SELECT source, count(*) AS n_documents, count(*) FILTER (
              regexp_matches(l, '(api[-_]?key|(access|auth)[-_]?token|password|secret)["'']?\s*[:=]\s*["'']?[a-z0-9_./+=-]{6}') OR regexp_matches(text, '\bsk-[A-Za-z0-9_-]{15,}[A-Za-z0-9_]\b')
              OR regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '-----BEGIN ((RSA|EC|OPENSSH) )?PRIVATE KEY-----')) AS n_suspect FROM t GROUP BY source""",
        "private_name_scan": _scan_sql("""SELECT display_name AS n FROM authors_page UNION SELECT unnest(display_name_alternatives) FROM authors_page UNION SELECT unnest(list_transform(authorships, lambda x: x.raw_author_name)) FROM works_page
            UNION SELECT unnest(list_transform(authorships, lambda x: x.author.display_name)) FROM works_page UNION SELECT unnest(authors) FROM evidence_papers""", True),
        "topic_name_scan": _scan_sql("SELECT DISTINCT n FROM (SELECT unnest(list_transform(topics, lambda x: x.display_name)) AS n FROM authors_page)"),
        "title_doi_conflict": f"WITH {_WORKS} SELECT tk, count(DISTINCT doi) AS n_dois, count(DISTINCT work) AS n_works FROM wk WHERE doi IS NOT NULL AND tk IS NOT NULL GROUP BY tk HAVING count(DISTINCT doi) > 1",
        "error_report": f"WITH {PAPERS_SQL} SELECT check_name, count(*) AS n_errors FROM ({_FK} UNION ALL {_UNIQUE} UNION ALL {_COUNTS}) GROUP BY check_name",
        "replayed_authors": f"WITH p AS (SELECT page_id, unnest(json_extract(payload, '$.results[*]')) AS r, generate_subscripts(json_extract(payload, '$.results[*]'), 1) AS i FROM raw_pages WHERE json_valid(payload)) SELECT page_id, (i - 1)::INT AS pos, {b('r->>' + repr('$.id'))} AS author, r->>'$.display_name' AS name FROM p WHERE {b('r->>' + repr('$.id'))} <> ''",
        "representative_papers": _greedy_sql([("recent", 3), ("influential", 2), ("diversifying", 2), ("random", 1)]),
        "candidate_pools": _greedy_sql([("recent", 10), ("influential", 6), ("diversifying", 4)]),
        "focal_pairs": _FOCAL,
        "margin_targets": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY professor_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS rn FROM professors WHERE professor_id IS NOT NULL) WHERE rn = 1),
            t AS (SELECT unnest(['cs_ai', 'psychology', 'biomedicine']) AS field, 4 AS target) SELECT t.field, t.target, least(count(p.professor_id), 4) AS achieved, greatest(4 - count(p.professor_id), 0) AS unmet FROM t LEFT JOIN p USING (field) GROUP BY ALL""",
        "page_chain": "WITH RECURSIVE p AS (SELECT CASE page_id WHEN 1 THEN '*' ELSE 'cursor-' || page_id END AS cur, payload->>'$.meta.next_cursor' AS nxt FROM raw_pages), c AS (SELECT '*' AS cursor, 0::BIGINT AS steps UNION ALL SELECT p.nxt, c.steps + 1 FROM c JOIN p ON p.cur = c.cursor WHERE p.nxt IS NOT NULL) SELECT * FROM c",
    }
