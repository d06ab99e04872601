"""Lexical features, normalisers and parsers over documents, works_page, evidence_papers and candidate_papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.columns import bare_id, clean, first_nonblank
from lectern.functions.labels import normalize_label
from lectern.functions.rank import midrank_place
from lectern.sources.tables import table

# Controlled indicator words and phrases, by kind.
TECHNICAL = (
    "algorithm", "accuracy", "bayesian", "benchmark", "benchmarks", "classification", "cohort", "cohorts", "corpus", "corpora", "dataset", "datasets", "embedding",
    "experiment", "experiments", "hypothesis", "inference", "intervention", "model", "models", "neural network", "optimization", "participant", "participants",
    "population", "populations", "randomized trial", "regression", "simulation", "statistical", "survey", "surveys",
)
METHOD = (
    "algorithm", "analysis", "bayesian", "case study", "experiment", "experiments", "interview", "interviews", "method", "methods", "model", "models", "neural network",
    "qualitative", "quantitative", "randomized trial", "randomised trial", "regression", "simulation", "survey", "surveys",
)
DATASET_OR_POPULATION = (
    "benchmark", "benchmarks", "cohort", "cohorts", "corpus", "corpora", "database", "databases", "dataset", "datasets", "patient", "patients", "participant",
    "participants", "population", "populations", "respondent", "respondents", "sample", "samples", "student", "students",
)
RESULT_OR_EXPERIMENT = (
    "accuracy", "effect", "effects", "evidence", "experiment", "experiments", "finding", "findings", "improved", "outcome", "outcomes", "result", "results",
    "significant", "significantly",
)
OBJECTIVE = ("aim", "aims", "evaluate", "evaluates", "examine", "examines", "hypothesize", "hypothesise", "investigate", "investigates", "objective", "we propose", "we study", "we test")
HEDGING = (
    "although", "appear", "appears", "approximately", "could", "however", "likely", "limitation", "limitations", "limited", "may", "might", "perhaps", "possible",
    "possibly", "suggest", "suggests",
)


def grams(ws, width: int = 2):
    """The words and every run of up to ``width`` words, joined by a blank."""

    def runs(k: int):
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - k + 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, k)]))

    return F.concat(ws, *[runs(k) for k in range(2, width + 1)])


def occurrences(gs, phrases):
    """Occurrences of all phrases together, overlapping ones too."""
    return F.size(F.filter(gs, lambda w: w.isin(*phrases)))


def indicators(gs, phrases):
    """Phrases that occur, in the order of the list."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.array_contains(gs, p))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", X.tokens("text").alias("ws"))


def _grams(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).filter(F.size("ws") > 0).select("doc_id", F.size("ws").alias("n"), grams(F.col("ws")).alias("gs"))


def lexical_features(spark, d):
    """Words, sentences and syllables of every document; documents without a word are left out."""
    f = _documents(spark, d).select("doc_id", F.size("ws").alias("n_words"), X.sentence_count("text").alias("n_sentences"), X.text_syllable_count("text").alias("n_syllables"))
    return f.filter("n_words > 0")


def flesch_kincaid(spark, d):
    f = lexical_features(spark, d)
    return f.select("doc_id", F.round(X.flesch_kincaid(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")), 6).alias("grade"))


def keyword_indicators(spark, d):
    """Counts of technical and hedging words and phrases, and their densities per 100 words."""
    f = _grams(spark, d).select("doc_id", "n", occurrences(F.col("gs"), TECHNICAL).alias("technical"), occurrences(F.col("gs"), HEDGING).alias("hedging"))
    return f.select("doc_id", "technical", "hedging", F.round(100.0 * F.col("technical") / F.col("n"), 6).alias("technical_density"), F.round(100.0 * F.col("hedging") / F.col("n"), 6).alias("hedging_density"))


def matched_indicators(spark, d):
    """Numbers of different indicators of each kind a document has, and its methods joined in list order."""
    f = _grams(spark, d)
    kinds = {"method": METHOD, "dataset_or_population": DATASET_OR_POPULATION, "result_or_experiment": RESULT_OR_EXPERIMENT, "objective": OBJECTIVE}
    out = f.select("doc_id", *[indicators(F.col("gs"), v).alias(k) for k, v in kinds.items()])
    return out.select("doc_id", *[F.size(k).alias(f"n_{k}") for k in kinds], F.array_join("method", "|").alias("methods"))


def markup_strip(spark, d):
    e = table(spark, d, "evidence_papers").select("paper_key", "abstract").filter("abstract IS NOT NULL").distinct()
    return e.select("paper_key", X.strip_markup("abstract").alias("plain"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").alias("n_words"))


def label_normalise(spark, d):
    return table(spark, d, "claim_labels").select("label_id", normalize_label("label").alias("label"))


def doi_and_title_keys(spark, d):
    w = table(spark, d, "works_page")
    return w.select("row_id", X.doi("ids.doi").alias("doi_key"), X.title_key("title").alias("title_key"))


def folded_titles(spark, d):
    """NFKC and casefold, which SQL has no function for."""
    return table(spark, d, "works_page").select("row_id", X.fold("title").alias("folded"))


def inverted_index_roundtrip(spark, d):
    """Titles to inverted indexes and back again."""
    w = table(spark, d, "works_page").select("row_id", F.trim(F.regexp_replace("title", r"(?U)\s+", " ")).alias("t")).filter("t <> ''")
    return w.select("row_id", F.size(X.inverted_index("t")).alias("n_distinct"), X.text_of_index(X.inverted_index("t")).alias("restored"))


def name_scrub(spark, d):
    """Professors' ids in claims replaced wherever they stand as whole words."""
    c = table(spark, d, "claims_to_label").select("row_id", "atomic_claim", "professor_id")
    names = F.array_compact(F.array("professor_id", F.concat(F.lit("Professor "), "professor_id")))
    return c.select("row_id", X.scrub(F.col("atomic_claim"), names, "[name]").alias("scrubbed"))


def coverage_tokens(spark, d):
    """topic:x and method:y tokens of each paper row, topics first, duplicates dropped."""
    c = table(spark, d, "candidate_papers").select("row_id", "topic_ids", "method_tags")
    part = lambda name, kind: F.transform(F.filter(F.split(F.coalesce(name, F.lit("")), r"\|"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(kind), F.trim(x)))
    return c.select("row_id", F.array_join(F.array_distinct(F.concat(part("topic_ids", "topic:"), part("method_tags", "method:"))), " ").alias("tokens"))


def multi_value_ids(spark, d):
    """Topic ids of a cell that is a JSON array or split at | , or ; with their prefix checked."""
    c = table(spark, d, "candidate_papers").select("row_id", F.col("topic_ids").alias("cell"))
    as_json = F.from_json("cell", "array<string>")
    pieces = F.when(F.col("cell").startswith("["), as_json).otherwise(F.split("cell", r"[|,;]"))
    return c.select("row_id", F.array_join(F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x.rlike(r"^T\d+$")), ",").alias("ids"))


def canonical_ids(spark, d):
    """Bare ids checked against their prefix, of works and of the first author."""
    w = table(spark, d, "works_page")
    checked = lambda c, p: F.when(bare_id(c).rlike(rf"^{p}\d+$"), bare_id(c))
    return w.select("row_id", checked("id", "W").alias("work_id"), checked(F.try_element_at("authorships", F.lit(1))["author"]["id"], "A").alias("first_author"))


def first_names_present(spark, d):
    """First source name that isn't blank: source, else landing page host, else none."""
    w = table(spark, d, "works_page")
    host = F.regexp_extract(F.coalesce("primary_location.landing_page_url", F.lit("")), r"^https?://([^/]+)", 1)
    return w.select("row_id", first_nonblank("primary_location.source.display_name", host, F.lit("none")).alias("venue"))


def tolerant_json(spark, d):
    """Replies with a code fence or prose around their JSON object, parsed all the same."""
    p = table(spark, d, "raw_pages").select("page_id", F.concat(F.lit("Here it is:\n```json\n"), "payload", F.lit("\n```")).alias("reply"))
    return p.select("page_id", F.try_variant_get(X.json_object("reply"), "$.meta.count", "long").alias("count_in_meta"))


PAPERS_PER_BLOCK = 8


def evidence_blocks(spark, d):
    """Papers of a professor as numbered blocks of text, in order of paper id, eight papers a block."""
    e = table(spark, d, "evidence_papers").select("professor_id", "paper_id", "paper_key", "title", "publication_year").filter("professor_id IS NOT NULL").distinct()
    line = F.concat(F.lit("["), "paper_id", F.lit("] "), F.coalesce(clean("title"), F.lit("untitled")), F.lit(" ("), F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d.")), F.lit(")"))
    placed = midrank_place(e, ["professor_id"], ["paper_id", "paper_key", "title", "publication_year"])
    placed = placed.select("professor_id", F.floor((F.col("place") - 1) / PAPERS_PER_BLOCK).alias("block_no"), F.struct("place", line.alias("line")).alias("x"))
    rows = F.array_sort(F.collect_list("x"))  # at most eight
    return placed.groupBy("professor_id", "block_no").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("block"))


def _phrases_sql(phrases):
    singles = ", ".join(f"'{p}'" for p in phrases if " " not in p)
    out = f"len(list_filter(ws, lambda w: w IN ({singles})))"
    for p in phrases:
        if " " in p:
            a, b = p.split()
            out += f" + len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{a}' AND ws[i + 1] = '{b}'))"
    return out


def _distinct_sql(phrases):
    parts = [f"(list_contains(ws, '{p}'))::INT" if " " not in p else "(len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{}' AND ws[i + 1] = '{}')) > 0)::INT".format(*p.split()) for p in phrases]
    return " + ".join(parts)


_WS = r"regexp_extract_all(lower(text), '\p{L}+(?:[''’\-]\p{L}+)*')"
_LEX = rf"""
WITH w AS (SELECT doc_id, {_WS} AS ws, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:["''”’)}}\]]+)?(?:\s|$)'))) AS n_sentences FROM documents),
s AS (SELECT doc_id, len(ws) AS n_words, n_sentences, list_sum(list_transform(ws, lambda w: greatest(1,
  len(regexp_extract_all(regexp_replace(strip_accents(w), '[^\p{{L}}]', '', 'g'), '[aeiouy]+'))
  - CASE WHEN regexp_matches(regexp_replace(strip_accents(w), '[^\p{{L}}]', '', 'g'), 'e$') AND NOT regexp_matches(regexp_replace(strip_accents(w), '[^\p{{L}}]', '', 'g'), '(le|ye)$')
      AND len(regexp_extract_all(regexp_replace(strip_accents(w), '[^\p{{L}}]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)))::INT AS n_syllables
  FROM w WHERE len(ws) > 0)
"""


def queries():
    names = [
        lexical_features, flesch_kincaid, keyword_indicators, matched_indicators, markup_strip, word_counts, label_normalise, doi_and_title_keys, folded_titles,
        inverted_index_roundtrip, name_scrub, coverage_tokens, multi_value_ids, canonical_ids, first_names_present, tolerant_json, evidence_blocks,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    label = "replace(replace(lower(trim(label)), ' ', '_'), '-', '_')"
    return {
        "lexical_features": _LEX + "SELECT * FROM s",
        "flesch_kincaid": _LEX + "SELECT doc_id, round(greatest(0, 0.39::DOUBLE * (n_words / n_sentences::DOUBLE) + 11.8::DOUBLE * (n_syllables / n_words::DOUBLE) - 15.59::DOUBLE), 6) AS grade FROM s",
        "keyword_indicators": f"WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, ({_phrases_sql(TECHNICAL)})::INT AS technical, ({_phrases_sql(HEDGING)})::INT AS hedging FROM w WHERE len(ws) > 0) "
        "SELECT doc_id, technical, hedging, round(100.0::DOUBLE * technical / n, 6) AS technical_density, round(100.0::DOUBLE * hedging / n, 6) AS hedging_density FROM c",
        "matched_indicators": f"WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents) SELECT doc_id, ({_distinct_sql(METHOD)})::INT AS n_method, ({_distinct_sql(DATASET_OR_POPULATION)})::INT AS n_dataset_or_population, ({_distinct_sql(RESULT_OR_EXPERIMENT)})::INT AS n_result_or_experiment, ({_distinct_sql(OBJECTIVE)})::INT AS n_objective, "
        + "concat_ws('|', " + ", ".join(f"CASE WHEN list_contains(ws, '{p}') THEN '{p}' END" if " " not in p else "CASE WHEN len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{}' AND ws[i + 1] = '{}')) > 0 THEN '{}' END".format(*p.split(), p) for p in METHOD) + ") AS methods FROM w WHERE len(ws) > 0",
        "markup_strip": r"SELECT DISTINCT paper_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract, '</?[A-Za-z][\w:.\-]*(?:\s[^<>]*)?>', ' ', 'g'), '\$[^$]*\\[^$]*\$', ' ', 'g'), '\\[A-Za-z]+', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM (SELECT DISTINCT paper_key, abstract FROM evidence_papers WHERE abstract IS NOT NULL)",
        "word_counts": r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(regexp_extract_all(regexp_replace(text, '[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}\x{2028}\x{2029}]', ' ', 'g'), '\S+')) END::INT AS n_words FROM documents",
        "label_normalise": f"SELECT label_id, CASE WHEN {label} IN ('supported', 'partially_supported', 'overstated', 'unsupported', 'contradicted', 'outside_evidence_scope', 'subjective_or_generic') THEN {label} END AS label FROM claim_labels",
        "doi_and_title_keys": r"SELECT row_id, nullif(trim(regexp_replace(lower(trim(ids.doi)), '^(?:https?://[^/]+/|doi:\s*)', '')), '') AS doi_key, nullif(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS title_key FROM works_page",
        "inverted_index_roundtrip": r"WITH t AS (SELECT row_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM works_page) SELECT row_id, len(list_distinct(string_split(t, ' ')))::INT AS n_distinct, t AS restored FROM t WHERE t <> ''",
        "name_scrub": "SELECT row_id, replace(replace(atomic_claim, 'Professor ' || professor_id, '[name]'), professor_id, '[name]') AS scrubbed FROM claims_to_label",
        "coverage_tokens": r"SELECT row_id, concat_ws(' ', (SELECT string_agg('topic:' || x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT trim(unnest(string_split(topic_ids, '|'))) AS x, generate_subscripts(string_split(topic_ids, '|'), 1) AS i) WHERE x <> '' GROUP BY x)), "
        r"(SELECT string_agg('method:' || x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT trim(unnest(string_split(method_tags, '|'))) AS x, generate_subscripts(string_split(method_tags, '|'), 1) AS i) WHERE x <> '' GROUP BY x))) AS tokens FROM candidate_papers",
        "multi_value_ids": r"SELECT row_id, array_to_string(list_filter(list_transform(regexp_split_to_array(topic_ids, '[|,;]'), lambda x: trim(x)), lambda x: regexp_matches(x, '^T\d+$')), ',') AS ids FROM candidate_papers",
        "canonical_ids": r"SELECT row_id, CASE WHEN regexp_matches(regexp_extract(id, '([^/]+)/*$', 1), '^W\d+$') THEN regexp_extract(id, '([^/]+)/*$', 1) END AS work_id, CASE WHEN regexp_matches(regexp_extract(authorships[1].author.id, '([^/]+)/*$', 1), '^A\d+$') THEN regexp_extract(authorships[1].author.id, '([^/]+)/*$', 1) END AS first_author FROM works_page",
        "first_names_present": r"SELECT row_id, coalesce(nullif(trim(primary_location.source.display_name), ''), nullif(regexp_extract(primary_location.landing_page_url, '^https?://([^/]+)', 1), ''), 'none') AS venue FROM works_page",
        "tolerant_json": "SELECT page_id, CASE WHEN json_valid(payload) THEN CAST(payload->'$.meta.count' AS BIGINT) END AS count_in_meta FROM raw_pages",
        "evidence_blocks": "WITH e AS (SELECT DISTINCT professor_id, paper_key, paper_id, title, publication_year FROM evidence_papers WHERE professor_id IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY professor_id ORDER BY paper_id NULLS FIRST, paper_key NULLS FIRST, title NULLS FIRST, publication_year NULLS FIRST) AS place FROM e) SELECT professor_id, (place - 1) // 8 AS block_no, string_agg('[' || paper_id || '] ' || coalesce(nullif(trim(title), ''), 'untitled') || ' (' || coalesce(publication_year::VARCHAR, 'n.d.') || ')', chr(10) ORDER BY place) AS block FROM p GROUP BY professor_id, block_no",
    }
