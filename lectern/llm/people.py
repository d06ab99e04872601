"""Bindings of problem 5 to authors_page, evidence_papers and professors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import bare_id, latest
from lectern.llm.names import parsed_names, similar_forms, star_clusters
from lectern.sources.tables import table
from lectern.storage import materialize

SAME_PLACE = 0.1
OWN_PAPER = 0.05
TIE = 1e-9


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, name) of all spellings in all rows of a profile; (id, orcid, places) of each profile."""
    a = table(spark, d, "authors_page").select(
        bare_id("id").alias("id"), bare_id("orcid").alias("orcid"), F.concat(F.array("display_name"), F.coalesce("display_name_alternatives", F.array().cast("array<string>"))).alias("names"),
        F.concat(F.coalesce(F.transform("last_known_institutions", lambda x: bare_id(x["id"])), F.array().cast("array<string>")), F.coalesce(F.transform("affiliations", lambda x: bare_id(x["institution"]["id"])), F.array().cast("array<string>"))).alias("places"),
    ).filter("id IS NOT NULL")
    names = a.select("id", F.explode("names").alias("name")).filter("name IS NOT NULL").distinct()
    orcids = a.groupBy("id").agg(F.max("orcid").alias("orcid"))
    # Distinct places only: a profile delivered any number of times gathers no more than it has places.
    places = a.select("id", F.explode("places").alias("place")).filter("place IS NOT NULL").distinct().groupBy("id").agg(F.collect_set("place").alias("places"))
    return names, orcids.join(places, "id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, professor's own profile) of the author entries of the latest row of each paper."""
    e = latest(table(spark, d, "evidence_papers").select("paper_key", "professor_id", "authors", "retrieved_at").filter("paper_key IS NOT NULL"), ["paper_key"], ["retrieved_at"], ["professor_id", "authors"])
    each = e.select("paper_key", "professor_id", F.posexplode("authors").alias("pos", "name")).filter("name IS NOT NULL")
    p = table(spark, d, "professors").select("professor_id", bare_id("openalex_author_id").alias("own"), "updated_at", "row_id").filter("professor_id IS NOT NULL")
    own = latest(p, ["professor_id"], ["updated_at", "row_id"], ["own"])
    return each.join(own, "professor_id", "left").select(F.concat(F.lit("E"), "paper_key", F.lit("-"), (F.col("pos") + 1).cast("string")).alias("id"), "name", "own")


def people(spark: SparkSession, d: str, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, center) of all profiles, and (id, center) of the entries that stand for one of them.

    ``all_links`` links every two profiles of similar names, which is quadratic in the profiles of a name; it is there to
    measure what linking with the best ones loses.
    """
    names, about = _profiles(spark, d)
    entries = materialize(_entries(spark, d), "people-entries")
    parsed = materialize(parsed_names(names.select("name").union(entries.select("name"))), "people-parsed")
    held = materialize(names.join(parsed, "name").select("id", "form", F.length("given").alias("n_given")).distinct(), "people-forms")
    typed = materialize(entries.join(parsed, "name").select("id", "own", "form"), "people-typed")
    about = materialize(about, "people-about")

    # A profile's rank decides who can be a centre: ORCID first, then more spellings, then a fuller given name.
    shape = held.groupBy("id").agg(F.max("n_given").alias("n_given"), F.count("*").alias("n_forms"))
    rank = about.join(shape, "id", "left").select(
        "id", "orcid", "places", F.struct(F.col("orcid").isNull().alias("no_orcid"), (-F.coalesce("n_forms", F.lit(0))).alias("f"), (-F.coalesce("n_given", F.lit(0))).alias("g")).alias("rank"))
    rank = materialize(rank, "people-rank")
    pairs = materialize(similar_forms(parsed), "people-pairs")
    forms = materialize(held.join(rank, "id").select("form", "id", "orcid", "places", "rank"), "people-held")

    # Profiles aren't linked with all others of a name but with the best ones: with and without an ORCID, and of each
    # place they share.  That is all a star needs, and it stays linear where one name belongs to very many.
    best = F.min_by("id", F.struct("rank", "id")).alias("b")
    every = forms.groupBy(F.col("form").alias("form_b"), F.col("orcid").isNull().alias("open")).agg(best).select("form_b", "b")
    local = forms.select("form", "id", "rank", F.explode("places").alias("place")).groupBy(F.col("form").alias("form_b"), "place", F.col("rank.no_orcid").alias("open")).agg(best).select("form_b", "place", "b")
    from_a = pairs.join(forms.select(F.col("form").alias("form_a"), F.col("id").alias("a"), "places"), "form_a")
    links = from_a.join(every, "form_b").select("a", "b", "score")
    if all_links:
        links = from_a.join(forms.select(F.col("form").alias("form_b"), F.col("id").alias("b")), "form_b").select("a", "b", "score")
    links = links.unionByName(from_a.select("form_b", "a", "score", F.explode("places").alias("place")).join(local, ["form_b", "place"]).select("a", "b", "score"))
    links = links.filter("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"))
    x, y = rank.select(F.col("id").alias("a"), F.col("orcid").alias("oa"), F.col("places").alias("pa")), rank.select(F.col("id").alias("b"), F.col("orcid").alias("ob"), F.col("places").alias("pb"))
    edges = links.join(x, "a").join(y, "b").filter("oa IS NULL OR ob IS NULL OR oa = ob")
    edges = edges.select("a", "b", (F.col("score") + F.when(F.col("oa") == F.col("ob"), 1.0).otherwise(0.0) + F.when(F.arrays_overlap("pa", "pb"), SAME_PLACE).otherwise(0.0)).alias("score"))
    first = rank.filter("orcid IS NOT NULL").groupBy("orcid").agg(best)
    same = rank.select("orcid", F.col("id").alias("a")).join(first, "orcid").filter("a <> b").select("a", "b", F.lit(2.0).alias("score"))
    edges = edges.unionByName(same)
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    stars = materialize(star_clusters(rank.select("id", "rank"), edges, "people-stars"), "people-centers")

    # An entry's best centre is that of its form, unless its paper's professor is one of the form's centres.
    placed = forms.select(F.col("form").alias("form_a"), F.col("id").alias("id")).join(stars, "id").select("form_a", "center").distinct()
    centers = materialize(pairs.join(placed, "form_a").groupBy(F.col("form_b").alias("form"), "center").agg(F.max("score").alias("score")), "people-form-centers")
    leading = centers.groupBy("form").agg(F.max("score").alias("top"))
    lead = centers.join(leading, "form").filter(F.col("score") >= F.col("top") - TIE).groupBy("form").agg(F.max("score").alias("score"), F.min("center").alias("center"), F.count("*").alias("n"))
    general = typed.join(lead, "form").select("id", "score", F.when(F.col("n") == 1, F.col("center")).alias("center"))
    own = typed.join(stars.select(F.col("id").alias("own"), F.col("center")), "own").join(centers, ["form", "center"]).select("id", (F.col("score") + OWN_PAPER).alias("score"), "center")
    scored = general.unionByName(own)
    top = scored.groupBy("id").agg(F.max("score").alias("top"))
    best = scored.join(top, "id").filter(F.col("score") >= F.col("top") - TIE).groupBy("id").agg(F.min("center").alias("center"), F.countDistinct("center").alias("n"), F.count_if(F.col("center").isNull()).alias("tied"))
    best = best.filter("n = 1 AND tied = 0").select("id", "center")
    return stars, best


def p5_people(spark: SparkSession, d: str) -> DataFrame:
    """One row per profile and per entry with a profile: the person (centre profile) it stands for."""
    stars, entries = people(spark, d)
    return stars.select("id", F.col("center").alias("person_id"), F.lit("profile").alias("kind")).unionByName(entries.select("id", F.col("center").alias("person_id"), F.lit("entry").alias("kind")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stars, entries = people(spark, d)
    a, b = stars.select("center", F.col("id").alias("id_a")), stars.select("center", F.col("id").alias("id_b"))
    profiles = a.join(b, "center").filter("id_a < id_b").select("id_a", "id_b")
    mixed = entries.withColumnRenamed("id", "e").join(a, "center").select(F.least("id_a", "e").alias("id_a"), F.greatest("id_a", "e").alias("id_b"))
    return profiles.unionByName(mixed)
