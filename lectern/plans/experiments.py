"""The experiment with the stand-in model over evidence_papers and professors, and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.columns import clean, latest
from lectern.operators import experiment as E
from lectern.sources.tables import table
from lectern.storage import materialize
from lectern.streaming.bronze import deduplicated, windowed_events


def _abstracts(spark, d):
    e = table(spark, d, "evidence_papers").select("paper_key", "retrieved_at", clean("abstract").alias("abstract")).filter("paper_key IS NOT NULL")
    return latest(e, ["paper_key"], ["retrieved_at"], ["abstract"]).filter("abstract IS NOT NULL")


def experiment_design(spark, d):
    return E.design(table(spark, d, "professors").filter("professor_id IS NOT NULL"), "professor_id", [1, 2]).select("run_id", "condition", E.grounded("condition").alias("grounded"), E.verified("condition").alias("verified"))


def rendered_prompts(spark, d):
    """Prompts with their slots filled in; evidence only where the condition has it."""
    p = E.design(table(spark, d, "professors").filter("professor_id IS NOT NULL"), "professor_id", [1])
    prompt = E.render("Write to {{who}}.\n{{evidence}}", {"who": F.col("professor_id"), "evidence": F.when(E.grounded("condition"), F.concat(F.lit("Papers of "), "professor_id"))})
    return p.select("run_id", prompt.alias("prompt"))


def verified_abstracts(spark, d):
    """Abstracts after the verifying step, with their edits joined."""
    v = E.verify(_abstracts(spark, d), E.MockClient(), "paper_key", "abstract")
    return v.select("paper_key", F.col("out.text").alias("verified"), F.array_join(F.transform("out.edits", lambda e: e["action"]), ";").alias("actions"), "error")


def judged_claims(spark, d):
    """Claims extracted from abstracts and judged, by label."""
    c = materialize(E.extract_claims(_abstracts(spark, d), E.MockClient(), "paper_key", "abstract"), "mock-claims")
    return E.judge(c, E.MockClient(), "paper_key").groupBy("label").agg(F.count("*").alias("n_claims"))


def event_windows(spark, d):
    w = windowed_events(table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_dedupe(spark, d):
    return deduplicated(table(spark, d, "events"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


def queries():
    return {f.__name__: f for f in (experiment_design, rendered_prompts, verified_abstracts, judged_claims, event_windows, event_dedupe)}


def oracle_sql():
    p = "(SELECT DISTINCT professor_id FROM professors WHERE professor_id IS NOT NULL), (SELECT unnest(['A', 'B', 'C', 'D']) AS condition)"
    return {
        "experiment_design": f"SELECT professor_id || '_' || condition || '_' || seed AS run_id, condition, condition IN ('B', 'D') AS grounded, condition IN ('C', 'D') AS verified FROM {p}, (SELECT unnest([1, 2]) AS seed)",
        "rendered_prompts": f"SELECT professor_id || '_' || condition || '_1' AS run_id, 'Write to ' || professor_id || '.' || chr(10) || CASE WHEN condition IN ('B', 'D') THEN 'Papers of ' || professor_id ELSE '' END AS prompt FROM {p}",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "event_dedupe": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type",
    }
