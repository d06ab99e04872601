"""Rates, agreement and intervals over claims_to_label, claim_labels and events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.columns import latest
from lectern.functions.labels import LABELS, is_factual, is_severe, normalize_label
from lectern.functions.stats import clopper_pearson, fisher_exact, histogram_bootstrap, jeffreys
from lectern.functions.text import landis_koch, word_count
from lectern.operators import agreement, rates
from lectern.sources.tables import table


def r9(c):
    """Rounded to nine digits, so that the order of summation doesn't show."""
    return F.round(c, 9)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def claims(spark: SparkSession, d: str) -> DataFrame:
    """One row per claim (the last of its rows): condition, email, professor, field, normalised labels, words."""
    c = table(spark, d, "claims_to_label").filter("claim_id IS NOT NULL")
    kept = latest(c, ["claim_id"], ["row_id"], ["condition_hidden", "email_id", "professor_id", "label_annotator_1", "label_annotator_2", "final_label", "atomic_claim"])
    return kept.select(
        "claim_id", F.col("condition_hidden").alias("condition"), F.col("email_id").alias("email"), "professor_id", F.split("professor_id", "-")[0].alias("field"),
        normalize_label("label_annotator_1").alias("label_1"), normalize_label("label_annotator_2").alias("label_2"), normalize_label("final_label").alias("final"), F.col("label_annotator_1").alias("raw_1"),
        F.coalesce(word_count("atomic_claim"), F.lit(0)).alias("n_words"),
    )


def _words(c: DataFrame) -> DataFrame:
    return c.groupBy("email").agg(F.sum("n_words").alias("n_words"))


def severe_rate_by_condition(spark, d):
    c = claims(spark, d)
    return _rounded(rates.condition_metrics(c, _words(c), ["condition"], "email", "label_1"))


def severe_rate_any_label(spark, d):
    """The variant that takes every unknown spelling for a factual label."""
    c = claims(spark, d)
    return _rounded(rates.condition_metrics(c, _words(c), ["condition"], "email", "raw_1", blacklist=True).select("condition", "n_factual", "n_severe", "severe_error_rate"))


def label_rate(spark, d):
    return _rounded(rates.label_rates(claims(spark, d), ["condition"], "label_1", ["supported", "overstated", "unsupported"]))


def evaluator_by_condition(spark, d):
    c = claims(spark, d)
    both = c.select(F.lit("first").alias("evaluator"), "condition", "email", F.col("label_1").alias("label")).unionByName(c.select(F.lit("second").alias("evaluator"), "condition", "email", F.col("label_2").alias("label")))
    out = both.groupBy("evaluator", "condition").agg(F.count_if(is_factual("label")).alias("n_factual"), F.count_if(is_severe("label")).alias("n_severe"))
    return out.withColumn("severe_error_rate", r9(F.try_divide(F.col("n_severe").cast("double"), F.col("n_factual"))))


def field_by_condition_pivot(spark, d):
    """Severe and factual claims of every field under every condition there is, cells without a claim among them."""
    c = claims(spark, d).filter("condition IS NOT NULL AND field IS NOT NULL")
    n = {"severe": F.count_if(is_severe("label_1")), "factual": F.count_if(is_factual("label_1"))}
    wide = rates.wide_counts(c, "field", "condition", n)
    conditions = [x.removesuffix("_severe") for x in wide.columns if x.endswith("_severe")]
    cells = [F.struct(F.lit(x).alias("condition"), *[F.col(f"`{x}_{k}`").alias(k) for k in n]) for x in conditions]
    none = "array<struct<condition: string, severe: bigint, factual: bigint>>"
    return wide.select("field", F.explode(F.array(*cells).cast(none)).alias("x")).select("field", "x.*")


def _labelled(spark, d) -> DataFrame:
    """Labels of claim_labels with the claim's condition and email from the sheet; null where the sheet lacks the claim."""
    labels = table(spark, d, "claim_labels").select("claim_id", normalize_label("label").alias("label")).filter("claim_id IS NOT NULL")
    return labels.join(claims(spark, d).select("claim_id", "condition", "email"), "claim_id", "left")


def labels_by_condition(spark, d):
    """Labels of a second table by the condition of their claims, labels of unknown claims dropped."""
    known = _labelled(spark, d).filter("email IS NOT NULL")
    out = known.groupBy("condition").agg(F.count("*").alias("n_labels"), F.count_if(is_severe("label")).alias("n_severe"), F.count_if(is_factual("label")).alias("n_factual"))
    return out.withColumn("severe_error_rate", r9(F.try_divide(F.col("n_severe").cast("double"), F.col("n_factual"))))


def labels_all_known(spark, d):
    """The same join where a label of an unknown claim is an error that ends the query."""
    email = F.when(F.col("email").isNull(), F.raise_error(F.concat(F.lit("no such claim: "), "claim_id"))).otherwise(F.col("email"))
    return _labelled(spark, d).withColumn("email", email).groupBy("email").agg(F.count("*").alias("n_labels"))


def unlabelled_claims(spark, d):
    """Claims of the sheet that claim_labels has no label for, by condition."""
    labelled = table(spark, d, "claim_labels").select("claim_id").distinct()
    return claims(spark, d).join(labelled, "claim_id", "left_anti").groupBy("condition").agg(F.count("*").alias("n_claims"))


def leave_one_field_out(spark, d):
    c = claims(spark, d)
    per = c.groupBy("condition", "field").agg(F.count_if(is_severe("label_1")).alias("n_severe"), F.count_if(is_factual("label_1")).alias("n_factual"))
    out = rates.leave_one_out(per, "condition", "field", ["n_severe", "n_factual"])
    return out.withColumn("severe_error_rate", r9(F.try_divide(F.col("n_severe").cast("double"), F.col("n_factual"))))


def human_coverage(spark, d):
    c = claims(spark, d).filter("final IS NOT NULL")
    return c.groupBy("condition").agg(F.count("*").alias("n_claims"), F.count_if(is_factual("final")).alias("n_factual"), F.count_if(is_severe("final")).alias("n_severe"), F.countDistinct("email").alias("n_emails"))


def _edits(spark, d):
    """events as verifier edits: an action per event, runs by user and day, four conditions."""
    action = F.create_map(*[F.lit(x) for x in ("error", "delete", "click", "rewrite", "signup", "soften", "view", "keep", "purchase", "keep")])
    e = table(spark, d, "events")
    return e.select(F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("condition"), F.concat_ws("_", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run"), action[F.col("event_type")].alias("action"))


def edit_action_rates(spark, d):
    return _rounded(rates.edit_rates(_edits(spark, d), ["condition"], "action"))


def edit_rates_per_run(spark, d):
    """Delete rate of each run averaged by condition."""
    each = _edits(spark, d).groupBy("condition", "run").agg(F.try_divide(F.count_if(F.col("action") == "delete").cast("double"), F.count("*")).alias("x"))
    return each.groupBy("condition").agg(F.count("*").alias("n_runs"), r9(F.avg("x")).alias("mean_delete_rate"))


def run_metadata(spark, d):
    """De-identified runs: number of edits and their actions joined in order of name."""
    e = _edits(spark, d).groupBy("condition", "run", "action").agg(F.count("*").alias("n"))
    return e.groupBy("condition", "run").agg(F.sum("n").alias("n_edits"), F.array_join(F.array_sort(F.collect_list("action")), ";").alias("actions"))


def _pairs(spark, d):
    return claims(spark, d).select("claim_id", "label_1", "label_2")


def cohen_kappa(spark, d):
    out = agreement.cohen_kappa(_pairs(spark, d), "label_1", "label_2")
    return _rounded(out.select("n_pairs", "raw_agreement", "kappa")).withColumn("band", landis_koch(F.col("kappa")))


def kappa_wald_ci(spark, d):
    return _rounded(agreement.cohen_kappa(_pairs(spark, d), "label_1", "label_2").select("kappa", "kappa_se", "kappa_low", "kappa_high"))


def confusion_matrix(spark, d):
    return agreement.confusion_matrix(_pairs(spark, d), "label_1", "label_2", LABELS)


def per_label_prf(spark, d):
    c = claims(spark, d).filter("final IS NOT NULL")
    return _rounded(agreement.per_label_scores(c, "final", "label_1"))


def disagreement_direction(spark, d):
    return _rounded(agreement.disagreement(_pairs(spark, d), "label_1", "label_2"))


def rater_overlap(spark, d):
    """Claims labelled in both tables: the last label in claim_labels (ties to the larger id) against annotator 1."""
    more = table(spark, d, "claim_labels").select("claim_id", "labelled_at", "label_id", normalize_label("label").alias("label")).filter("label IS NOT NULL AND claim_id IS NOT NULL")
    last = latest(more, ["claim_id"], ["labelled_at", "label_id"], ["label"])
    both = last.join(claims(spark, d).select("claim_id", "label_1").filter("label_1 IS NOT NULL"), "claim_id")
    return both.agg(F.count("*").alias("n_shared"), F.count_if(F.col("label") == F.col("label_1")).alias("n_same"))


def judged_by_ordinal(spark, d):
    """Labels joined to an email's claims by ordinal: the n-th label to the claim numbered n; numbers out of range drop out."""
    c = claims(spark, d).select("email", "claim_id", F.regexp_extract("claim_id", r"_c(\d+)$", 1).try_cast("int").alias("n"), "label_2")
    judged = c.filter("label_2 IS NOT NULL AND n >= 1").groupBy("email", "n").agg(F.max_by("label_2", "claim_id").alias("judged"))
    return c.select("email", "n", "claim_id").join(judged, ["email", "n"]).groupBy("judged").agg(F.count("*").alias("n_claims"))


def _interval_schema(group: str, kind: str) -> str:
    return f"{group} {kind}, k long, n long, low double, high double"


def severe_interval(spark, d):
    """Exact interval of the severe-error rate by condition (a row per condition)."""
    per = claims(spark, d).groupBy("condition").agg(F.count_if(is_severe("label_1")).alias("k"), F.count_if(is_factual("label_1")).alias("n"))

    def run(frames):
        for f in frames:
            ci = [clopper_pearson(int(k), int(n)) for k, n in zip(f["k"], f["n"])]
            yield f.assign(low=[x for x, _ in ci], high=[x for _, x in ci])

    return per.mapInPandas(run, _interval_schema("condition", "string"))


def supported_interval(spark, d):
    """Jeffreys interval of the share of 'supported' that the second annotator confirms, by condition."""
    c = claims(spark, d).filter("label_1 = 'supported' AND label_2 IS NOT NULL")
    per = c.groupBy("condition").agg(F.count_if(F.col("label_2") == "supported").alias("k"), F.count("*").alias("n"))

    def run(frames):
        for f in frames:
            ci = [jeffreys(int(k), int(n)) for k, n in zip(f["k"], f["n"])]
            yield f.assign(low=[x for x, _ in ci], high=[x for _, x in ci])

    return per.mapInPandas(run, _interval_schema("condition", "string"))


def _bootstrap(spark, d, pooled: bool) -> DataFrame:
    c = claims(spark, d)
    each = rates.per_email(c, ["condition"], "email", "label_1").filter("n_factual > 0")
    units = each.groupBy("condition", "n_severe", "n_factual").agg(F.count("*").alias("n"))  # a row per pair of counts

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_severe", "n_factual"])
        k, f, n = (pdf[x].to_numpy(float) for x in ("n_severe", "n_factual", "n"))
        low, high = histogram_bootstrap(k, n, f, 10_000, 20260909) if pooled else histogram_bootstrap(k / f, n, np.ones_like(f), 2000, 42)
        point = (k * n).sum() / (f * n).sum() if pooled else (k / f * n).sum() / n.sum()
        return pd.DataFrame({"condition": [pdf["condition"].iloc[0]], "n_emails": [int(n.sum())], "point": [point], "low": [low], "high": [high]})

    return units.groupBy("condition").applyInPandas(run, "condition string, n_emails long, point double, low double, high double")


def bootstrap_ci(spark, d):
    """Percentile bootstrap of the mean of the emails' own rates."""
    return _bootstrap(spark, d, pooled=False)


def cluster_bootstrap_ci(spark, d):
    """Emails resampled as clusters, their claims pooled."""
    return _bootstrap(spark, d, pooled=True)


def condition_table(spark, d):
    """One row per condition: counts, severe-error rate with its exact and its cluster interval, density, email-level rate
    with its exact interval, rounded to four digits."""
    base = severe_rate_by_condition(spark, d)
    judged = rates.per_email(claims(spark, d), ["condition"], "email", "label_1").filter("n_factual > 0").groupBy("condition").agg(F.count("*").alias("n_judged"), F.count_if(F.col("n_severe") > 0).alias("n_email_severe"))
    boot = cluster_bootstrap_ci(spark, d).select("condition", F.col("low").alias("cluster_low"), F.col("high").alias("cluster_high"))
    wide = base.join(judged, "condition", "left").join(boot, "condition", "left").fillna(0, ["n_judged", "n_email_severe"])
    columns = ["exact_low", "exact_high", "email_low", "email_high"]

    def run(frames):
        for f in frames:
            ci = [(*clopper_pearson(int(k), int(n)), *clopper_pearson(int(e), int(m))) for k, n, e, m in zip(f["n_severe"], f["n_factual"], f["n_email_severe"], f["n_judged"])]
            yield f.assign(**{c: [x[i] for x in ci] for i, c in enumerate(columns)})

    kinds = ", ".join(f"{n} {t}" for n, t in wide.dtypes) + "".join(f", {c} double" for c in columns)
    out = wide.mapInPandas(run, kinds)
    return out.select(*[F.bround(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def fisher_deletions(spark, d):
    """Fisher's exact test of deletions against other edits, condition C against D."""
    e = _edits(spark, d).groupBy().agg(*[F.count_if((F.col("condition") == x) & (F.col("action") == "delete") if deleted else (F.col("condition") == x) & (F.col("action") != "delete")).alias(f"{x}{int(deleted)}") for x in "CD" for deleted in (True, False)])

    def run(frames):
        for f in frames:
            yield f.assign(p_value=[round(fisher_exact(*map(int, r)), 9) for r in f.itertuples(index=False)])

    return e.mapInPandas(run, "C1 long, C0 long, D1 long, D0 long, p_value double")




def _n(c: str) -> str:
    inner = f"replace(replace(lower(trim({c})), ' ', '_'), '-', '_')"
    return f"CASE WHEN {inner} IN ({', '.join(repr(x) for x in LABELS)}) THEN {inner} END"


_CLAIMS = f"""
cl AS (
  SELECT claim_id, condition_hidden AS condition, email_id AS email, professor_id, split_part(professor_id, '-', 1) AS field,
    {_n("label_annotator_1")} AS label_1, {_n("label_annotator_2")} AS label_2, {_n("final_label")} AS final, label_annotator_1 AS raw_1,
    coalesce(len(list_filter(regexp_split_to_array(atomic_claim, '\\s+'), lambda x: x <> '')), 0) AS n_words
  FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY row_id DESC) AS rn FROM claims_to_label WHERE claim_id IS NOT NULL) WHERE rn = 1)
"""
_FACT = "coalesce({c} IN ('supported', 'partially_supported', 'overstated', 'unsupported', 'contradicted'), false)"
_SEV = "coalesce({c} IN ('unsupported', 'contradicted'), false)"
_F1, _S1 = _FACT.format(c="label_1"), _SEV.format(c="label_1")
_EDITS = """
ed AS (
  SELECT ['A', 'B', 'C', 'D'][user_id % 4 + 1] AS condition, user_id || '_' || strftime(ts, '%Y-%m-%d') AS run,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rewrite' WHEN 'signup' THEN 'soften' WHEN 'view' THEN 'keep' WHEN 'purchase' THEN 'keep' END AS action
  FROM events)
"""
_KAPPA = f"""
WITH {_CLAIMS}, p AS (SELECT label_1 AS a, label_2 AS b FROM cl WHERE label_1 IS NOT NULL AND label_2 IS NOT NULL),
j AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j),
ra AS (SELECT a AS x, sum(n) AS n FROM j GROUP BY ALL), cb AS (SELECT b AS x, sum(n) AS n FROM j GROUP BY ALL),
m AS (SELECT x, coalesce(ra.n, 0) AS ra, coalesce(cb.n, 0) AS cb FROM ra FULL JOIN cb USING (x)),
s AS (SELECT t, (SELECT sum(n) FROM j WHERE a = b) / t AS po, (SELECT sum(ra * cb) FROM m) / (t * t) AS pe FROM t),
k AS (SELECT *, (po - pe) / (1 - pe) AS kappa FROM s),
v AS (
  SELECT sum(CASE WHEN j.a = j.b THEN j.n / t * power(1 - (ma.ra / t + mb.cb / t) * (1 - kappa), 2) ELSE 0 END) AS on_,
         sum(CASE WHEN j.a <> j.b THEN j.n / t * power(ma.cb / t + mb.ra / t, 2) ELSE 0 END) AS off_
  FROM j JOIN m ma ON j.a = ma.x JOIN m mb ON j.b = mb.x, k),
e AS (SELECT k.*, sqrt(greatest((on_ + power(1 - kappa, 2) * off_ - power(kappa - pe * (1 - kappa), 2)) / (t * power(1 - pe, 2)), 0)) AS se FROM k, v)
"""


def queries():
    names = [
        severe_rate_by_condition, severe_rate_any_label, label_rate, evaluator_by_condition, field_by_condition_pivot, leave_one_field_out, human_coverage,
        edit_action_rates, edit_rates_per_run, run_metadata, cohen_kappa, kappa_wald_ci, confusion_matrix, per_label_prf, disagreement_direction, rater_overlap, judged_by_ordinal,
        severe_interval, supported_interval, bootstrap_ci, cluster_bootstrap_ci, fisher_deletions, labels_by_condition, labels_all_known, unlabelled_claims, condition_table,
    ]
    return {f.__name__: f for f in names}


def oracle_sql():
    per_email = f"SELECT condition, email, count(*) AS c, count(*) FILTER ({_F1}) AS f, count(*) FILTER ({_S1}) AS s, count(*) FILTER (coalesce(label_1 = 'supported', false)) AS p, sum(n_words) AS w FROM cl GROUP BY ALL"
    return {
        "severe_rate_by_condition": f"""WITH {_CLAIMS}, w AS (SELECT email, sum(n_words) AS w FROM cl GROUP BY ALL), e AS ({per_email}), x AS (SELECT e.* EXCLUDE (w), w.w FROM e LEFT JOIN w USING (email))
            SELECT condition, count(*) AS n_emails, sum(c)::BIGINT AS n_claims, sum(f)::BIGINT AS n_factual, sum(s)::BIGINT AS n_severe, round(sum(s) / nullif(sum(f), 0)::DOUBLE, 9) AS severe_error_rate,
              round(sum(p) * 100.0::DOUBLE / nullif(sum(coalesce(w, 0)), 0), 9) AS supported_density, round(count(*) FILTER (s > 0 AND f > 0) / nullif(count(*) FILTER (f > 0), 0)::DOUBLE, 9) AS email_severe_rate
            FROM x GROUP BY condition""",
        "severe_rate_any_label": f"""WITH {_CLAIMS} SELECT condition, n_factual, n_severe, round(n_severe / nullif(n_factual, 0)::DOUBLE, 9) AS severe_error_rate FROM (
            SELECT condition, count(*) FILTER (raw_1 IS NOT NULL AND raw_1 NOT IN ('outside_evidence_scope', 'subjective_or_generic')) AS n_factual, count(*) FILTER ({_SEV.format(c="raw_1")}) AS n_severe FROM cl GROUP BY ALL)""",
        "label_rate": f"""WITH {_CLAIMS} SELECT condition, """ + ", ".join(f"round(count(*) FILTER (coalesce(label_1 = '{t}', false)) / nullif(count(*) FILTER ({_F1}), 0)::DOUBLE, 9) AS {t}_rate" for t in ("supported", "overstated", "unsupported")) + " FROM cl GROUP BY condition",
        "evaluator_by_condition": f"""WITH {_CLAIMS}, b AS (SELECT 'first' AS evaluator, condition, label_1 AS l FROM cl UNION ALL SELECT 'second', condition, label_2 FROM cl)
            SELECT evaluator, condition, count(*) FILTER ({_FACT.format(c="l")}) AS n_factual, count(*) FILTER ({_SEV.format(c="l")}) AS n_severe, round(n_severe / nullif(n_factual, 0)::DOUBLE, 9) AS severe_error_rate FROM b GROUP BY ALL""",
        "field_by_condition_pivot": f"""WITH {_CLAIMS}, c AS (SELECT * FROM cl WHERE condition IS NOT NULL AND field IS NOT NULL)
            SELECT f.field, k.condition, count(*) FILTER ({_S1}) AS severe, count(*) FILTER ({_F1}) AS factual
            FROM (SELECT DISTINCT field FROM c) f CROSS JOIN (SELECT DISTINCT condition FROM c) k LEFT JOIN c ON c.field = f.field AND c.condition = k.condition GROUP BY ALL""",
        "fisher_deletions": f"""WITH {_EDITS}, n AS (SELECT count(*) FILTER (condition = 'C' AND action = 'delete') AS C1, count(*) FILTER (condition = 'C' AND action <> 'delete') AS C0, count(*) FILTER (condition = 'D' AND action = 'delete') AS D1, count(*) FILTER (condition = 'D' AND action <> 'delete') AS D0 FROM ed),
            m AS (SELECT *, C1 + C0 AS r, D1 + D0 AS q, C1 + D1 AS k FROM n), x AS (SELECT m.*, unnest(range(greatest(0, k - q), least(k, r) + 1)) AS i FROM m),
            l AS (SELECT *, lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(q + 1) - lgamma(k - i + 1) - lgamma(q - k + i + 1) - lgamma(r + q + 1) + lgamma(k + 1) + lgamma(r + q - k + 1) AS lp FROM x), o AS (SELECT lp AS seen FROM l WHERE i = C1)
            SELECT C1, C0, D1, D0, round(least(1, sum(exp(lp)) FILTER (lp <= seen + 1e-7)), 9) AS p_value FROM l, o GROUP BY ALL""",
        "labels_by_condition": f"""WITH {_CLAIMS}, j AS (SELECT condition, {_n("label")} AS l FROM claim_labels JOIN cl USING (claim_id) WHERE email IS NOT NULL)
            SELECT condition, count(*) AS n_labels, count(*) FILTER ({_SEV.format(c="l")}) AS n_severe, count(*) FILTER ({_FACT.format(c="l")}) AS n_factual, round(n_severe / nullif(n_factual, 0)::DOUBLE, 9) AS severe_error_rate FROM j GROUP BY condition""",
        "labels_all_known": f"WITH {_CLAIMS} SELECT email, count(*) AS n_labels FROM claim_labels JOIN cl USING (claim_id) GROUP BY email",
        "unlabelled_claims": f"WITH {_CLAIMS} SELECT condition, count(*) AS n_claims FROM cl WHERE claim_id NOT IN (SELECT claim_id FROM claim_labels WHERE claim_id IS NOT NULL) GROUP BY condition",
        "leave_one_field_out": f"""WITH {_CLAIMS}, p AS (SELECT condition, field, count(*) FILTER ({_S1}) AS s, count(*) FILTER ({_F1}) AS f FROM cl GROUP BY ALL), t AS (SELECT condition, sum(s) AS s, sum(f) AS f FROM p GROUP BY ALL)
            SELECT condition, field, (t.s - p.s)::BIGINT AS n_severe, (t.f - p.f)::BIGINT AS n_factual, round((t.s - p.s) / nullif(t.f - p.f, 0)::DOUBLE, 9) AS severe_error_rate FROM p JOIN t USING (condition)""",
        "human_coverage": f"WITH {_CLAIMS} SELECT condition, count(*) AS n_claims, count(*) FILTER ({_FACT.format(c='final')}) AS n_factual, count(*) FILTER ({_SEV.format(c='final')}) AS n_severe, count(DISTINCT email) AS n_emails FROM cl WHERE final IS NOT NULL GROUP BY condition",
        "edit_action_rates": f"WITH {_EDITS} SELECT condition, count(*) AS n_edits, count(*) FILTER (action = 'delete') AS n_deleted, round(count(*) FILTER (action = 'delete') / count(*)::DOUBLE, 9) AS delete_rate, round(count(*) FILTER (action IN ('rewrite', 'soften')) / count(*)::DOUBLE, 9) AS rewrite_rate FROM ed GROUP BY condition",
        "edit_rates_per_run": f"WITH {_EDITS}, r AS (SELECT condition, run, count(*) FILTER (action = 'delete') / count(*)::DOUBLE AS x FROM ed GROUP BY ALL) SELECT condition, count(*) AS n_runs, round(avg(x), 9) AS mean_delete_rate FROM r GROUP BY condition",
        "run_metadata": f"WITH {_EDITS} SELECT condition, run, count(*) AS n_edits, string_agg(DISTINCT action, ';' ORDER BY action) AS actions FROM ed GROUP BY ALL",
        "cohen_kappa": _KAPPA + "SELECT t::BIGINT AS n_pairs, round(po, 9) AS raw_agreement, round(kappa, 9) AS kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < .21 THEN 'slight' WHEN kappa < .41 THEN 'fair' WHEN kappa < .61 THEN 'moderate' WHEN kappa < .81 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k",
        "kappa_wald_ci": _KAPPA + "SELECT round(kappa, 9) AS kappa, round(se, 9) AS kappa_se, round(kappa - 1.959963984540054 * se, 9) AS kappa_low, round(kappa + 1.959963984540054 * se, 9) AS kappa_high FROM e",
        "confusion_matrix": f"WITH {_CLAIMS}, l AS (SELECT unnest([{', '.join(repr(x) for x in LABELS)}]) AS label) SELECT label, " + ", ".join(f"count(*) FILTER (label_2 = '{x}') AS {x}" for x in LABELS) + ", count(label_2) AS row_total FROM l LEFT JOIN cl ON cl.label_1 = l.label AND cl.label_2 IS NOT NULL GROUP BY label",
        "per_label_prf": f"""WITH {_CLAIMS}, p AS (SELECT final AS a, label_1 AS b FROM cl WHERE final IS NOT NULL AND label_1 IS NOT NULL), l AS (SELECT a AS label FROM p UNION SELECT b FROM p),
            s AS (SELECT label, count(*) FILTER (a = label AND b = label) AS h, count(*) FILTER (b = label) AS g, count(*) FILTER (a = label) AS t FROM l, p GROUP BY label), q AS (SELECT label, h / nullif(g, 0)::DOUBLE AS pr, h / nullif(t, 0)::DOUBLE AS rc FROM s)
            SELECT label, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr IS NULL OR rc IS NULL THEN NULL WHEN pr = 0 OR rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 9) AS f1 FROM q""",
        "disagreement_direction": f"""WITH {_CLAIMS}, p AS (SELECT label_1 AS a, label_2 AS b, {_S1} AS hs, {_SEV.format(c="label_2")} AS ms FROM cl WHERE label_1 IS NOT NULL AND label_2 IS NOT NULL)
            SELECT count(*) FILTER (a = b) AS agree, count(*) FILTER (a <> b AND hs AND NOT ms) AS lenient, count(*) FILTER (a <> b AND NOT hs AND ms) AS strict, count(*) FILTER (a <> b AND hs = ms) AS orthogonal,
              count(*) FILTER (hs AND b IN ('outside_evidence_scope', 'subjective_or_generic')) AS dropped_severe, round(count(*) FILTER (a = 'supported' AND b = 'supported') / nullif(count(*) FILTER (b = 'supported'), 0)::DOUBLE, 9) AS supported_precision FROM p""",
        "rater_overlap": f"""WITH {_CLAIMS}, m AS (SELECT claim_id, label, row_number() OVER (PARTITION BY claim_id ORDER BY labelled_at DESC NULLS LAST, label_id DESC) AS rn FROM (SELECT claim_id, labelled_at, label_id, {_n("label")} AS label FROM claim_labels) WHERE label IS NOT NULL AND claim_id IS NOT NULL)
            SELECT count(*) AS n_shared, count(*) FILTER (label = label_1) AS n_same FROM m JOIN cl USING (claim_id) WHERE rn = 1 AND label_1 IS NOT NULL""",
        "judged_by_ordinal": f"""WITH {_CLAIMS}, c AS (SELECT email, claim_id, TRY_CAST(regexp_extract(claim_id, '_c(\\d+)$', 1) AS INT) AS n, label_2 FROM cl), j AS (SELECT email, n, arg_max(label_2, claim_id) AS judged FROM c WHERE label_2 IS NOT NULL AND n >= 1 GROUP BY ALL)
            SELECT judged, count(*) AS n_claims FROM c JOIN j USING (email, n) GROUP BY judged""",
    }
