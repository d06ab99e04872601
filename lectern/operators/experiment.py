"""The generate, verify, extract and judge steps with a deterministic stand-in for the model, and the blinded batch.

A client is any object with ``complete(system, user, seed) -> str``; it is shipped to the workers, so real clients can
be used in its place.  Every step takes a frame and gives one back; a row whose call fails carries its error.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import clean

CONDITIONS = ("A", "B", "C", "D")  # B and D get the evidence, C and D are verified


def grounded(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin("B", "D")


def verified(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin("C", "D")


def final_text(original: str, checked: str, applied: Column) -> Column:
    """The verified text where verification was applied, else the original."""
    return F.when(applied, F.col(checked)).otherwise(F.col(original))


def final_text_or_original(original: str, checked: str) -> Column:
    """The variant that falls back to the original when the verified text is blank."""
    return F.coalesce(clean(checked), F.col(original))


def render(template: str, slots: dict[str, Column]) -> Column:
    """``{{slot}}`` replaced by its column; null as empty."""
    out = F.lit(template)
    for name, c in slots.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


class MockClient:
    """Replies that depend on nothing but the request, in the forms the steps expect."""

    def complete(self, system: str, user: str, seed: int) -> str:
        mark = hashlib.sha256(f"{system}\x00{user}\x00{seed}".encode()).hexdigest()
        if system == "verify":
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", user) if s]
            edits = [{"action": ("keep", "soften", "rewrite", "delete")[int(hashlib.sha256(s.encode()).hexdigest()[:2], 16) % 4], "text": s} for s in sentences]
            return "```json\n" + json.dumps({"edits": edits, "text": " ".join(e["text"] for e in edits if e["action"] != "delete")}) + "\n```"
        if system == "extract":
            return json.dumps({"claims": [s for s in re.split(r"(?<=[.!?])\s+", user) if len(s.split()) >= 4]})
        if system == "judge":
            labels = ("supported", "partially_supported", "overstated", "unsupported", "contradicted")
            return json.dumps({"labels": [{"n": i + 1, "label": labels[int(hashlib.sha256(c.encode()).hexdigest()[:2], 16) % 5]} for i, c in enumerate(user.split("\n"))]})
        return f"Dear colleague, {user.strip()[:120]} Kind regards, {mark[:6]}."


def object_in(reply: str) -> dict:
    """The JSON object of a reply that may be fenced or have prose around it."""
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    if not found:
        raise ValueError("no JSON object in the reply")
    return json.loads(found[0], strict=False)


def _call(client, system: str, text: str, key: str, seed: int, shape):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                try:
                    rows.append((k, shape(client.complete(system, t or "", seed)), None))
                except Exception as e:  # one failed cell must not end the run
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "out", "error"])

    return run


def call(df: DataFrame, client, system: str, key: str, text: str, kind: str, shape=lambda r: r, seed: int = 0) -> DataFrame:
    """(key, out, error) of one model step over all rows; ``shape`` turns a reply into a value of Spark type ``kind``."""
    t = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(_call(client, system, text, key, seed, shape), f"`{key}` {t}, out {kind}, error string")


def generate(df: DataFrame, client, key: str, prompt: str, seed: int = 0) -> DataFrame:
    return call(df, client, "write", key, prompt, "string", seed=seed)


def verify(df: DataFrame, client, key: str, text: str) -> DataFrame:
    """``out``: struct(text, edits)."""
    shape = lambda r: (lambda o: {"text": o["text"], "edits": o["edits"]})(object_in(r))
    return call(df, client, "verify", key, text, "struct<text: string, edits: array<struct<action: string, text: string>>>", shape)


def extract_claims(df: DataFrame, client, key: str, text: str) -> DataFrame:
    """One row per claim: (key, claim_id, claim); ids are numbered within the run."""
    out = call(df, client, "extract", key, text, "array<string>", lambda r: object_in(r)["claims"])
    each = out.filter("error IS NULL").select(key, F.posexplode("out").alias("pos", "claim"))
    return each.select(key, F.format_string("%s_c%02d", F.col(key).cast("string"), F.col("pos") + 1).alias("claim_id"), "claim")


def judge(claims: DataFrame, client, key: str) -> DataFrame:
    """(claim_id, label): the n-th label of a run belongs to its n-th claim; numbers out of range are dropped, of
    repeated numbers the last holds."""
    per = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim"))).alias("c"))  # the claims of one text
    asked = per.select(key, F.array_join(F.transform("c", lambda x: F.regexp_replace(x["claim"], r"\s+", " ")), "\n").alias("text"))
    out = call(asked, client, "judge", key, "text", "array<struct<n: int, label: string>>", lambda r: object_in(r)["labels"]).filter("error IS NULL")
    labels = out.select(key, F.posexplode("out").alias("pos", "x")).groupBy(key, F.col("x.n").alias("n")).agg(F.max_by("x.label", "pos").alias("label"))
    numbered = per.select(key, F.posexplode("c").alias("pos", "x")).select(key, (F.col("pos") + 1).alias("n"), "x.claim_id")
    return numbered.join(labels, [key, "n"]).select("claim_id", "label")


def blinded_order(run_ids: list[str], seed: int) -> list[tuple[str, str]]:
    """(run, blind id) in the order Python's own generator shuffles the sorted ids; E-0001 on."""
    order = sorted(run_ids)
    random.Random(seed).shuffle(order)
    return [(run, f"E-{i:04d}") for i, run in enumerate(order, 1)]


def design(professors: DataFrame, key: str, seeds: list[int]) -> DataFrame:
    """Every professor in every condition with every seed, by exploding two short literal lists."""
    d = professors.select(key).distinct().withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return d.withColumn("run_id", F.concat_ws("_", key, "condition", F.col("seed").cast("string")))
