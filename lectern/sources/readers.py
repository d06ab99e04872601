"""Readers for the file forms of the data: CSV of strings, JSON lines, JSON documents, whole texts, page stores."""

from __future__ import annotations

import dataclasses
import json
import os
import typing
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every cell a string; an empty cell is the empty string, never null."""
    df = spark.read.csv(path, header=True, inferSchema=False, emptyValue="", nullValue="\x00", multiLine=True, escape='"')
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, any other line that is no object is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    checked = F.when(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80)))))
    return lines.select(F.from_json(checked, schema).alias("r")).select("r.*")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, with the file's name without its extension in ``file_stem``."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file_stem"))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a .csv, .jsonl or .json file; nothing is raised for bad rows, they come back as errors.

    An empty table is an error of its own; a file of another kind gives no rows and one error.
    """
    errors = lambda df, what: df.select(F.lit(os.path.basename(path)).alias("table_name"), F.lit(what).alias("problem"), F.col("text").cast("string").alias("text"))
    none = spark.createDataFrame([], "text string")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        rows, bad = read_csv(spark, path), none
    elif kind in ("json", "jsonl"):
        if schema is None:
            raise ValueError("a JSON table needs a schema")
        source = spark.read.option("wholetext", kind == "json").text(path).filter(F.trim("value") != "")
        parsed = source.select(F.col("value").alias("text"), F.try_parse_json("value").alias("v"))
        if kind == "json":
            parsed = parsed.select("text", F.explode_outer(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
        is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
        rows = parsed.filter(is_object).select(F.from_json(F.to_json("v"), schema).alias("r")).select("r.*")
        bad = parsed.filter(~is_object).select("text")
    else:
        return spark.createDataFrame([], "text string"), errors(spark.createDataFrame([(path,)], "text string"), "unknown kind")
    problems = errors(bad, "not an object")
    if rows.isEmpty():
        problems = problems.unionByName(errors(spark.createDataFrame([("",)], "text string"), "empty"))
    return rows, problems


def read_mapping(path: str) -> tuple[dict, list[str]]:
    """(mapping, errors) of a small JSON file on the driver; nothing is raised, a file that is no mapping gives an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        return {}, [f"{path}: {e}"]
    return (found, []) if isinstance(found, dict) else ({}, [f"{path}: not a mapping"])


def typed_settings(found: dict, kind: type) -> tuple[object | None, list[str]]:
    """(settings, errors): a mapping as a dataclass; unknown and missing names and values of another type are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    hints = typing.get_type_hints(kind)
    problems = [f"unknown setting {n}" for n in found if n not in fields]
    for n, f in fields.items():
        if n not in found:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                problems.append(f"missing setting {n}")
        elif not (isinstance(found[n], hints[n]) or (hints[n] is float and type(found[n]) is int)) or (isinstance(found[n], bool) and hints[n] is not bool):
            problems.append(f"setting {n} is no {hints[n].__name__}")
    return (None, problems) if problems else (kind(**found), [])


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, text) of all files below ``path`` with one of the suffixes."""
    # Not the text source: with its one column pruned away (a count) it counts lines instead of files.
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").cast("string").alias("text"))
    return df.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def prompt_sections(text: str, names: Sequence[str]) -> dict[str, str]:
    """Sections of a prompt template: from a heading ``## name`` to the next heading or rule."""
    out = {}
    for name in names:
        _, found, rest = text.partition(f"## {name}\n")
        if not found:
            raise ValueError(f"no section {name}")
        ends = [i for i in (rest.find("\n## "), rest.find("\n---")) if i >= 0]
        out[name] = rest[: min(ends)].strip() if ends else rest.strip()
    return out


def checkbox_labels(df: DataFrame, text: str) -> DataFrame:
    """(claim_id, label) of a marked-up sheet ``[id] ... LABEL: x``; unlabelled claims are left out."""
    pairs = F.transform(F.split(F.col(text), r"(?m)^(?=\s*\[[^\]]+\])"), lambda p: F.struct(F.regexp_extract(p, r"^\s*\[([^\]]+)\]", 1).alias("claim_id"), F.trim(F.regexp_extract(p, r"LABEL:[ \t]*([^\n]*)", 1)).alias("label")))
    return df.select(F.explode(pairs).alias("x")).select("x.*").filter("claim_id <> '' AND label <> ''")
