"""Schema-driven projections: dropping fields by name at every depth, canonical ids, and content hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.columns import bare_id


def name_token(name: str) -> str:
    """A field name for comparing: NFKC, casefolded, letters and digits only."""
    return re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", name).casefold())


def _without(c: Column, kind: T.DataType, banned: Collection[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [_without(c.getField(f.name), f.dataType, banned).alias(f.name) for f in kind.fields if name_token(f.name) not in banned]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _without(x, kind.elementType, banned))
    return c


def drop_fields(df: DataFrame, banned: Sequence[str]) -> DataFrame:
    """``df`` without the fields of these names, at any depth of structs and arrays; spelling of case and marks aside.

    A null struct stays null; a struct of nothing but banned fields becomes null.
    """
    tokens = {name_token(b) for b in banned}
    return df.select(*[_without(F.col(f"`{f.name}`"), f.dataType, tokens).alias(f.name) for f in df.schema.fields if name_token(f.name) not in tokens])


def forbidden_fields(df: DataFrame, banned: Sequence[str]) -> list[str]:
    """Dotted paths of fields with banned names, for refusing a table that should be anonymous."""
    tokens, found = {name_token(b) for b in banned}, []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}" if path else f.name
                if name_token(f.name) in tokens:
                    found.append(here)
                walk(f.dataType, here)

    walk(df.schema, "")
    return found


def canonical_ids(df: DataFrame) -> DataFrame:
    """``df`` with every string field ``id``, ``*_id`` at any depth made bare, and every array ``lineage`` or ``*_ids``."""

    def fix(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            inner = "id" if name == "lineage" or name.endswith("_ids") else name
            return F.transform(c, lambda x: fix(x, kind.elementType, inner if isinstance(kind.elementType, T.StringType) else ""))
        return bare_id(c) if isinstance(kind, T.StringType) and (name == "id" or name.endswith("_id")) else c

    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns as JSON with sorted keys; null fields count as absent."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
