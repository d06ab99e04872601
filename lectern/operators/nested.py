"""Problem 2: deeply nested records to flat tables that keep parent-child links.

``flatten`` walks a schema once on the driver and declares one DataFrame per array level: every element gets a
surrogate key made of its parent's key and its ordinal, so that links need no shuffle to be built.  Scalars of
structs become columns of their level.  Named columns of a level can be carried down to all levels below it, so a
grandchild can be linked to its parent's own id without joining the two tables again.

``parse_records`` turns JSON text whose records have different shapes into one typed frame: every text is parsed to
a variant, the merged schema of all of them is inferred by a distributed aggregate, and the variants are cast to it.
Where shapes of one field conflict, the field stays a variant and ``as_strings`` reads either shape.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _levels(struct: T.StructType, column: Column | None, prefix: str = ""):
    """Scalars and arrays of one level: (name, expression, type), structs opened up."""
    for f in struct.fields:
        c = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            yield from _levels(f.dataType, c, f"{name}_")
        else:
            yield name, c, f.dataType


def flatten(df: DataFrame, key: str, carry: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Tables by path; ``""`` is the table of records, ``a.b`` that of the elements of array b inside elements of array a.

    Every table has ``key`` (the record's own key).  Child tables also have ``parent_key``, ``element_key`` and
    ``ordinal`` (from 1); elements that are themselves scalars are in ``value``.  ``carry`` names, by path, columns
    that every deeper level also gets, as ``<path>_<column>`` with dots as underscores.

    Defined results: a null or empty array gives no rows; a null element gives a row with null columns, so that
    ordinals stay those of the source; a null struct gives null columns; a record with a null key keeps its row and
    its children have a null key; repeated elements are separate rows; an empty frame gives empty tables with the
    full set of columns; a nested column named like one of the working columns keeps its own name with a ``_`` added.
    """
    carry = dict(carry or {})
    reserved = {key, "parent_key", "element_key", "ordinal", "value"}
    tables: dict[str, DataFrame] = {}

    def level(frame: DataFrame, struct: T.StructType, element: Column | None, path: str, fixed: list[str], linked: bool) -> None:
        parts = [p for p in _levels(struct, element) if not (path == "" and p[0] in fixed)]
        flat = {n: (f"{n}_" if n in reserved or n in fixed else n) for n, *_ in parts}
        scalars = [c.alias(flat[n]) for n, c, t in parts if not isinstance(t, T.ArrayType)]
        tables[path] = frame.select(*fixed, *scalars)
        stem = path.replace(".", "_")
        carried = [c for c in fixed if c not in {"parent_key", "element_key", "ordinal"}]
        added = [c.alias(f"{stem}_{n}") for n, c, t in parts if n in carry.get(path, ())]
        parent = F.col("element_key") if linked else F.col(key).cast("string")
        for n, c, t in parts:
            if isinstance(t, T.ArrayType):
                below = f"{path}.{n}" if path else n
                child = frame.select(*carried, *added, parent.alias("parent_key"), F.posexplode(c).alias("__pos", "__element"))
                names = [x for x in child.columns if x not in {"__pos", "__element", "parent_key"}]
                child = child.select(
                    *names, "parent_key", F.concat("parent_key", F.lit(f"/{n}/"), (F.col("__pos") + 1).cast("string")).alias("element_key"),
                    (F.col("__pos") + 1).alias("ordinal"), "__element",
                )
                held = [*names, "parent_key", "element_key", "ordinal"]
                inner = t.elementType
                if isinstance(inner, T.StructType):
                    level(child, inner, F.col("__element"), below, held, True)
                elif isinstance(inner, T.ArrayType):
                    level(child, T.StructType([T.StructField("items", inner)]), F.struct(F.col("__element").alias("items")), below, held, True)
                else:
                    tables[below] = child.select(*held, F.col("__element").alias("value"))

    level(df, df.schema, None, "", [key], False)
    return tables


def _ddl(inferred: str) -> str:
    """Spark type of an inferred variant schema; a field never seen with a value is read as text."""
    return re.sub(r"\bVOID\b", "STRING", inferred.replace("OBJECT<", "STRUCT<"))


def parse_records(df: DataFrame, payload: str, array_path: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of the JSON array at ``array_path`` of ``payload``: ``keep``, ``ordinal``, struct ``record``.

    Defined results: text that is no JSON, is null, or has no such array (an error page) gives no rows; an element
    that is null or no object gives none either; unknown fields stay in the schema; a frame without any element
    gives an empty frame whose record has the single text field ``id``.
    """
    parsed = df.select(*keep, F.try_parse_json(payload).alias("__v"))
    each = parsed.select(*keep, F.posexplode(F.try_variant_get("__v", array_path, "array<variant>")).alias("__pos", "__record"))
    each = each.filter(F.col("__record").isNotNull() & F.schema_of_variant("__record").startswith("OBJECT"))
    inferred = each.agg(F.schema_of_variant_agg("__record")).first()[0]
    kind = _ddl(inferred) if inferred and inferred.startswith("OBJECT<") else "STRUCT<id: STRING>"
    return each.select(*keep, (F.col("__pos") + 1).alias("ordinal"), F.try_variant_get("__record", "$", kind).alias("record"))


def field_type(kind: T.DataType, path: str) -> T.DataType | None:
    """Type of a dotted path through structs and array elements, or None where it is absent."""
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def as_strings(c: Column, kind: T.DataType | None) -> Column:
    """``array<string>`` of a column that holds an array, one string, or either of them as a variant."""
    empty = F.lit(None).cast("array<string>")
    if kind is None:
        return empty
    if isinstance(kind, T.ArrayType):
        return c.cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.array(c))
    if isinstance(kind, T.VariantType):
        one = F.try_variant_get(c, "$", "string")
        return F.coalesce(F.try_variant_get(c, "$", "array<string>"), F.when(one.isNotNull(), F.array(one)))
    return empty
