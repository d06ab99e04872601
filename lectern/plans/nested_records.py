"""Problem 2 over works_page, authors_page and raw_pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.columns import bare_id, clean, latest
from lectern.operators.nested import as_strings, field_type, flatten, parse_records
from lectern.sources.tables import table

_INSTITUTIONS = "array<struct<id: string, lineage: array<string>>>"
_AFFILIATIONS = "array<struct<institution: struct<id: string, lineage: array<string>>>>"


def _field(c: Column, kind: T.DataType | None, name: str) -> tuple[Column, T.DataType | None]:
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(c, f"$.{name}", "variant"), kind
    t = field_type(kind, name) if isinstance(kind, T.StructType) else None
    return (c.getField(name) if t is not None else F.lit(None).cast("string")), t


def _is_object(c: Column, kind: T.DataType | None) -> Column:
    return F.schema_of_variant(c).startswith("OBJECT") if isinstance(kind, T.VariantType) else c.isNotNull() & F.lit(isinstance(kind, T.StructType))


def _institution(c: Column, kind: T.DataType | None) -> Column:
    (i, _), (lineage, t) = _field(c, kind, "id"), _field(c, kind, "lineage")
    return F.when(_is_object(c, kind), F.struct(i.cast("string").alias("id"), as_strings(lineage, t).alias("lineage")))


def _each(c: Column, kind: T.DataType | None, read: Callable[[Column, T.DataType], Column]) -> Column:
    """``read`` of every element of an array; a single object is read as an array of one.  Where records differ in
    which of them they have, each is read by its own shape; anything else gives null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: read(x, kind.elementType))
    if not isinstance(kind, (T.StructType, T.VariantType)):
        return F.lit(None)
    one = F.when(_is_object(c, kind), F.array(read(c, kind)))
    if isinstance(kind, T.StructType):
        return one
    return F.coalesce(F.transform(F.try_variant_get(c, "$", "array<variant>"), lambda x: read(x, kind)), one)


def _from_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages").select("page_id", "retrieved_at", "payload")
    r = parse_records(pages, "payload", "$.results", ["page_id", "retrieved_at"])
    record, kind = F.col("record"), r.schema["record"].dataType
    last = _each(*_field(record, kind, "last_known_institutions"), _institution)
    aff = _each(*_field(record, kind, "affiliations"), lambda x, t: F.struct(_institution(*_field(x, t, "institution")).alias("institution")))
    return r.select(
        bare_id("record.id").alias("record_id"), "retrieved_at", (F.col("page_id") * 1_000_000 + F.col("ordinal")).alias("position"),
        last.cast(_INSTITUTIONS).alias("last_known_institutions"), aff.cast(_AFFILIATIONS).alias("affiliations"),
    )


def authors(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every author of either source; a record on a later page replaces an earlier one."""
    a = table(spark, d, "authors_page")
    own = a.select(
        bare_id("id").alias("record_id"), "retrieved_at", F.col("row_id").alias("position"),
        F.transform("last_known_institutions", lambda x: F.when(x.isNotNull(), F.struct(x["id"].alias("id"), x["lineage"].alias("lineage")))).alias("last_known_institutions"),
        F.transform("affiliations", lambda x: F.struct(F.when(x["institution"].isNotNull(), F.struct(x["institution"]["id"].alias("id"), x["institution"]["lineage"].alias("lineage"))).alias("institution"))).alias("affiliations"),
    )
    both = own.unionByName(_from_pages(spark, d)).filter("record_id IS NOT NULL")
    return latest(both, ["record_id"], ["retrieved_at", "position"], ["last_known_institutions", "affiliations"])


def works(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every work, cut down to what is linked."""
    w = table(spark, d, "works_page")
    cut = w.select(
        bare_id("id").alias("record_id"), "retrieved_at", "row_id", F.struct("ids.doi").alias("ids"),
        F.struct(F.struct("primary_location.source.id", "primary_location.source.display_name").alias("source")).alias("primary_location"),
        F.transform("authorships", lambda x: F.struct(F.struct(x["author"]["id"].alias("id")).alias("author"))).alias("authorships"),
    ).filter("record_id IS NOT NULL")
    return latest(cut, ["record_id"], ["retrieved_at", "row_id"], ["ids", "primary_location", "authorships"])


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All flat tables: ``author*`` and ``work*`` by path."""
    a = flatten(authors(spark, d), "record_id", {"last_known_institutions": ["id"], "affiliations": ["institution_id"]})
    w = flatten(works(spark, d), "record_id")
    return {f"author.{p}" if p else "author": t for p, t in a.items()} | {f"work.{p}" if p else "work": t for p, t in w.items()}


def links(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, path, parent_id, child_id) of all tables, distinct."""
    t = tables(spark, d)

    def rows(frame: DataFrame, path: str, parent: Column, child: Column) -> DataFrame:
        r = frame.select("record_id", F.lit(path).alias("path"), parent.alias("parent_id"), child.alias("child_id"))
        r = r.filter(F.col("parent_id").isNotNull() & F.col("child_id").isNotNull())
        return r.filter("parent_id <> child_id") if path.endswith(".lineage") else r

    record = F.col("record_id")
    doi = clean(F.regexp_extract(F.lower("ids_doi"), r"(10\..*)", 1))
    each = [
        rows(t["author.last_known_institutions"], "last_known_institutions", record, bare_id("id")),
        rows(t["author.last_known_institutions.lineage"], "last_known_institutions.lineage", bare_id("last_known_institutions_id"), bare_id("value")),
        rows(t["author.affiliations"], "affiliations.institution", record, bare_id("institution_id")),
        rows(t["author.affiliations.institution_lineage"], "affiliations.institution.lineage", bare_id("affiliations_institution_id"), bare_id("value")),
        rows(t["work"], "ids.doi", record, doi),
        rows(t["work"], "primary_location.source", record, F.coalesce(bare_id("primary_location_source_id"), clean("primary_location_source_display_name"))),
        rows(t["work.authorships"], "authorships.author", record, bare_id("author_id")),
    ]
    return reduce(DataFrame.unionByName, each).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


def p2_child_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and parents of every flat child table."""
    parts = [
        f.groupBy().agg(F.lit(path).alias("table_path"), F.count("*").alias("n_rows"), F.countDistinct("parent_key").alias("n_parents"), F.max("ordinal").alias("longest"))
        for path, f in tables(spark, d).items()
        if "parent_key" in f.columns
    ]
    return reduce(DataFrame.unionByName, parts)


_LATEST_AUTHOR = """
a0 AS (
  SELECT regexp_extract(id, '([^/]+)/*$', 1) AS record_id, retrieved_at, row_id AS position,
         list_transform(last_known_institutions, lambda x: CASE WHEN x IS NULL THEN NULL ELSE {'id': x.id, 'lineage': x.lineage} END) AS lki,
         list_transform(affiliations, lambda x: CASE WHEN x.institution IS NULL THEN NULL ELSE {'id': x.institution.id, 'lineage': x.institution.lineage} END) AS aff
  FROM authors_page),
p0 AS (
  SELECT page_id, retrieved_at, generate_subscripts(json_extract(payload, '$.results[*]'), 1) AS pos, unnest(json_extract(payload, '$.results[*]')) AS rec
  FROM raw_pages WHERE json_valid(payload)),
p1 AS (
  SELECT regexp_extract(rec->>'$.id', '([^/]+)/*$', 1) AS record_id, retrieved_at, page_id * 1000000 + pos AS position,
         list_transform(json_extract(rec, '$.last_known_institutions[*]'), lambda x: {'id': x->>'$.id', 'lineage':
            CASE WHEN json_type(x->'$.lineage') = 'VARCHAR' THEN [x->>'$.lineage'] ELSE CAST(x->'$.lineage' AS VARCHAR[]) END}) AS lki,
         list_transform(json_extract(rec, '$.affiliations[*]'), lambda x: {'id': x->>'$.institution.id', 'lineage':
            CASE WHEN json_type(x->'$.institution.lineage') = 'VARCHAR' THEN [x->>'$.institution.lineage'] ELSE CAST(x->'$.institution.lineage' AS VARCHAR[]) END}) AS aff
  FROM p0),
au AS (
  SELECT record_id, lki, aff FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY retrieved_at DESC, position DESC) AS rn
    FROM (SELECT * FROM a0 UNION ALL SELECT * FROM p1) WHERE record_id <> '') WHERE rn = 1),
wk AS (
  SELECT * FROM (
    SELECT regexp_extract(id, '([^/]+)/*$', 1) AS record_id, ids, primary_location, authorships,
           row_number() OVER (PARTITION BY regexp_extract(id, '([^/]+)/*$', 1) ORDER BY retrieved_at DESC, row_id DESC) AS rn
    FROM works_page) WHERE rn = 1 AND record_id <> ''),
l1 AS (SELECT record_id, unnest(lki) AS i FROM au),
l2 AS (SELECT record_id, unnest(aff) AS i FROM au),
m1 AS (SELECT record_id, i.id AS pid, unnest(i.lineage) AS cid FROM l1),
m2 AS (SELECT record_id, i.id AS pid, unnest(i.lineage) AS cid FROM l2),
wa AS (SELECT record_id, unnest(authorships) AS x FROM wk)
"""

P2_FOUND_ORACLE = (
    "WITH "
    + _LATEST_AUTHOR
    + """
SELECT DISTINCT record_id, path, parent_id, child_id FROM (
  SELECT record_id, 'last_known_institutions' AS path, record_id AS parent_id, nullif(trim(regexp_extract(i.id, '([^/]+)/*$', 1)), '') AS child_id FROM l1
  UNION ALL SELECT record_id, 'affiliations.institution', record_id, nullif(trim(regexp_extract(i.id, '([^/]+)/*$', 1)), '') FROM l2
  UNION ALL SELECT record_id, 'last_known_institutions.lineage', nullif(regexp_extract(pid, '([^/]+)/*$', 1), ''), nullif(regexp_extract(cid, '([^/]+)/*$', 1), '') FROM m1
  UNION ALL SELECT record_id, 'affiliations.institution.lineage', nullif(regexp_extract(pid, '([^/]+)/*$', 1), ''), nullif(regexp_extract(cid, '([^/]+)/*$', 1), '') FROM m2
  UNION ALL SELECT record_id, 'ids.doi', record_id, nullif(trim(regexp_extract(lower(ids.doi), '(10\\..*)', 1)), '') FROM wk
  UNION ALL SELECT record_id, 'primary_location.source', record_id,
    coalesce(nullif(regexp_extract(primary_location.source.id, '([^/]+)/*$', 1), ''), nullif(trim(primary_location.source.display_name), '')) FROM wk
  UNION ALL SELECT record_id, 'authorships.author', record_id, nullif(regexp_extract(x.author.id, '([^/]+)/*$', 1), '') FROM wa)
WHERE parent_id IS NOT NULL AND child_id IS NOT NULL AND NOT (path LIKE '%.lineage' AND parent_id = child_id)
"""
)


_COUNTED = "SELECT '{path}' AS table_path, count(*) AS n_rows, count(DISTINCT {parent}) AS n_parents, max(o)::INT AS longest FROM {rows}"  # a null element is a row

P2_CHILD_COUNTS_ORACLE = (
    "WITH "
    + _LATEST_AUTHOR
    + """,
n1 AS (SELECT record_id, unnest(lki) AS i, generate_subscripts(lki, 1) AS o FROM au), n2 AS (SELECT record_id, unnest(aff) AS i, generate_subscripts(aff, 1) AS o FROM au),
k1 AS (SELECT record_id || '/' || o AS p, unnest(i.lineage) AS c, generate_subscripts(i.lineage, 1) AS o FROM n1), k2 AS (SELECT record_id || '/' || o AS p, unnest(i.lineage) AS c, generate_subscripts(i.lineage, 1) AS o FROM n2),
n3 AS (SELECT record_id, unnest(authorships) AS i, generate_subscripts(authorships, 1) AS o FROM wk)
"""
    + " UNION ALL ".join(
        _COUNTED.format(path=path, parent=parent, rows=rows)
        for path, parent, rows in (
            ("author.last_known_institutions", "record_id", "n1"), ("author.last_known_institutions.lineage", "p", "k1"), ("author.affiliations", "record_id", "n2"),
            ("author.affiliations.institution_lineage", "p", "k2"), ("work.authorships", "record_id", "n3"),
        )
    )
)


def queries():
    return {"p2_found": p2_found, "p2_child_counts": p2_child_counts}


def oracle_sql():
    return {"p2_found": P2_FOUND_ORACLE, "p2_child_counts": P2_CHILD_COUNTS_ORACLE}
