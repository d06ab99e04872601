"""Writers: no-clobber publishing, immutable page store, fixed-column CSV, union of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def publish(df: DataFrame, path: str, kind: str = "json", force: bool = False) -> None:
    """Write a table that must not exist yet, or replace it with ``force``; the commit protocol makes it appear whole."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def results_csv(df: DataFrame, path: str, columns: Sequence[str], digits: int = 4) -> None:
    """Fixed columns in order, doubles rounded half to even, null as an empty cell."""
    kinds = dict(df.dtypes)
    cells = [F.bround(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*cells).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def union_of_columns(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sorted_keys(df: DataFrame) -> DataFrame:
    """``df`` with its columns and the fields of its structs, at every depth, in order of name: JSON with sorted keys."""

    def fix(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*[fix(c.getField(f.name), f.dataType).alias(f.name) for f in fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fix(x, kind.elementType))
        return c

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])


def write_marker(spark: SparkSession, path: str, values: dict[str, str]) -> bool:
    """Put down a completeness marker; True if it is new.  The same one again changes nothing, another one is an error."""
    marker = spark.createDataFrame(sorted(values.items()), "name string, value string")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        if {r.name: r.value for r in spark.read.schema(marker.schema).json(path).collect()} != values:
            raise ValueError(f"another marker stands at {path}")
        return False
    marker.coalesce(1).write.mode("errorifexists").json(path)
    return True


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table for a report; more rows than ``most`` are an error, so nothing large is collected."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def append_pages(df: DataFrame, path: str) -> int:
    """Append pages (request_hash, checksum, ...) that the store at ``path`` lacks; returns how many.

    A page that is there with another checksum is an error: stored pages never change.  Of equal new pages one is kept.
    """
    spark: SparkSession = df.sparkSession
    new = df.dropDuplicates(["request_hash", "checksum"])
    if not new.groupBy("request_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("pages of one request differ")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        stored = spark.read.schema(df.schema).parquet(path).select("request_hash", F.col("checksum").alias("stored"))
        joined = new.join(stored, "request_hash", "left")
        if not joined.filter("stored IS NOT NULL AND stored <> checksum").isEmpty():
            raise ValueError("a stored page would change")
        new = joined.filter("stored IS NULL").drop("stored").select(*df.columns)
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def split_public_private(df: DataFrame, key: str, private: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The public columns, and the map from ``key`` to the private ones."""
    return df.drop(*private), df.select(key, *private)
