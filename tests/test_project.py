from pyspark.sql import functions as F

from lectern.operators.project import canonical_ids, content_hash, drop_fields, forbidden_fields

SCHEMA = "id string, `E-Mail` string, a struct<name: string, ok: int, in: array<struct<e_mail: string, work_id: string, ref_ids: array<string>>>>, b struct<NAME: string>"


def test_fields_are_dropped_at_every_depth(spark):
    df = spark.createDataFrame([("http://x/I1", "m", ("n", 1, [("q", "http://x/W2/", ["http://x/A3", None]), None]), ("z",)), (None, None, None, None)], SCHEMA)
    assert forbidden_fields(df, ["email", "name"]) == ["E-Mail", "a.name", "a.in.e_mail", "b.NAME"]
    out = drop_fields(df, ["email", "name"])
    assert forbidden_fields(out, ["email", "name"]) == [] and out.columns == ["id", "a", "b"]
    rows = canonical_ids(out.drop("b")).collect()
    assert rows[0].id == "I1" and rows[0].a["in"][0].work_id == "W2" and rows[0].a["in"][0].ref_ids == ["A3", None] and rows[0].a["in"][1] is None and rows[1].a is None


def test_hashes_ignore_column_order(spark):
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    assert df.select((content_hash(["a", "b"]) == content_hash(["b", "a"])).alias("x")).first().x and df.filter(F.length(content_hash(["a"])) != 64).count() == 0
