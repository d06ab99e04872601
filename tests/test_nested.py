import datetime
import json

from pyspark.sql import functions as F

from lectern.operators.nested import as_strings, flatten, parse_records
from lectern.plans import nested_records

SCHEMA = "id string, ordinal int, name struct<first: string, n: int>, kids array<struct<id: string, tags: array<string>, home: struct<zip: string>>>, grid array<array<int>>"


def test_levels_links_and_ordinals(spark):
    data = [("r1", 9, ("x", 1), [("k1", ["a", None, "a"], ("z",)), None, ("k2", None, None)], [[1, 2], []]), ("r2", None, None, None, None), (None, 1, None, [("k3", [], None)], None)]
    t = flatten(spark.createDataFrame(data, SCHEMA).repartition(3), "id", {"kids": ["id"]})
    assert set(t) == {"", "kids", "kids.tags", "grid", "grid.items"}
    assert t[""].columns == ["id", "ordinal_", "name_first", "name_n"] and t[""].count() == 3
    kids = {(r.id, r.ordinal): r for r in t["kids"].collect()}
    assert set(kids) == {("r1", 1), ("r1", 2), ("r1", 3), (None, 1)} and kids["r1", 2].id_ is None and kids["r1", 1].home_zip == "z" and kids["r1", 1].parent_key == "r1"
    tags = [(r.parent_key, r.ordinal, r.value, r.kids_id) for r in t["kids.tags"].orderBy("ordinal").collect()]
    assert tags == [("r1/kids/1", 1, "a", "k1"), ("r1/kids/1", 2, None, "k1"), ("r1/kids/1", 3, "a", "k1")]
    assert [(r.parent_key, r.value) for r in t["grid.items"].orderBy("value").collect()] == [("r1/grid/1", 1), ("r1/grid/1", 2)]


def test_empty_frame_keeps_columns(spark):
    t = flatten(spark.createDataFrame([], SCHEMA), "id")
    assert all(f.count() == 0 for f in t.values()) and "home_zip" in t["kids"].columns


def test_records_of_different_shapes(spark):
    pages = ['{"results": [{"id": "a", "l": ["x", "y"], "new": {"q": 1}}, null, 5, {"id": "b", "l": "z"}]}', '{"results": [{"id": "c", "l": null}, {"l": []}]}', '{"error": "gone"}', "<html>", None, '{"results": null}', '{"results": {"id": "d"}}', ""]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, payload string")
    r = parse_records(df, "payload", "$.results", ["page"])
    kind = r.schema["record"].dataType
    got = {(x.page, x.ordinal): (x.id, x.l) for x in r.select("page", "ordinal", F.col("record.id").alias("id"), as_strings(F.col("record.l"), kind["l"].dataType).alias("l")).collect()}
    assert got == {(0, 1): ("a", ["x", "y"]), (0, 4): ("b", ["z"]), (1, 1): ("c", None), (1, 2): (None, [])}
    none = parse_records(df.filter("page > 2"), "payload", "$.results", ["page"])
    assert none.count() == 0 and none.schema["record"].dataType.names == ["id"]


def test_differing_shapes_of_institutions_keep_all_links(spark, tmp_path):
    def pages(name, *records):
        at = datetime.datetime(2026, 1, 1)
        rows = [(i, at, json.dumps({"results": [r]})) for i, r in enumerate(records)]
        spark.createDataFrame(rows, "page_id long, retrieved_at timestamp, payload string").write.parquet(str(tmp_path / name / "raw_pages.parquet"))
        out = {}
        for r in nested_records._from_pages(spark, str(tmp_path / name)).collect():
            pairs = lambda xs: xs if xs is None else [x and (x.id, x.lineage) for x in xs]
            out[r.record_id] = pairs(r.last_known_institutions), r.affiliations and pairs([x.institution for x in r.affiliations])
        return out

    i = lambda n, lineage=("I9",): {"id": f"I{n}", "lineage": list(lineage)}
    plain = {"id": "A1", "last_known_institutions": [i(1), None, i(2)], "affiliations": [{"institution": i(3)}, {"institution": None}]}
    read = [("I1", ["I9"]), None, ("I2", ["I9"])], [("I3", ["I9"]), None]
    other = {"id": "A2", "last_known_institutions": i(4), "affiliations": {"institution": i(5, ["I8", "I7"])}}
    assert pages("object", plain, other) == {"A1": read, "A2": ([("I4", ["I9"])], [("I5", ["I8", "I7"])])}
    assert pages("objects", other) == {"A2": ([("I4", ["I9"])], [("I5", ["I8", "I7"])])}
    assert pages("string", plain, {"id": "A2", "last_known_institutions": "none", "affiliations": "none"}) == {"A1": read, "A2": (None, None)}
    mixed = {"id": "A2", "last_known_institutions": ["x", {"id": "I4", "lineage": "I9"}], "affiliations": [{"institution": "x"}, {"institution": i(5)}]}
    assert pages("elements", plain, mixed) == {"A1": read, "A2": ([None, ("I4", ["I9"])], [None, ("I5", ["I9"])])}
    assert pages("plain", plain, {"id": "A2"}) == {"A1": read, "A2": (None, None)}
