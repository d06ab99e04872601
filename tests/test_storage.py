import os

from lectern.storage import materialize, scope


def folders(spark):
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/lectern"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_tables_are_deleted_when_their_scope_ends(spark):
    before = folders(spark)
    with scope():
        outer = materialize(spark.range(3), "outer")
        with scope():
            assert materialize(spark.range(5), "inner").count() == 5 and len(folders(spark)) == len(before) + 2
        assert outer.count() == 3 and len(folders(spark)) == len(before) + 1
    assert folders(spark) == before
