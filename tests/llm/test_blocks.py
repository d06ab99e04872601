import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.blocks import bucket_pairs


def every(a, b):
    return np.ones(len(a["name"]), bool)


@pytest.mark.parametrize("rows_a_batch", [7, 10_000])
def test_a_crowded_bucket_is_split_and_loses_nothing(spark, rows_a_batch):
    key = F.when(F.col("id") < 150, 1).when(F.col("id") < 160, 2).otherwise(F.col("id")).cast("long")
    p = spark.range(200).select(key.alias("key"), F.col("id").alias("name"), F.lit(0).cast("long").alias("side"))
    p = p.unionByName(p.filter("name % 3 = 0"))  # repeated postings
    want = [(i, j) for lo, hi in ((0, 150), (150, 160)) for i in range(lo, hi) for j in range(i + 1, hi)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        for block in (5, 20, 149, 150, 1000):
            met = bucket_pairs(p, "key", "name", block, every, "t").collect()
            assert sorted(map(tuple, met)) == want
        odd = bucket_pairs(p, "key", "name", 20, lambda a, b: (a["name"] + b["name"]) % 2 == 1, "t").collect()
        assert sorted(map(tuple, odd)) == [(i, j) for i, j in want if (i + j) % 2]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bucket_pairs(p.limit(0), "key", "name", 20, every, "t").count() == 0
