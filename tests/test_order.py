from __future__ import annotations

import random

from pyspark.sql import functions as F

from simlake.operators.order import numbered, running_total


def test_numbers_and_sums_over_ranges(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "x int, w int").repartition(5)
    rows = numbered(df, ["x"], "i", 0).collect()
    assert all(r["i"] == r["x"] for r in rows) and len(rows) == 500
    sums = {r["x"]: r["s"] for r in running_total(df, ["x"], "s", F.col("w")).collect()}
    assert sums == {v: sum(u % 7 for u in range(v + 1)) for v in range(500)}
    assert numbered(df.where("false"), ["x"], "i").collect() == []
