from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.functions import sql
from simlake.functions import vectors as V
from simlake.operators import scoring
from simlake.operators.asof import asof_join
from simlake.plans import extensions
from simlake.plans.common import database, query_set


@pytest.mark.parametrize("within", [None, 5.0])
@pytest.mark.parametrize("partitions", ["4", "23"])
def test_asof_equals_a_scan(spark, within, partitions):
    """One key holds half of both sides, times tie, keys and times are NULL, rows repeat."""
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None, "left only"])
    left = [(i % 300, key(), rng.choice([float(rng.randrange(60)), None])) for i in range(320)]
    right = [(rng.choice(["hot", "hot", "a", "b", None, "right only"]), rng.choice([float(rng.randrange(60)), None]), i) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = asof_join(spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, at double, r int"), ["k"], "t", "at", ["r"], within).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def want(k, t):
        met = [(at, r) for k2, at, r in right if k is not None and k2 == k and None not in (t, at) and at <= t and (within is None or t - at <= within)]
        return max(met) if met else (None, None)

    assert sorted(map(tuple, got), key=str) == sorted(((i, k, t, *want(k, t)) for i, k, t in left), key=str)


def test_asof_of_empty_sides_and_clashes(spark):
    left, right = spark.createDataFrame([(1, "a", 2.0)], "id int, k string, t double"), spark.createDataFrame([], "k string, at double, r int")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "t", "at").collect()] == [(1, "a", 2.0, None, None)]
    assert asof_join(left.where("id > 1"), right, ["k"], "t", "at").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, right.withColumnRenamed("r", "ID"), ["k"], "t", "at")


def test_sql_functions_equal_the_expressions(spark):
    sql.register(spark)
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(20)] + [([0.0] * 5, [1.0] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    v, w = F.col("a"), F.col("b")
    pairs = [("vector_dot(a, b)", V.dot(v, w)), ("vector_norm(a, 3D)", V.p_norm(v, 3)), ("unit_vector(a)", V.unit(v)), ("signed_power(a, 0.5D)", V.signed_power(v, 0.5)), ("p_normalised(a, 2D)", V.normalised(v)), ("hellinger(transform(a, x -> abs(x)))", V.hellinger(F.transform(v, F.abs))), ("vector_cosine(a, b)", V.similarity("cosine")(v, w))]
    for text, column in pairs:
        for r in df.select(F.expr(text).alias("x"), column.alias("y")).collect():
            assert (r["x"] is None and r["y"] is None) or np.allclose(r["x"], r["y"], atol=1e-12), text


def test_table_function_in_lateral_joins(spark):
    sql.register_extractor(spark, "halves", lambda v: None if len(v) == 1 else np.reshape(v, (-1, 2)), 2)
    spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0]), (3, None), (4, [])], "id int, v array<double>").createOrReplaceTempView("bags")
    assert [tuple(r) for r in spark.sql("SELECT id, d.* FROM bags, LATERAL halves(v) d ORDER BY id, desc").collect()] == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]
    sql.register_extractor(spark, "wrong", lambda v: np.zeros((1, 3)), 2)
    with pytest.raises(Exception, match="width 2"):
        spark.sql("SELECT * FROM bags, LATERAL wrong(v) d").collect()


def test_the_index_query_finds_what_brute_force_finds(spark, sf):
    got = {(r["q"], r["id"]) for r in extensions.idx1_search(spark, sf).collect()}
    want = {(r["q"], r["id"]) for r in scoring.top_k(query_set(spark, sf), database(spark, sf), 10).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_functions_of_one_vector_are_computed_before_the_pairs(spark, sf):
    from simlake.plans import extensions

    found = extensions.sql1_functions(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "sqrt" not in above.lower() and "power" not in above.lower()
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shuffled and "hashpartitioning(label" not in shuffled
