from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.operators import evaluate, scoring


def ranked(spark, rel):
    return spark.createDataFrame([(1, i, 1.0 / (i + 1), i + 1, r) for i, r in enumerate(rel)], "q long, id long, sim double, rank int, rel int")


@pytest.mark.parametrize(("by", "k", "want"), [("retrieved", None, 5 / 9), ("retrieved", 3, 7 / 12), ("k", None, 5 / 18), ("k", 3, 7 / 18)])
def test_average_precision_of_the_worked_example(spark, by, k, want):
    got = evaluate.mean_average_precision(ranked(spark, [0, 1, 1, 0, 0, 1]), by, k).first()["map"]
    assert got == pytest.approx(want)


def test_all_denominators_and_cuts_in_one_pass(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(q, i, 0.0, i + 1, int(rng.integers(2)) * (q > 0)) for q in range(12) for i in range(7)], "q long, id long, sim double, rank int, rel int")
    totals = df.groupBy("q").agg({"rel": "sum"}).withColumnRenamed("sum(rel)", "n_relevant")
    got = {(r["denominator"], r["k"]): r["map"] for r in evaluate.mean_average_precisions(df, (None, 3)).collect()}
    assert len(got) == 6
    for (by, k), value in got.items():
        assert value == pytest.approx(evaluate.mean_average_precision(df, by, k or None, totals).first()["map"])


def test_whole_scores_in_blocks_are_the_same_and_their_mean_too(spark):
    m = np.random.default_rng(8).normal(size=(23, 4))
    whole, blocks = (sorted((r["q"], r["id"], round(r["sim"], 9)) for r in scoring.scores(frame(spark, "q", m), frame(spark, "id", m), block_bytes=b).collect()) for b in (1 << 20, 200))
    assert whole == blocks and len(whole) == 23 * 23
    below = [s for q, i, s in whole if q > i]
    assert scoring.mean_of_pairs(frame(spark, "id", m)).first()["mean"] == pytest.approx(np.mean(below), abs=1e-8)
    assert scoring.mean_of_pairs(frame(spark, "id", m[:1])).first()["mean"] is None


def test_no_relevant_row_gives_zero_and_no_query_null(spark):
    assert evaluate.mean_average_precision(ranked(spark, [0, 0])).first()["map"] == 0
    assert evaluate.mean_average_precision(ranked(spark, [])).first()["map"] is None


def test_map_at_one_is_top_one_accuracy(spark):
    rng = np.random.default_rng(3)
    rows = [(q, i, 0.0, i + 1, int(rng.integers(2))) for q in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "q long, id long, sim double, rank int, rel int")
    assert evaluate.mean_average_precision(df, k=1).first()["map"] == pytest.approx(evaluate.top_k_accuracy(df, 1).first()["accuracy"])


def frame(spark, key, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, v array<double>")


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("block", [64 << 20, 64])
def test_top_k_equals_a_full_sort(spark, k, block):
    rng = np.random.default_rng(0)
    q, d = rng.integers(-2, 3, (7, 4)), rng.integers(-2, 3, (40, 4))  # small integers: many ties
    got = {}
    for r in scoring.ranked(scoring.scores(frame(spark, "q", q), frame(spark, "id", d), "cosine", k, block), k).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    s = np.round(unit(q.astype(float)) @ unit(d.astype(float)).T, 9)
    for i in range(7):
        want = sorted(range(40), key=lambda j: (-s[i, j], j))[:k]
        assert [j for _, j in sorted(got[i])] == want


def test_a_zero_vector_has_cosine_zero_and_nan_ranks_last(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [-1.0, 0.0])], "id long, v array<double>")
    rows = scoring.top_k(frame(spark, "q", [[1, 0]]), d, 3).orderBy("rank").collect()
    assert [(r["id"], r["sim"]) for r in rows] == [(1, 0.0), (3, -1.0), (2, None)]


def test_single_query_equals_batched(spark):
    rng = np.random.default_rng(1)
    d = frame(spark, "id", rng.random((30, 5)))
    v = rng.random(5)
    one = [r["id"] for r in scoring.most_similar(v.tolist(), d, 4).collect()]
    assert one == [r["id"] for r in scoring.top_k(frame(spark, "q", [v]), d, 4).orderBy("rank").collect()]


def test_user_similarity_of_two_vectors_or_of_matrices(spark):
    q, d = frame(spark, "q", [[1, 2], [3, 4]]), frame(spark, "id", [[1, 1], [2, 0]])
    pairs = scoring.scores(q, d, lambda a, b: float(np.max(np.abs(np.ravel(a) - np.ravel(b))))).collect()
    whole = scoring.scores(q, d, lambda a, b: np.abs(a[:, None] - b[None]).max(-1)).collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, whole))


def test_refusals(spark):
    q = frame(spark, "q", [[1, 2]])
    d = frame(spark, "id", [[1, 2]])
    for call in (lambda: scoring.scores(q, d, "nothing"), lambda: scoring.scores(q, d, k=0), lambda: scoring.most_similar([1.0, 2.0], d, 0), lambda: scoring.scores(frame(spark, "q", [[1]]), d), lambda: evaluate.top_k_accuracy(q, 0), lambda: scoring.scores(q, d, lambda a, b: np.zeros(3))):
        with pytest.raises(ValueError):
            call()
    rel = scoring.top_k(q, d, 1)
    with pytest.raises(Exception, match="no label"):
        evaluate.with_relevance(rel, spark.createDataFrame([(0, 1)], "q long, label int"), spark.createDataFrame([(9, 1)], "id long, label int")).collect()


def test_a_missing_query_counts_as_a_miss(spark):
    q = spark.createDataFrame([(1,), (2,)], "q long")
    assert evaluate.top_k_accuracy(ranked(spark, [1]), 1, q).first()["accuracy"] == 0.5


def test_mean_below_the_diagonal_of_one_row_is_null(spark):
    assert evaluate.mean_below_diagonal(spark.createDataFrame([(0, 0, 1.0)], "q long, id long, sim double")).first()["mean"] is None


@pytest.mark.parametrize("block_bytes", [scoring.BLOCK_BYTES, 5000])
def test_ranks_by_counting_equal_the_ranking(spark, block_bytes):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(90, 4)).round(0)  # many ties, and a zero vector
    base[5] = 0
    rows = [(int(i), int(i % 4), v.tolist()) for i, v in enumerate(base)] + [(500, 0, [float("nan"), 1.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(5)
    q = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[:12]] + [(77, 9, [1.0, 0.0, 0.0, 0.0])], "q long, label int, v array<double>")
    whole = evaluate.with_relevance(scoring.ranked(scoring.scores(q, d)), q, d)
    want = sorted((r["q"], r["id"], r["rank"]) for r in whole.where("rel = 1").collect())
    found = scoring.relevant_ranks(q, d, block_bytes=block_bytes)
    got = sorted((r["q"], r["id"], r["rank"]) for r in found.collect())
    assert got == want
    for ks in ((None, 3, 50),):
        plain = {tuple(r)[:2]: r["map"] for r in evaluate.mean_average_precisions(whole, ks).collect()}
        counted = {tuple(r)[:2]: r["map"] for r in evaluate.mean_average_precisions_by_counting(found, q, d, ks).collect()}
        assert counted == pytest.approx(plain)
    with pytest.raises(Exception, match="no label for id 3"):
        scoring.relevant_ranks(q, d.withColumn("label", F.expr("case when id <> 3 then label end"))).collect()


def test_means_of_scores_without_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))] + [(60, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = scoring.scores(df.selectExpr("id as q", "v").where("q < 9"), df).agg(F.avg("sim")).first()[0]
    assert scoring.mean_score(df.where("id < 9"), df).first()["mean"] == pytest.approx(want)
    pairs = scoring.scores(df.selectExpr("id as q", "v"), df).where("q > id").agg(F.avg("sim")).first()[0]
    assert scoring.mean_of_pairs(df).first()["mean"] == pytest.approx(pairs)
    assert scoring.mean_of_pairs(df.where("id = 1")).first()["mean"] is None
    twice = df.unionAll(df.where("id = 1"))
    assert scoring.mean_of_pairs(twice).first()["mean"] == pytest.approx(scoring.scores(twice.selectExpr("id as q", "v"), twice).where("q > id").agg(F.avg("sim")).first()[0])


def test_ranks_leave_the_relevant_pairs_to_the_tasks(spark, monkeypatch):
    """The driver gets queries, never pairs: what ``toArrow`` brings does not grow with the relevant pairs."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng, brought, whole = np.random.default_rng(4), [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: brought.append(t := whole(self)) or t)
    d = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(rng.normal(size=(400, 3)).tolist())], "id long, label int, v array<double>")
    found = scoring.relevant_ranks(d.where("id < 20").withColumnRenamed("id", "q"), d)
    assert sum(t.num_rows for t in brought) == 20
    assert found.count() == 20 * 200


@pytest.mark.parametrize("metric", ["cosine", "neg_euclidean"])
def test_ranks_of_any_metric_and_of_queries_without_a_label(spark, metric):
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate((9 * rng.normal(size=(70, 3))).round(0).tolist())], "id long, label int, v array<double>").repartition(6)
    q = d.where("id < 9").selectExpr("id as q", "case when id <> 2 then label end as label", "v")
    whole = scoring.ranked(scoring.scores(q, d, metric)).join(q.selectExpr("q", "label as l"), "q").join(d.select("id", "label"), "id").where("l = label")
    assert sorted(tuple(r)[:3] for r in scoring.relevant_ranks(q, d, metric).collect()) == sorted((r["q"], r["id"], r["rank"]) for r in whole.collect())


def test_sums_of_lines_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, v) for i, v in enumerate([*rng.normal(size=(40, 3)).tolist(), [0.0, 0.0, 0.0]])], "id long, v array<double>").repartition(3)
    q = d.where("id % 8 = 0").withColumnRenamed("id", "q")
    want = {r["q"]: (r["n"], pytest.approx(r["s"])) for r in scoring.scores(q, d).groupBy("q").agg(F.count("*").alias("n"), F.sum("sim").alias("s")).collect()}
    monkeypatch.setattr(scoring, "scores", None)
    assert {r["q"]: (r["n"], r["total"]) for r in scoring.line_sums(q, d).collect()} == want
    odd = d.unionAll(spark.createDataFrame([(99, [float("nan"), 1.0, 1.0])], d.schema))
    assert {(r["n"], r["total"]) for r in scoring.line_sums(q, odd).collect()} == {(42, None)}


def test_lines_of_the_heat_map_make_no_matrix(spark, sf, monkeypatch):
    from simlake.plans import analysis

    sizes, whole = [], scoring.scores
    monkeypatch.setattr(scoring, "scores", lambda q, d, *rest: sizes.append(d.count()) or whole(q, d, *rest))
    assert analysis.snk5_heatmap(spark, sf).count() == 500
    assert sizes == [4]


def test_nearest_by_products_are_those_of_the_differences(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(scoring, "FIRST", 16)
    for q, d in ((rng.normal(size=(9, 5)), rng.normal(size=(300, 5))), (1e6 + rng.normal(size=(9, 5)), 1e6 + rng.normal(size=(300, 5)).round(1)), (np.ones((4, 3)), np.ones((50, 3))), (np.full((2, 3), np.nan), rng.normal(size=(40, 3)))):
        got, want = (t.to_pydict() for t in (scoring._nearest(np.arange(len(q)), q, np.arange(len(d)), d, 7), scoring._best(np.arange(len(q)), np.arange(len(d)), scoring._neg_distances(q, d), 7)))
        assert sorted(zip(*got.values(), strict=True), key=str) == sorted(zip(*want.values(), strict=True), key=str)


def test_nearest_neighbours_subtract_few_rows(spark, monkeypatch):
    monkeypatch.setattr(scoring, "_distances", None)
    d = np.random.default_rng(1).normal(size=(200, 3))
    parts = list(scoring._parts(np.arange(5), d[:5], np.arange(200), d, scoring.MATRICES["neg_euclidean"], 3))
    assert [p.num_rows for p in parts] == [15]


def test_many_queries_deal_the_database_out(spark):
    own = np.random.default_rng(1).normal(size=(1100, 2))
    d = frame(spark, "id", own).coalesce(1)
    sizes = scoring.scores(frame(spark, "q", own), d, k=1).groupBy(F.spark_partition_id()).count()
    assert sizes.count() == 2 * spark.sparkContext.defaultParallelism


def test_user_similarity_of_a_vector_and_a_matrix(spark, recwarn):
    calls = []

    def near(a, b):
        calls.append(np.ndim(b))
        return np.minimum(a, b).sum(-1)

    applied = scoring.checked(near)
    assert not [w for w in recwarn if "pair by pair" in str(w.message)]
    calls.clear()
    q, d = np.random.default_rng(0).random((3, 4)), np.random.default_rng(1).random((6, 4))
    assert applied(q, d).tolist() == [[float(np.minimum(x, y).sum()) for y in d] for x in q]
    assert calls == [2, 2, 2]


def test_scores_are_made_in_small_parts():
    d = np.ones((10_000, 2))
    sizes = [p.num_rows for p in scoring._parts(np.arange(300), d[:300], np.arange(10_000), d, scoring.MATRICES["cosine"], None)]
    assert sum(sizes) == 3_000_000 and max(sizes) * 8 <= 4 << 20


def test_whole_scores_repeat_their_ids_within_a_page_of_a_file():
    d = np.random.default_rng(3).normal(size=(10_000, 2))
    parts = list(scoring._parts(np.arange(30), d[:30], np.arange(10_000), d, scoring.MATRICES["euclidean"], None))
    q, i, s = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in range(3))
    assert sorted(zip(q.tolist(), i.tolist(), strict=True)) == [(a, b) for a in range(30) for b in range(10_000)]
    assert np.array_equal(s, np.sqrt(((d[i] - d[q]) ** 2).sum(1)))
    assert all(len(np.unique(i[a : a + 20_000])) <= 2 * scoring.STRETCH for a in range(0, 280_000, 20_000))


@pytest.mark.parametrize("width", [100, 32])  # sim4_pipeline_scores, sim3_encoder_scores
def test_memory_of_whole_scores_does_not_follow_the_queries(width):
    d, most = np.ones((2_000, width)), []
    for n in (1, 1_000, 8_000):  # the first imports what the others need
        q = np.ones((n, width))
        tracemalloc.start()
        rows = sum(p.num_rows for p in scoring._parts(np.arange(n), q, np.arange(len(d)), d, scoring.MATRICES["cosine"], None))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n * len(d)
    assert max(most[1:]) < 32 << 20 and most[2] < 1.2 * most[1]


@pytest.mark.parametrize("block_bytes", [scoring.BLOCK_BYTES, 200])
def test_whole_scores_of_several_metrics_are_those_of_each(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(scoring, "RUN", 50)
    monkeypatch.setattr(scoring, "TURN", 3)
    m = np.random.default_rng(5).normal(size=(37, 4))
    m[3] = 0
    m[7, 0] = np.nan
    q, d = frame(spark, "q", m[:23]), frame(spark, "id", m)
    rows = scoring.whole_scores(q, d, (("euclidean", "neg_euclidean", "dot"), ("manhattan",), ("cosine",)), block_bytes).collect()
    assert len(rows) == 5 * 23 * 37
    nine = lambda s: None if s is None else round(s, 9) + 0.0
    for name in ("euclidean", "neg_euclidean", "dot", "manhattan", "cosine"):
        want = {(r["q"], r["id"]): nine(r["sim"]) for r in scoring.scores(q, d, name).collect()}
        assert {(r["q"], r["id"]): nine(r["sim"]) for r in rows if r["metric"] == name} == want
    assert scoring.whole_scores(q.where("q < 0"), d).count() == scoring.whole_scores(q, d.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        scoring.whole_scores(q, d, (("nothing",),))


def test_the_matrix_is_written_with_equal_scores_together(spark, sf):
    from simlake.plans import retrieval

    runs = {}
    for r in retrieval.sim2_matrix(spark, sf).withColumn("part", F.spark_partition_id()).collect():
        runs.setdefault(r["part"], []).append(r["sim"])
    assert sum(map(len, runs.values())) == 250_000
    assert all(s == sorted(s) for s in runs.values())


def test_runs_are_given_in_small_parts():
    d = np.random.default_rng(3).normal(size=(1_500, 64))
    parts = list(scoring._runs(np.arange(1_500), d, np.arange(1_500), d, (("cosine",),)))
    assert sum(p.num_rows for p in parts) == 2_250_000 and max(p.num_rows for p in parts) * 8 <= scoring.PART_BYTES
    s = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
    assert (np.diff(s) >= 0).all()


def test_scores_of_a_registry_are_written_with_equal_ones_together(spark, sf):
    from simlake.plans import retrieval

    runs = {}
    for r in retrieval.sim5_registry(spark, sf).where("metric <> 'dot'").withColumn("part", F.spark_partition_id()).collect():
        runs.setdefault((r["part"], r["metric"]), []).append(r["sim"])
    assert sum(map(len, runs.values())) == 3 * 5_000
    assert all(s == sorted(s, reverse=name == "neg_euclidean") for (_, name), s in runs.items())
