from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from simlake.operators import cluster, losses, pivots, quantiles, spectral, stats


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "x double, y double")


def test_ranks_share_ties_and_constants_give_null(spark):
    r = stats.average_ranks(pairs(spark, [(1, 5), (1, 7), (2, 7), (3, 7)])).orderBy("x", "y").collect()
    assert [tuple(x) for x in r] == [(1.5, 1.0), (1.5, 3.0), (3.0, 3.0), (4.0, 3.0)]
    s = stats.statistics(pairs(spark, [(1, 2), (1, 3)])).first()
    assert s["pearson"] is None and s["spearman"] is None and s["n_points"] == 2


def test_nan_pairs_are_dropped(spark):
    s = stats.statistics(pairs(spark, [(1, 2), (float("nan"), 9), (2, 4), (3, float("nan"))])).first()
    assert s["n_points"] == 2 and s["pearson"] == pytest.approx(1)


def test_bins_are_open_right_and_bin_statistics_open_left(spark):
    p = pairs(spark, [(0, 1), (0.5, 2), (0.5, 3), (1, 4)])
    assert sorted(r["bin"] for r in stats.bins(p, 2).collect()) == [0, 1, 1]
    assert [(r["bin"], r["n_points"]) for r in stats.bin_statistics(p, 2).collect()] == [(0, 2)]


def test_boxes_keep_empty_bins_and_count_outliers(spark):
    p = pairs(spark, [(0.1, y) for y in (1, 2, 3, 4, 100)])
    rows = {r["bin"]: r for r in stats.boxes(p, 2).collect()}
    assert rows[0]["n_outliers"] == 1 and rows[0]["high_whisker"] == 4 and rows[1]["median"] is None


def test_histogram_closes_the_last_bin_and_takes_constants(spark):
    assert [r["n"] for r in stats.histogram(pairs(spark, [(v, 0) for v in (0, 1, 2, 3, 4)]), 2).orderBy("bin").collect()] == [2, 3]
    assert sum(r["n"] for r in stats.histogram(pairs(spark, [(5, 0)] * 3), 4).collect()) == 3


def test_polynomials(spark):
    c, b0 = stats.polynomial_fit(pairs(spark, [(x, 2 - 3 * x + 0.5 * x**3) for x in np.linspace(-2, 5, 30)]), 3)
    assert b0 == pytest.approx(2, abs=1e-6) and c == pytest.approx([0, -3, 0, 0.5], abs=1e-6)
    with pytest.raises(ValueError):
        stats.polynomial_fit(pairs(spark, [(1, 1)]), 0)


def test_agreement_by_hand(spark):
    t, p = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2]
    r = cluster.agreement(spark.createDataFrame(list(zip(t, p)), "t int, p int")).first()
    assert r["ri"] == pytest.approx(2 / 3) and r["ari"] == pytest.approx(0.2424242424) and r["ami"] == pytest.approx(0.2987924581708901)
    same = cluster.agreement(spark.createDataFrame([(i // 2, 9 - i // 2) for i in range(6)], "t int, p int")).first()
    assert same["ri"] == same["ari"] == pytest.approx(1) and same["ami"] == pytest.approx(1)
    one = cluster.agreement(spark.createDataFrame([(0, 0)] * 3, "t int, p int")).first()
    assert (one["ri"], one["ari"], one["ami"]) == (1, 1, 1)


def points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_dbscan_line_with_noise(spark):
    x = [[0, 0], [0, 1], [0, 2], [0, 3], [9, 9], [20, 0], [20, 1], [20, 2], [0, 4]]
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(points(spark, x), 1.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 8: 0, 4: -1, 5: 1, 6: 1, 7: 1}


def test_neighbours_in_blocks_are_the_same(spark):
    df = points(spark, np.random.default_rng(2).random((60, 3)))
    whole = sorted(map(tuple, cluster.neighbours(df, 0.4).collect()))
    assert whole == sorted(map(tuple, cluster.neighbours(df, 0.4, block_rows=9).collect()))


@pytest.mark.parametrize("method", ["kmeans", "spectral"])
def test_separated_groups_are_found(spark, method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ([0, 0], [5, 5], [0, 9])])
    df = points(spark, x)
    r = cluster.cluster_and_compare(df.withColumn("label", (df["id"] / 30).cast("int")), method, 3).first()
    assert (r["ri"], r["ari"]) == (1, 1) and r["nmi"] == pytest.approx(1)


def dense_vectors(x, k):
    """By a dense matrix: neighbour graph, normalised Laplacian, all eigenvectors."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    named = np.zeros_like(d)
    for i, row in enumerate(d):
        named[i, sorted(range(len(x)), key=lambda j: (round(row[j], 9), j))[:10]] = 1
    w = (named + named.T) / 2
    np.fill_diagonal(w, 0)
    scale = 1 / np.sqrt(w.sum(1))
    return np.linalg.eigh(np.eye(len(x)) - w * scale[:, None] * scale[None])[1][:, :k], scale


def dense_spectral(x, k):
    v, scale = dense_vectors(x, k)
    v = v * scale[:, None]
    return cluster._lloyd(v / np.linalg.norm(v, axis=1, keepdims=True), k, cluster.SEED)


def test_spectral_equals_dense_eigenvectors(spark):
    x = np.random.default_rng(1).normal(size=(300, 3))
    got = {r["id"]: r["cluster"] for r in cluster.spectral(points(spark, x), 4).collect()}
    want = dense_spectral(x, 4)
    # eigenvectors are known up to sign, which may change the start of k-means: the partitions are compared
    pairs = {(got[i], int(want[i])) for i in range(300)}
    assert len(got) == 300 and len(pairs) == 4


def test_vectors_in_tables_equal_dense_ones_and_the_driver_gets_small_matrices(spark, monkeypatch):
    """300 points without clear groups; what comes to the driver depends on the number of vectors, not of points."""
    x = np.random.default_rng(1).normal(size=(300, 3))
    graph, brought = cluster.neighbour_graph(points(spark, x)), []
    plain = type(graph).collect

    def spied(df):
        rows = plain(df)
        brought.append(sum(len(c) if isinstance(c, (bytes, bytearray)) else 8 for r in rows for c in r))
        return rows

    with monkeypatch.context() as patch:
        patch.setattr(type(graph), "collect", spied)
        patch.setattr(type(graph), "toArrow", None)
        patch.setattr(type(graph), "toPandas", None)
        found = spectral.leading(graph, 4, 42)
    assert brought and max(brought) <= 32 * 8 * 2 * (4 + spectral.EXTRA) ** 2
    rows = found.orderBy("id").collect()
    v, scale = np.array([r["x"] for r in rows]), np.array([r["scale"] for r in rows])
    dense, dense_scale = dense_vectors(x, 4)
    assert np.allclose(scale, dense_scale) and np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert np.linalg.svd(dense.T @ v)[1] == pytest.approx(np.ones(4), abs=1e-9)  # the same space
    assert np.abs(np.abs((dense * v).sum(0)) - 1).max() < 1e-8  # and the same vectors, up to sign


def test_spectral_in_tables_finds_groups_that_nothing_connects(spark):
    """Three components share the lowest eigenvalue; ids have gaps; repeated points."""
    rng = np.random.default_rng(0)
    x = np.repeat(np.concatenate([rng.normal(c, 0.2, (15, 2)) for c in ([0, 0], [5, 5], [0, 9])]), 2, axis=0)
    df = points(spark, x).withColumn("id", F.col("id") * 7 - 100)
    got = {r["id"]: r["cluster"] for r in cluster.spectral(df, 3, local_edges=0, starts=2).collect()}
    assert len(got) == 90 and len({(i // 30, got[i * 7 - 100]) for i in range(90)}) == 3 and len(set(got.values())) == 3


def test_triangle_of_a_table(spark):
    x = np.random.default_rng(2).normal(size=(500, 4)) * [1, 1e6, 1e-6, 3]
    r = spectral.triangle(spark.createDataFrame([(v,) for v in x.tolist()], "x array<double>").repartition(7), 4)
    assert np.allclose(np.abs(r), np.abs(np.linalg.qr(x, mode="r")), rtol=1e-9)
    empty = spark.createDataFrame([], "a long, b long, w double")
    assert spectral.leading(empty, 3, 0).collect() == []


def test_dbscan_is_the_same_in_blocks_and_equals_a_plain_reading(spark):
    x = np.random.default_rng(4).random((150, 2))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.08
    core = near.sum(1) >= 4
    label, n = np.full(150, -1), 0
    for i in range(150):
        if core[i] and label[i] < 0:
            queue, label[i] = [i], n
            while queue:
                for j in np.flatnonzero(near[queue.pop()] & core & (label < 0)):
                    label[j] = n
                    queue.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.flatnonzero(near[i] & core)[0]]
    for block in (2048, 40):
        got = {r["id"]: r["cluster"] for r in cluster.dbscan(points(spark, x), 0.08, 4, block_rows=block).collect()}
        assert [got[i] for i in range(150)] == label.tolist()


def test_agreement_of_large_marginals_against_a_plain_sum(spark):
    from math import exp, lgamma, log

    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, 30_000)
    p = np.where(rng.random(30_000) < 0.3, t, rng.integers(0, 3, 30_000))
    r = cluster.agreement(spark.createDataFrame(list(zip(t.tolist(), p.tolist())), "t int, p int")).first()
    n, a, b = 30_000, np.bincount(t), np.bincount(p)
    f = lambda k: lgamma(k + 1)
    emi = 0.0
    for i in map(int, a):
        for j in map(int, b):
            for k in range(max(1, i + j - n), min(i, j) + 1):
                emi += k / n * log(n * k / (i * j)) * exp(f(i) + f(j) + f(n - i) + f(n - j) - f(n) - f(k) - f(i - k) - f(j - k) - f(n - i - j + k))
    joint = np.histogram2d(t, p, 3)[0]
    mi = sum(v / n * log(v * n / (a[x] * b[y])) for (x, y), v in np.ndenumerate(joint) if v)
    h = lambda c: -sum(v / n * log(v / n) for v in c)
    assert r["ami"] == pytest.approx((mi - emi) / ((h(a) + h(b)) / 2 - emi), abs=1e-9)


def test_kmeans_from_a_start_ends_where_no_step_moves(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ([0, 0], [5, 5])])
    got = {r["id"]: r["cluster"] for r in cluster.kmeans(points(spark, x), 2, start=x[[0, 79]], iterations=50).collect()}
    assert [got[i] for i in range(80)] == [0] * 40 + [1] * 40


def test_cluster_refusals(spark):
    df = points(spark, [[0, 0]])
    for call in (lambda: cluster.cluster(df, "kmeans"), lambda: cluster.cluster(df, "spectral"), lambda: cluster.cluster(df, "other", 2)):
        with pytest.raises(ValueError):
            call()


def batch(spark, rows):
    return spark.createDataFrame(rows, "b int, c int, px int, pred double, target double")


def test_losses_by_hand(spark):
    df = batch(spark, [(0, 0, 0, 0.8, 1.0), (0, 1, 0, 0.2, 0.0), (0, 0, 1, 0.3, 1.0), (0, 1, 1, 0.7, 0.0)])
    # class 0: overlap 1.1, size 3.1; class 1 has no target and counts 0
    assert losses.dice_loss(df, from_logits=False).first()["loss"] == pytest.approx((1 - 2.2 / 3.1) / 2)
    assert losses.dice_loss(df, from_logits=False, classes=[0]).first()["loss"] == pytest.approx(1 - 2.2 / 3.1)
    want = np.mean([0.5 * 0.2**2 * -np.log(0.8), 0.5 * 0.7**2 * -np.log(0.3)])
    assert losses.focal_loss(df, from_logits=False).first()["loss"] == pytest.approx(want)
    weighted = losses.focal_loss(df, from_logits=False, alpha=[3.0, 1.0]).first()["loss"]
    assert weighted == pytest.approx(want * 1.5)
    h = losses.hybrid_loss(df, from_logits=False).first()["loss"]
    assert h == pytest.approx(0.5 * want + 0.5 * (1 - 2.2 / 3.1) / 2)
    with pytest.raises(ValueError):
        losses.hybrid_loss(df, 1.0, 1.0)
    with pytest.raises(ValueError):
        losses.dice_loss(df, mode="other")


def test_binary_focal_takes_the_only_channel_as_target_zero(spark):
    df = batch(spark, [(0, 0, 0, 0.8, 1.0)])
    loss = lambda **s: losses.focal_loss(df, mode="binary", from_logits=False, **s).first()["loss"]
    assert loss() == pytest.approx(0.8**2 * -np.log(0.2))
    assert loss(alpha=0.25, normalize_weights=False) == pytest.approx(0.75 * 0.8**2 * -np.log(0.2)) and loss(alpha=0.25) == 0
    two = batch(spark, [(0, 0, 0, 0.3, 0.0), (0, 1, 0, 0.6, 1.0)])
    assert losses.focal_loss(two, mode="binary", from_logits=False, alpha=0.25, normalize_weights=False).first()["loss"] == pytest.approx(0.25 * (0.7**2 * -np.log(0.3) + 0.4**2 * -np.log(0.6)) / 2)
    with pytest.raises(ValueError):
        loss(alpha=[1.0, 2.0])


HARD = [0.0, -0.0, 5e-324, 1e-300, 1e300, -1e300, 1.7e308, -1.7e308, 2.0, 2.0, 2.0, float("inf"), float("-inf"), 1 + 2**-52, 1.0]


def test_quantiles_select_by_rank(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.normal(size=5000) ** 9, "ties": rng.integers(0, 4, 800).astype(float), "hard": np.array(HARD), "one": np.array([7.0]), "near": 1e9 + rng.integers(0, 99, 300) * 1e-7, None: rng.random(30)}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        own = np.sort(own)
        for p, q in zip(at, got[g]):
            h = (len(own) - 1) * p
            low, high = own[int(np.floor(h))], own[int(np.ceil(h))]
            assert q == (low if low == high else pytest.approx((1 - h % 1) * low + h % 1 * high, nan_ok=True))


def test_quantiles_of_everything_and_of_nothing(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    assert quantiles.quantiles(df, [], "v", [0.5]).collect() == [([500.0],)]
    assert quantiles.quantiles(df.where("v < 0"), [], "v", [0.5]).collect() == []
    s = stats.statistics(spark.createDataFrame([], "x double, y double")).first()
    assert s["n_points"] == 0 and s["median"] is None and s["spearman"] is None


def test_a_pass_shuffles_counts_and_not_values(spark):
    """Whatever the rows, the counts of a pass that leave a task are at most the parts of the open intervals."""
    df = spark.range(200_000).selectExpr("cast(id % 3 as int) as g", "rand(3) as v")
    plan = quantiles.quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list(v" not in plan
    got = {r["g"]: r["q"][0] for r in quantiles.quantiles(df, ["g"], "v", [0.5]).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("held", [quantiles.HELD, 0])
def test_rank_correlation_in_groups(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    rng = np.random.default_rng(6)
    rows = [(int(b), float(x), float(y)) for b, x, y in zip(rng.integers(0, 3, 900) ** 3, rng.integers(0, 9, 900), rng.normal(size=900).round(1))] + [(99, 1.0, 2.0), (98, 1.0, 2.0), (98, 1.0, 3.0)]
    got = {r["b"]: r["spearman"] for r in quantiles.rank_correlation(spark.createDataFrame(rows, "b int, x double, y double"), ["b"]).collect()}
    assert got.pop(99) is None and got.pop(98) is None
    for b, s in got.items():
        own = [(x, y) for g, x, y in rows if g == b]
        rank = lambda v: [sum(o < a for o in v) + (sum(o == a for o in v) + 1) / 2 for a in v]
        assert s == pytest.approx(np.corrcoef(rank([x for x, _ in own]), rank([y for _, y in own]))[0, 1])


def test_bin_error_is_that_of_its_line(spark):
    rows = [(0.1, 1), (0.2, 3), (0.3, 2), (0.7, 5), (0.8, 4), (0.9, 9), (1.0, 1)]
    for r in stats.bin_statistics(pairs(spark, rows), 2).collect():
        x, y = np.array([p for p in rows if (p[0] > 0.5) == r["bin"]]).T
        assert r["mse"] == pytest.approx(((np.polyval(np.polyfit(x, y, 1), x) - y) ** 2).mean())


def test_pivots_leave_out_blocks_and_no_near_pair(spark):
    rng = np.random.default_rng(12)
    x = 10 * rng.normal(size=(25, 6))[rng.integers(0, 25, 2000)] + 0.2 * rng.normal(size=(2000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centres = pivots.choose(df)
    met, all_pairs = pivots.meeting(pivots.placed(df, centres, 50), len(centres), 0.8)
    assert len(met) < 0.2 * all_pairs
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.8
    got = {r["id"]: r["n"] for r in cluster.neighbour_counts(df, 0.8, block_rows=50).collect()}
    assert got == dict(enumerate(near.sum(1)))
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [1.0, 2.1])], "id long, v array<double>")
    assert sorted(tuple(r) for r in cluster.neighbour_counts(odd, 0.5, block_rows=2).collect()) == [(0, 2), (1, 0), (2, 2)]
    assert cluster.neighbour_counts(df.where("id < 0"), 1.0).collect() == []


def test_a_row_is_copied_to_a_bounded_number_of_tasks(spark, monkeypatch):
    import pyarrow as pa

    from simlake.operators import pivots

    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).tolist())], "id long, v array<double>")
    whole = sorted(map(tuple, cluster.neighbour_counts(df, 1.5).collect()))
    monkeypatch.setattr(pivots, "DEALT", 4)
    partners, broadcast, seen = [], pivots.F.broadcast, spark.sparkContext.accumulator(0)

    def each(left, right):
        seen.add(left.num_rows * left.num_rows if right is None else 2 * left.num_rows * right.num_rows)
        return pa.table({"n": [left.num_rows]})

    with monkeypatch.context() as m:
        m.setattr(pivots.F, "broadcast", lambda table: partners.append(table.count()) or broadcast(table))
        found = pivots.near_blocks(df, 100.0, each, "n long", block_rows=10)
    assert partners[-1] == 4 * 4  # 30 * 30 if each block went to every other
    assert found.count() == 30 * 31 // 2 and seen.value == 300 * 300
    assert sorted(map(tuple, cluster.neighbour_counts(df, 1.5, block_rows=10).collect())) == whole


def test_products_of_a_graph_in_parts_are_those_of_its_matrix(spark, monkeypatch):
    monkeypatch.setattr(spectral, "LINKS", 5)
    rng = np.random.default_rng(4)
    ids = np.arange(40) * 7 - 100
    m = np.where(rng.random((40, 40)) < 0.1, rng.random((40, 40)), 0)
    m = m + m.T + np.eye(40)
    i, j = np.nonzero(m)
    links = spark.createDataFrame([(int(ids[a]), int(ids[b]), float(m[a, b])) for a, b in zip(i, j, strict=True)], "a long, b long, w double")
    x = rng.normal(size=(40, 3))
    found = spectral._chain(spectral._laid_out(links, 6), 6, points(spark, x).withColumn("id", F.col("id") * 7 - 100).select("id", F.col("v").alias("x")), 3, [(0.5, 2.0, 0.0), (0.5, 4.0, 1.0), (0.0, 1.0, 0.0)])
    rows = found.orderBy("id").collect()
    one = 2 * (m @ x - 0.5 * x)
    two = 4 * (m @ one - 0.5 * one) - x
    assert [r["id"] for r in rows] == ids.tolist()
    assert np.allclose([r["before"] for r in rows], two) and np.allclose([r["x"] for r in rows], m @ two)
