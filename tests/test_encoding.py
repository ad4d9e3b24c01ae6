from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.functions import vectors as V
from simlake.operators import encode, train
from simlake.operators.codebook import Catalogue, Codebook, Projection

RNG = np.random.default_rng(11)
BOOK = Codebook(RNG.normal(size=(3, 4)), np.array([0.2, 0.3, 0.5]), RNG.random((3, 4)) + 0.5)


def long_form(spark, bags):
    return spark.createDataFrame([(i, j, [float(c) for c in x]) for i, b in enumerate(bags) for j, x in enumerate(b)], "image long, desc int, x array<double>")


def encoded(df):
    return {r["image"]: np.array(r["encoding"]) for r in df.collect()}


def test_vlad_by_hand(spark):
    book = Codebook(np.array([[0.0, 0.0], [10.0, 0.0], [50.0, 50.0]]))
    got = encoded(encode.Vlad(book).encode(long_form(spark, [[[1, 0], [0, 2], [10, 3]]])))[0]
    want = [1 / 5**0.5, 2 / 5**0.5, 0, 1, 0, 0]
    assert np.allclose(got, want, atol=1e-8)


def test_fisher_against_sums(spark):
    x = RNG.normal(size=(6, 4))
    p = np.array([[w * np.prod(np.exp(-((xi - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)) for w, m, v in zip(BOOK.weights, BOOK.means, BOOK.variances)] for xi in x])
    p /= p.sum(1, keepdims=True)
    parts = []
    for k in range(3):
        parts.append([(p[:, k].mean() - BOOK.weights[k]) / BOOK.weights[k] ** 0.5])
    for k in range(3):
        parts.append((p[:, k : k + 1] * (x - BOOK.means[k])).mean(0) / (BOOK.weights[k] * BOOK.variances[k]) ** 0.5)
    for k in range(3):
        parts.append((p[:, k : k + 1] * (BOOK.variances[k] - (x - BOOK.means[k]) ** 2)).mean(0) / ((2 * BOOK.weights[k]) ** 0.5 * BOOK.variances[k]))
    v = np.concatenate(parts)
    v = np.sign(v) * np.abs(v) ** 0.5
    got = encoded(encode.Fisher(BOOK).encode(long_form(spark, [x])))[0]
    assert np.allclose(got, v / np.linalg.norm(v), atol=1e-6)


def test_order_of_descriptors_does_not_matter_and_norms_are_one(spark):
    x = RNG.normal(size=(9, 4))
    for e in (encode.Vlad(BOOK), encode.Fisher(BOOK)):
        got = encoded(e.encode(long_form(spark, [x, x[::-1]])))
        assert np.allclose(got[0], got[1])
        assert len(got[0]) == e.length
    assert np.linalg.norm(got[0]) == pytest.approx(1)


def test_pipeline_is_the_concatenation_and_its_score_the_cosine(spark):
    df = long_form(spark, [RNG.normal(size=(5, 4)), RNG.normal(size=(3, 4))])
    parts = [encode.Vlad(BOOK), encode.Fisher(BOOK)]
    pipe = encode.Pipeline(parts)
    got, one, two = encoded(pipe.encode(df)), *(encoded(e.encode(df)) for e in parts)
    assert np.allclose(got[1], np.concatenate([one[1], two[1]]))
    assert encoded(pipe.encode_each([df, df]))[1] == pytest.approx(got[1])
    s = {(r["q"], r["id"]): r["sim"] for r in pipe.similarity_scores(df, df).collect()}
    assert s[0, 1] == pytest.approx(got[0] @ got[1] / np.linalg.norm(got[0]) / np.linalg.norm(got[1]), abs=1e-6)
    assert s[0, 0] == pytest.approx(1)


def test_encoders_take_a_users_similarity(spark):
    df = long_form(spark, [RNG.normal(size=(5, 4)), RNG.normal(size=(3, 4))])
    gap = lambda a, b: float(np.abs(np.ravel(a) - np.ravel(b)).max())
    with pytest.warns(UserWarning, match="pair by pair"):
        e = encode.Vlad(BOOK, similarity=gap)
        got = {(r["q"], r["id"]): r["sim"] for r in e.similarity_scores(df, df, single=False).collect()}
        pipe = encode.Pipeline([encode.Vlad(BOOK)], similarity=gap).similarity_scores(df, df, single=False).collect()
    v = encoded(encode.Vlad(BOOK).encode(df))
    assert got[0, 1] == pytest.approx(np.abs(v[0] - v[1]).max()) and {(r["q"], r["id"]): r["sim"] for r in pipe} == pytest.approx(got)
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        encode.Vlad(BOOK, similarity=lambda a, b: np.zeros(3))
    assert "similarity=" in e.describe()


def test_steps_from_a_start(spark):
    x = np.r_[RNG.normal(0, 0.5, (60, 2)), RNG.normal(8, 0.5, (30, 2))]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    fit = train.fit_kmeans(df, 3, iterations=30, start=[[0.0, 0.0], [8.0, 8.0], [99.0, 99.0]])
    assert np.allclose(fit.means, [x[:60].mean(0), x[60:].mean(0), [99, 99]])
    start = Codebook(np.array([[1.0, 1.0], [7.0, 7.0]]), np.array([0.5, 0.5]), np.ones((2, 2)))
    mixture = train.fit_mixture(df, 2, start=start)
    assert mixture.weights == pytest.approx([2 / 3, 1 / 3], abs=0.01) and np.allclose(mixture.means, [x[:60].mean(0), x[60:].mean(0)], atol=0.05)


def test_an_image_without_descriptors_is_zero_and_alone(spark):
    df = long_form(spark, [RNG.normal(size=(5, 4))])
    images = spark.createDataFrame([(0,), (7,)], "image long")
    for e in (encode.Vlad(BOOK), encode.Fisher(BOOK), encode.Pipeline([encode.Vlad(BOOK)])):
        got = encoded(e.encode(df, images))
        assert not got[7].any() and len(got[7]) == e.length and np.allclose(got[0], encoded(e.encode(df))[0])


def test_ties_go_to_the_lowest_centre(spark):
    book = Codebook(np.array([[1.0, 0.0], [-1.0, 0.0]]))
    assert encode.assign(long_form(spark, [[[0, 5]]]), book).first()["k"] == 0


def test_models_are_checked():
    wide = Projection(np.zeros(4), np.eye(4)[:2])
    for call in (lambda: encode.Vlad(BOOK, wide), lambda: encode.Fisher(Codebook(BOOK.means)), lambda: encode.Vlad(BOOK, similarity="x"), lambda: encode.Pipeline([]), lambda: encode.Pipeline([1]), lambda: Codebook(BOOK.means, BOOK.weights, np.ones((3, 4, 4))), lambda: Codebook(np.ones(3))):
        with pytest.raises(ValueError):
            call()
    assert "K=3" in encode.Vlad(BOOK).describe()


def test_codebooks_and_catalogue_round_trip(spark, tmp_path):
    BOOK.save(spark, f"{tmp_path}/book")
    p = Projection(np.ones(4), np.eye(4)[:3])
    p.save(spark, f"{tmp_path}/pca")
    names = Catalogue(spark, f"{tmp_path}/names")
    names.register("a", f"{tmp_path}/book", f"{tmp_path}/pca")
    book, pca = names.load("a")
    assert np.array_equal(book.means, BOOK.means) and np.array_equal(book.variances, BOOK.variances) and np.array_equal(pca.components, p.components)
    assert names.names() == ["a"]
    with pytest.raises(KeyError):
        names.load("b")


def test_pca_equals_numpy_and_the_column_form(spark):
    x = RNG.normal(size=(60, 5)) @ RNG.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    fit = train.fit_pca(df, 2)
    _, _, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.abs(fit.components @ vt[:2].T), np.eye(2), atol=1e-8)
    assert (fit.components[np.arange(2), np.abs(fit.components).argmax(1)] > 0).all()
    got = np.array([r["y"] for r in df.select(V.projected(F.col("x"), *fit.columns()).alias("y")).collect()])
    assert np.allclose(np.sort(got, 0), np.sort(fit.apply(x), 0))
    with pytest.raises(ValueError):
        train.fit_pca(df, 6)


def test_a_mixture_finds_two_groups(spark):
    x = np.r_[RNG.normal(0, 0.5, (150, 2)), RNG.normal([8, 4], [1, 0.2], (50, 2))]
    fit = train.fit_mixture(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3), 2)
    o = np.argsort(fit.weights)
    assert fit.weights[o] == pytest.approx([0.25, 0.75], abs=0.01)
    assert np.allclose(fit.means[o], [[8, 4], [0, 0]], atol=0.3)
    assert fit.variances[o][0] == pytest.approx([1, 0.04], rel=0.5)


def test_learning_follows_the_kind_and_resets_the_projection(spark):
    df = long_form(spark, [RNG.normal(size=(40, 4)), RNG.normal(size=(40, 4))])
    v = train.learn(encode.Vlad, df, 2, reduction=2)
    assert v.codebook.dim == 2 and v.projection.dim_in == 4 and len(encoded(v.encode(df))[0]) == 4
    f = train.learn(encode.Fisher, df, 2)
    assert f.projection is None and f.codebook.is_mixture
    with pytest.raises(ValueError):
        train.learn(encode.Encoder, df, 2)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, -4.0], [1.0, 1.0])], "a array<double>, b array<double>")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    a, b = F.col("a"), F.col("b")
    assert one(V.unit(a)) == pytest.approx([0.6, -0.8])
    assert one(V.unit(F.transform(b, lambda x: x * 0))) == [0, 0]
    assert one(V.signed_power(a, 0.5)) == pytest.approx([3**0.5, -2])
    assert one(V.standardised(b)) == [None, None]
    assert one(V.p_norm(a, 1)) == 7 and one(V.p_norm(a, 3)) == pytest.approx(91 ** (1 / 3))
    assert one(V.similarity("manhattan")(a, b)) == 7
    assert one(V.truncated(F.array(F.lit(-1.7), F.lit(1.7)))) == [-1, 1]
    with pytest.raises(Exception, match="components"):
        one(V.checked_width(a, 3))
    with pytest.raises(Exception, match="longer"):
        one(V.is_subset(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1))))
    with pytest.raises(ValueError):
        V.similarity("none")


def test_products_equal_differences(spark):
    rng = np.random.default_rng(4)
    book = Codebook(rng.normal(size=(7, 5)) + 1e4, np.full(7, 1 / 7), rng.random((7, 5)) + 0.1)
    x = rng.normal(size=(300, 5)) + 1e4
    x[:20] = book.means[:20 % 7].repeat(4, 0)[:20] if 20 % 7 else book.means[:20]
    x[20] = (book.means[1] + book.means[2]) / 2  # a tie, unless another centre is nearer
    assert (encode.nearest(x, book) == np.round(encode.squared_distances(x, book.means), 9).argmin(1)).all()
    plain = np.log(book.weights) - 0.5 * np.log(2 * np.pi * book.variances).sum(1) - 0.5 * ((x[:, None] - book.means) ** 2 / book.variances).sum(-1)
    p = np.exp(plain - plain.max(1, keepdims=True))
    assert np.allclose(encode.posteriors(x, book), p / p.sum(1, keepdims=True), atol=1e-8)
    assert encode.posteriors(x[:0], book).shape == (0, 7) and len(encode.nearest(x[:0], book)) == 0


def test_mixture_of_published_size_in_bounded_memory():
    """K = 256, D = 514, 10,000 rows: below 500 MB over what the process has before, models included."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from simlake.operators import encode
from simlake.operators.codebook import Codebook
rng = np.random.default_rng(0)
book = Codebook(rng.normal(size=(256, 514)), np.full(256, 1 / 256), rng.random((256, 514)) + 0.5)
x = rng.normal(size=(10_000, 514))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
mass, first, second, likelihood = encode.moments(x, book)
assert abs(mass.sum() - 10_000) < 1e-6
encode.nearest(x, book)
v = encode.Fisher(book).of_bag(x[:196])
assert len(v) == 256 * (1 + 2 * 514) and np.isfinite(v).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[1])
    assert int(out.stdout) < 300


def test_single_centre_and_far_origin(spark):
    rng = np.random.default_rng(2)
    for offset in (0.0, 1e8):
        x = rng.normal(size=(400, 3)) + offset
        df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
        book = train.fit_mixture(df, 1)
        assert np.allclose(book.means[0], x.mean(0)) and np.allclose(book.variances[0], x.var(0), rtol=1e-4)
    one = train.fit_kmeans(df, 1)
    assert train.inertia(df, one) == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-6)
    with pytest.raises(ValueError, match="different points"):
        train.fit_kmeans(spark.createDataFrame([([1.0, 2.0],)] * 9 + [([2.0, 2.0],)], "x array<double>"), 4)


def test_mixture_gains_likelihood(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([((rng.normal(size=2) + 6 * (i % 3)).tolist(),) for i in range(300)], "x array<double>")
    found = [train.mean_log_likelihood(df, train.fit_mixture(df, 3, iterations=n)) for n in (1, 3, 30)]
    assert found[0] <= found[1] + 1e-9 <= found[2] + 2e-9
