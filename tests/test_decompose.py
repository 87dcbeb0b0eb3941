"""Decompositions against numpy and on planted sources."""

import numpy as np
import pytest

from corpuskiln.operators import decompose as dc
from corpuskiln.plans import modules


def sparse(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame([*rows, (None, 0, 1.0), (0, None, 1.0), (0, 0, None)], "term_id bigint, feature_id bigint, n double").repartition(4)


def collected(df, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r.id] = r.features
    return out


@pytest.mark.parametrize(("shape", "blocks"), [((60, 40), 1 << 16), ((25, 70), 16)])
def test_svd_equals_numpy(spark, shape, blocks, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(dc, "FAN_IN", 2)
    monkeypatch.setattr(dc, "AT_ONCE", 100)
    r = np.random.default_rng(1)
    a = r.normal(size=shape) * (r.random(shape) < 0.3)
    a[0] += 0  # keeps its size
    a[-1, -1] = a[0, 0] = 1.0
    got = dc.svd(sparse(spark, a), 4, rounds=12)
    u, s, v = np.linalg.svd(a)
    assert np.allclose(got.values, s[:4], rtol=1e-6)
    left, right = collected(got.left, shape[0], 4), collected(got.right, shape[1], 4)
    assert np.allclose(left.T @ left, np.eye(4), atol=1e-6) and np.allclose(right.T @ right, np.eye(4), atol=1e-6)
    assert np.allclose(left * got.values @ right.T, u[:, :4] * s[:4] @ v[:4], atol=1e-4)


def test_svd_of_low_rank(spark):
    """A matrix of rank 2, asked for 5: the rest is 0; cells of one place are added up."""
    r = np.random.default_rng(2)
    a = r.normal(size=(30, 2)) @ r.normal(size=(2, 12))
    both = sparse(spark, a / 2)
    got = dc.svd(both.unionByName(both), 5, oversampling=3)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(got.values[:2], s[:2], rtol=1e-8) and np.allclose(got.values[2:], 0, atol=1e-8 * s[0])
    assert np.allclose(collected(got.left, 30, 5) * got.values @ collected(got.right, 12, 5).T, a, atol=1e-6)


def dense(spark, x):
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (10**6, None)], "idx bigint, vector array<double>").repartition(3)


def test_ica_finds_sources(spark):
    r = np.random.default_rng(3)
    n = 3000
    s = np.stack([np.sign(np.sin(np.arange(n) / 7.0)), r.uniform(-1, 1, n), r.laplace(size=n)], 1)
    mixing = r.normal(size=(5, 3))
    got = dc.fast_ica(dense(spark, s @ mixing.T + 2.0), 3)
    found = collected(got.sources.where("id < 1000000"), n, 3)
    match = np.abs(np.corrcoef(np.concatenate((s, found), 1).T)[:3, 3:])
    assert sorted(match.argmax(1)) == [0, 1, 2] and match.max(1).min() > 0.99
    assert np.allclose(found.std(0), 1, atol=1e-6) and np.allclose(found @ got.mixing.T + got.mean, s @ mixing.T + 2.0, atol=1e-6)
    with pytest.raises(ValueError):
        dc.fast_ica(dense(spark, s @ mixing.T), 4)


def test_factor_analysis(spark):
    r = np.random.default_rng(4)
    n = 4000
    loading, noise = r.normal(size=(6, 2)), np.array([0.1, 0.5, 1.0, 0.2, 0.3, 0.7])
    z = r.normal(size=(n, 2))
    x = z @ loading.T + r.normal(size=(n, 6)) * np.sqrt(noise) + 1.0
    got = dc.factor_analysis(dense(spark, x), 2)
    assert np.allclose(got.noise, noise, atol=0.12) and np.allclose(got.mixing @ got.mixing.T, loading @ loading.T, atol=0.35)
    # at the optimum the model's variances are those of the data
    assert np.allclose(np.diag(got.mixing @ got.mixing.T) + got.noise, x.var(0), rtol=1e-3)
    found = collected(got.sources, n, 2) if got.sources.where("id >= 4000").count() == 0 else None
    assert np.linalg.matrix_rank(found) == 2 and np.abs(np.linalg.lstsq(found, z, rcond=None)[0]).max() < 3
    with pytest.raises(ValueError):
        dc.factor_analysis(dense(spark, x).limit(0), 1)


@pytest.mark.parametrize("name", ["TruncatedSVD", "FastICA", "FactorAnalysis", "PCA", "NMF"])
def test_module(spark, name):
    r = np.random.default_rng(5)
    a = np.abs(r.normal(size=(30, 6))) * (r.random((30, 6)) < 0.7)
    t = modules.TYPES["sklearn.matrix_factorization"]
    got = t.run(spark, {"matrix": [sparse(spark, a).dropna()]}, {"class": t.options["class"](name), "options": t.options["options"]("n_components=2")})
    assert {len(x.features) for x in got["w"].collect()} == {2} == {len(x.features) for x in got["h"].collect()}
    assert got["w"].count() >= 28 and got["h"].count() == 6
    with pytest.raises(ValueError):
        t.options["class"]("SparsePCA")
    with pytest.raises(ValueError):
        t.run(spark, {"matrix": [sparse(spark, a)]}, {"class": name, "options": {"solver": "cd"}})
