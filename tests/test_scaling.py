"""Planar maps of vectors on planted points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import scaling
from corpuskiln.plans import modules


def frame(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "idx bigint, vector array<double>").repartition(3)


def points(df, n):
    got = {r.idx: r.point for r in df.collect()}
    assert sorted(got) == list(range(n))
    return np.array([got[i] for i in range(n)])


def plain_distance(a, b, metric):
    if metric == "cosine":
        return 1 - sum(p * q for p, q in zip(a, b, strict=True)) / (np.sqrt(sum(p * p for p in a)) * np.sqrt(sum(q * q for q in b)))
    if metric == "manhattan":
        return sum(abs(p - q) for p, q in zip(a, b, strict=True))
    return np.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_distances(metric):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(4, 6)), r.normal(size=(5, 6))
    assert np.allclose(scaling.distances(a, b, metric), [[plain_distance(p, q, metric) for q in b] for p in a])
    with pytest.raises(ValueError):
        scaling.distances(a, b, "other")


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("landmarks", [500, 12])
def test_planar_points_come_back(spark, landmarks):
    """Points of a plane in ten dimensions: all distances are kept, whether rows are landmarks or not."""
    r = np.random.default_rng(1)
    plane = r.normal(size=(90, 2)) * [5.0, 2.0]
    x = plane @ np.linalg.qr(r.normal(size=(10, 2)))[0].T + 3.0
    got = points(scaling.mds(frame(spark, x, [(1000, None)]), metric="euclidean", landmarks=landmarks), 90)
    assert np.allclose(pairwise(got), pairwise(plane), atol=1e-6)
    assert scaling.mds(frame(spark, x).limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_classical_scaling(spark, metric):
    """With all rows as landmarks, the coordinates are the first two eigenvectors of the centred squared distances."""
    x = np.random.default_rng(2).normal(size=(30, 5))
    d = np.array([[plain_distance(a, b, metric) for b in x] for a in x]) ** 2
    j = np.eye(30) - 1 / 30
    w, v = np.linalg.eigh(-0.5 * j @ d @ j)
    want = v[:, ::-1][:, :2] * np.sqrt(w[::-1][:2])
    got = points(scaling.mds(frame(spark, x), metric=metric), 30)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_perplexity():
    r = np.random.default_rng(3)
    d = r.exponential(2.0, (40, 30)) ** 2
    p = scaling.conditional(d, 7.0)
    assert np.allclose(p.sum(1), 1)
    assert np.allclose(np.exp(-(p * np.log(p + 1e-300)).sum(1)), 7.0, atol=1e-4)
    few = np.where(np.arange(30) < 4, d, np.inf)
    assert np.allclose(scaling.conditional(few, 4.0)[:, :4], 0.25, atol=1e-3) and (scaling.conditional(few, 3.0)[:, 4:] == 0).all()
    assert np.allclose(scaling.conditional(np.zeros((2, 5)), 5.0), 0.2)


def test_neighbours(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scaling, "BLOCK_ROWS", 16)
    x = np.random.default_rng(4).normal(size=(50, 3))
    x[7] = x[9]
    rows = frame(spark, x).withColumnRenamed("idx", "at")
    scaling._blocks(rows, str(tmp_path))
    got = scaling.neighbour_probabilities(rows, 50, perplexity=4.0, metric="euclidean", folder=str(tmp_path)).collect()
    d = pairwise(x) ** 2
    np.fill_diagonal(d, np.inf)
    for i in range(50):
        near = np.lexsort((np.arange(50), d[i]))[:12]
        mine = {r.b: r.p for r in got if r.a == i}
        assert sorted(mine) == sorted(near.tolist())
        assert np.allclose([mine[j] for j in near], scaling.conditional(d[i][None, near], 4.0)[0], atol=1e-5)


@pytest.mark.parametrize("k", [1, 5, 12, 30])
def test_nearer_with_ties(k):
    """Against sorting all: equal distances, rows with fewer than k others, blocks of several sizes."""
    d = np.random.default_rng(k).integers(0, 6, (20, 25)).astype(np.float64)
    d[3], d[4, :24] = np.inf, np.inf
    near, ids = np.full((20, k), np.inf), np.full((20, k), -1)
    for first, last in ((0, 4), (4, 15), (15, 25)):
        near, ids = scaling.nearer(near, ids, d[:, first:last].copy(), np.arange(first, last))
    for i in range(20):
        want = [j for j in np.lexsort((np.arange(25), d[i])) if np.isfinite(d[i, j])][:k]
        assert ids[i][np.isfinite(near[i])].tolist() == want and near[i][np.isfinite(near[i])].tolist() == d[i, want].tolist()


def test_neighbours_in_many_tasks(spark, monkeypatch, tmp_path):
    """However few files the rows lie in, a task finds the neighbours of TASK_ROWS rows."""
    monkeypatch.setattr(scaling, "TASK_ROWS", 10)
    rows = frame(spark, np.random.default_rng(8).normal(size=(50, 3))).withColumnRenamed("idx", "at").coalesce(1)
    assert scaling.neighbour_probabilities(rows, 50, perplexity=4.0, metric="euclidean", folder=str(tmp_path)).rdd.getNumPartitions() == 5


def test_repulsion_is_exact_for_single_cells():
    r = np.random.default_rng(5)
    y = r.uniform(-1, 1, (40, 2)) * 30
    force, total = np.zeros((40, 2)), 0.0
    for i in range(40):
        for j in range(40):
            if i != j:
                q = 1 / (1 + ((y[i] - y[j]) ** 2).sum())
                total += q
                force[i] += q * q * (y[i] - y[j])
    got, norm = zip(*[scaling.repulsion(y, s) for s in (slice(0, 15), slice(15, 40))], strict=True)
    assert sum(norm) == pytest.approx(total, rel=1e-2) and np.allclose(np.concatenate(got), force, atol=2e-2 * np.abs(force).max())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_clusters_stay_apart(spark, metric):
    r = np.random.default_rng(6)
    centres = np.eye(3, 12) * 8
    x = np.concatenate([c + r.normal(size=(40, 12)) * 0.4 for c in centres])
    got = points(scaling.tsne(frame(spark, x, [(1000, None)]), metric=metric, perplexity=10, iterations=250), 120)
    d = pairwise(got)
    np.fill_diagonal(d, np.inf)
    assert np.mean(d.argmin(1) // 40 == np.arange(120) // 40) > 0.98
    inside = max(np.median(pairwise(got[k * 40 : k * 40 + 40])) for k in range(3))
    means = np.array([got[k * 40 : k * 40 + 40].mean(0) for k in range(3)])
    assert pairwise(means)[np.triu_indices(3, 1)].min() > 1.5 * inside


def test_small_tsne(spark):
    x = np.random.default_rng(7).normal(size=(3, 4))
    assert points(scaling.tsne(frame(spark, x), iterations=3), 3).shape == (3, 2)
    assert scaling.tsne(frame(spark, x[:1]), iterations=2).count() == 1 and scaling.tsne(frame(spark, x).limit(0), iterations=1).count() == 0


def test_plot_module(spark):
    rows = lambda p: spark.createDataFrame([(i, f"{p}{i}", 100 - i, [float(i), 1.0, float(i % 3)]) for i in range(9)], "idx bigint, word string, count bigint, vector array<double>")
    t = modules.TYPES["visualization.embeddings_plot"]
    options = {k: t.options[k](v) for k, v in {"words": "4", "skip": "1", "metric": "manhattan", "reduction": "mds", "colors": "r,g"}.items()}
    got = t.run(spark, {"vectors": [rows("en_"), rows("de_")]}, options)["data"].collect()
    assert sorted((x.label, x.colour) for x in got) == sorted([(f"en_{i}", "r") for i in range(1, 5)] + [(f"de_{i}", "g") for i in range(1, 5)])
    options = {k: t.options[k](v) for k, v in {"words": "2", "cmap": '{"en_": "y"}', "reduction": "tsne"}.items()}
    got = t.run(spark, {"vectors": [rows("en_"), rows("de_")]}, options)["data"].collect()
    assert sorted((x.label, x.colour) for x in got) == [("0", "y"), ("1", "y"), ("de_0", "b"), ("de_1", "b")] and all(x.x is not None and x.y is not None for x in got)
    with pytest.raises(ValueError):
        t.options["reduction"]("pca")
