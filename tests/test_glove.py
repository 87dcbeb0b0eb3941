"""Global vectors against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import glove
from corpuskiln.plans import modules


def plain(word, context, w, c, x, o):
    """AdaGrad, one count after the other, by scalars."""
    loss = 0.0
    for i, j, n in zip(w, c, x, strict=True):
        a, b = word.values[i].tolist(), context.values[j].tolist()
        error = sum(p * q for p, q in zip(a[:-1], b[:-1], strict=True)) + a[-1] + b[-1] - math.log(n)
        f = min(1.0, (n / o.x_max) ** o.alpha)
        loss += 0.5 * f * error * error
        for k in range(o.size + 1):
            for block, row, other in ((word, i, b), (context, j, a)):
                g = o.eta * f * error * other[k] if k < o.size else o.eta * f * error
                if k < o.size:
                    g = min(max(g, -o.grad_clip), o.grad_clip)
                block.values[row, k] -= g / math.sqrt(block.sums[row, k])
                block.sums[row, k] += g * g
    return loss


@pytest.mark.parametrize("o", [glove.Options(4), glove.Options(3, x_max=5.0, alpha=0.5, eta=0.2, grad_clip=0.01)])
def test_one_at_a_time(o):
    r = np.random.default_rng(1)
    w, c, x = r.integers(0, 6, 80), r.integers(0, 5, 80), r.uniform(0.1, 30, 80)
    make = lambda: (glove.Block.new(0, 0, 6, o.size, 3), glove.Block.new(1, 0, 5, o.size, 3))
    (a, b), (p, q) = make(), make()
    assert glove.fit_cell(a, b, w, c, x, o, batch=1) == pytest.approx(plain(p, q, w, c, x, o), rel=1e-12)
    for one, two in ((a, p), (b, q)):
        assert np.allclose(one.values, two.values, atol=1e-12) and np.allclose(one.sums, two.sums, atol=1e-12)


def test_batches_add_gradients_up():
    """In a batch the steps of a word are those of its counts at the same values."""
    o = glove.Options(3)
    w, c, x = np.array([0, 1, 0]), np.array([2, 2, 1]), np.array([4.0, 9.0, 200.0])
    a, b = glove.Block.new(0, 0, 2, 3, 5), glove.Block.new(1, 0, 3, 3, 5)
    v, u = a.values.copy(), b.values.copy()
    glove.fit_cell(a, b, w, c, x, o, batch=3)
    step, square = np.zeros_like(v), np.zeros_like(v)
    for i, j, n in zip(w, c, x, strict=True):
        g = o.eta * min(1, (n / 100) ** 0.75) * (v[i, :3] @ u[j, :3] + v[i, 3] + u[j, 3] - math.log(n)) * np.append(u[j, :3], 1.0)
        step[i] += g
        square[i] += g * g
    assert np.allclose(a.values, v - step) and np.allclose(a.sums, 1 + square)


@pytest.mark.parametrize("rows", [7, 1 << 16, 1 << 17])
def test_groups(rows):
    """A batch's counts are put in order once for each side, whatever the width of the index."""
    index = np.append(np.random.default_rng(2).integers(0, rows, 500) // 3, [rows - 1, 0, rows - 1])
    some, order, first = glove._groups(index, rows)
    assert some.tolist() == sorted(set(index.tolist()))
    ends = np.append(first, len(index)).tolist()
    assert [order[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)] == [np.flatnonzero(index == v).tolist() for v in some]


def grid(rows, n_words, n, size, epochs, seed):
    """The rounds of the grid in one process."""
    o = glove.Options(size)
    length = lambda i: len(range(i, n_words, n))
    word, context = ([glove.Block.new(s, i, length(i), size, seed) for i in range(n)] for s in (0, 1))
    losses = []
    for _ in range(epochs):
        losses.append(0.0)
        for shift in range(n):
            for i in range(n):
                j = (i + shift) % n
                mine = [(a // n, b // n, x) for a, b, x in rows if a % n == i and b % n == j]
                if mine:
                    losses[-1] += glove.fit_cell(word[i], context[j], *(np.array(v) for v in zip(*mine, strict=True)), o)
    return word, context, losses


@pytest.mark.parametrize("n", [1, 3])
def test_train_equals_one_process(spark, n):
    r = np.random.default_rng(n)
    pairs = {(int(a), int(b)): float(x) for a, b, x in zip(r.integers(0, 20, 150), r.integers(0, 20, 150), r.uniform(0.2, 60, 150), strict=True)}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in pairs.items()] + [(1, 2, 0.0), (1, 25, 3.0), (None, 2, 1.0), (-1, 0, 2.0)], "w1 bigint, w2 bigint, weight double").repartition(4)
    rows = df.where("weight > 0 and w1 between 0 and 19 and w2 < 20").select("w1", "w2", "weight").orderBy(F.xxhash64(F.lit(4), F.expr(f"w1 div {n}"), F.expr(f"w2 div {n}")))
    word, context, losses = grid([tuple(x) for x in rows.collect()], 20, n, 5, 3, 4)
    got, seen = glove.train(df, 20, size=5, iterations=3, seed=4, blocks=n)
    assert seen == pytest.approx(losses) and seen[0] > seen[1] > seen[2]
    found = {x.idx: x for x in got.collect()}
    assert sorted(found) == list(range(20))
    for i in range(20):
        assert np.allclose(found[i].vector, word[i % n].values[i // n, :-1]) and np.allclose(found[i].context, context[i % n].values[i // n, :-1])


def test_groups_come_together(spark):
    """Words of two groups that occur among themselves only: neighbours are of the own group."""
    r = np.random.default_rng(0)
    rows = [(a, b, float(r.uniform(20, 40) if a // 10 == b // 10 else r.uniform(0.5, 1.0))) for a in range(20) for b in range(20) if a != b]
    found, losses = glove.train(spark.createDataFrame(rows, "w1 int, w2 int, weight double"), 20, size=6, iterations=60, x_max=10.0, blocks=2)
    v = np.zeros((20, 6))
    for x in found.collect():
        v[x.idx] = np.add(x.vector, x.context)
    v -= v.mean(0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T - 2 * np.eye(20)
    assert all(near[i].argmax() // 10 == i // 10 for i in range(20)) and losses[-1] < losses[0] / 4


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "w1 bigint, w2 bigint, weight double")
    got, losses = glove.train(empty, 3, size=2, iterations=1)
    assert got.count() == 3 and losses == [0.0]
    with pytest.raises(ValueError):
        glove.train(empty, 0)


def test_module(spark):
    t = modules.TYPES["embeddings.glove"]
    from corpuskiln import model

    corpus = spark.createDataFrame([("a", "d", 0, [["x", "y", "x", "z"], ["y", "x"]], None)], f"archive string, doc_name string, doc_ord bigint, sentences array<array<string>>, error {model.ERROR_TYPE}")
    options = {k: t.options[k](v) for k, v in {"vector_size": "4", "iter": "2", "eta": "0.1", "alpha": "0.5", "x_max": "10", "grad_clip": "1", "window_size": "2", "min_count": "2"}.items()}
    rows = t.run(spark, {"text": [corpus]}, options)["embeddings"].collect()
    assert sorted((x.word, x["count"]) for x in rows) == [("x", 3), ("y", 2)] and all(len(x.vector) == 4 for x in rows)


@pytest.mark.parametrize("n", [1, 3])
def test_mirrored_pairs(spark, n):
    """Pairs that stand once are fitted as both directions are (in a cell of one batch the order adds up alike)."""
    r = np.random.default_rng(n)
    half = {(min(a, b), max(a, b)): float(x) for a, b, x in zip(r.integers(0, 20, 90).tolist(), r.integers(0, 20, 90).tolist(), r.uniform(0.2, 60, 90), strict=True)}
    whole = half | {(b, a): x for (a, b), x in half.items()}
    frame = lambda pairs: spark.createDataFrame([(a, b, x) for (a, b), x in pairs.items()], "w1 bigint, w2 bigint, weight double").repartition(3)
    (one, first), (two, second) = glove.train(frame(half), 20, size=5, iterations=2, blocks=n, mirrored=True), glove.train(frame(whole), 20, size=5, iterations=2, blocks=n)
    assert first == pytest.approx(second)
    want = {x.idx: x for x in two.collect()}
    for x in one.collect():
        assert np.allclose(x.vector, want[x.idx].vector) and np.allclose(x.context, want[x.idx].context)
