"""Shingle overlap against brute force."""

import random

import numpy as np
import pytest
from test_pairs import brute_components

from corpuskiln.llm import overlap


def brute_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(seed):
    r, out = random.Random(seed), []
    line = [f"c{i}" for i in range(12)]
    for _ in range(30):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([3, 20, 60, 150, 400]))] + (line if r.random() < 0.5 else [])
        out.append(base)
        for _ in range(r.randint(0, 6)):
            copy = list(r.choice(out[-4:]))
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(4000)}"
            out.append(copy[: len(copy) - r.choice([0, 0, 1, 9])] or copy)
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_packed_sets():
    for n in (0, 1, 500):
        s = overlap.shingle_set(" ".join(map(str, range(n))).encode())
        assert (overlap.unpack_set(overlap.pack_set(s)) == s).all()


@pytest.mark.parametrize("neighbours", [2, 1])
def test_near_copies(spark, neighbours, monkeypatch):
    monkeypatch.setattr(overlap, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(overlap, "ACROSS", (1, None))
    rows = [*edited(neighbours), (9001, None), (9000, ""), (9002, "two words"), (9003, "Two  WORDS")]
    sets = {i: brute_set(t) for i, t in rows}
    want = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in overlap.near_copies(docs).collect()} == want
    assert {r.doc_id for r in overlap.keep_one(docs).collect()} == set(want.values())


def test_large_group_costs_few_pairs():
    """Copies of one text in a list are paired with their neighbours only; connected ones give no further pair."""
    n = 2000
    rows = np.stack((np.full(n, 7), np.full(n, 300), np.zeros(n, np.int64), np.arange(n) % 5, np.arange(n)))
    pairs, on = overlap._neighbour_pairs(rows, 0.8)
    assert pairs.shape[1] < overlap.NEIGHBOURS * n and on.shape[1] == n
    on = np.concatenate((on, np.zeros((overlap.SIGNATURE, n), np.int64)))
    on[3] = 0
    assert overlap._cross_pairs(None)(on, 0.8)[0].shape[1] == 0
    on[3, :3] = 1
    assert overlap._cross_pairs(None)(on, 0.8)[0].shape[1] == 3 * (n - 3)
    assert overlap._cross_pairs(16)(on, 0.8)[0].shape[1] <= 6 * 16
    on[5:8, :3] = -1  # 192 bits differ, more than two sets of 300 may
    assert overlap._cross_pairs(None)(on, 0.8)[0].shape[1] == 0


def test_signature_bounds_the_difference():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(400) for _ in range(r.randrange(200))]
        x, y = (overlap.shingle_set(" ".join(map(str, w)).encode()) for w in (a, a[: r.randrange(201)] + [r.randrange(400) for _ in range(r.randrange(40))]))
        bits = np.bitwise_count((overlap.signature(x) ^ overlap.signature(y)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_near_copies_edges(odd, none):
    assert overlap.keep_one(none).count() == 0
    assert overlap.keep_one(odd).where("doc_id is null").count() == 2


def test_pipeline_drops_edited_copies(spark, sf):
    """A copy with one word of sixty changed shares 51 of 61 shingles; the fingerprints often differ in more than 3 bits."""
    import corpus_pipeline

    r, rows = random.Random(1), []
    for i in range(40):
        w = [f"w{r.randrange(9999)}" for _ in range(60)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:30], "changed", *w[31:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == list(range(0, 80, 2))


def test_pipeline_links_by_fingerprint_too(spark, sf):
    """Fingerprints count repeats, sets don't: 1 and 2 are linked by the former only, 2 and 3 by the latter only."""
    import corpus_pipeline
    from corpuskiln.llm import simhash

    base = "one two three four five six seven "
    tails = [" ".join(f"{x}{i}" for i in range(200)) for x in "abc"]
    texts = [base * 100 + tails[0], base * 100 + tails[1], base + tails[1], tails[2], None]
    docs = spark.createDataFrame([(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = lambda df: {r.doc_id: r.component_id for r in df.collect()}
    assert found(simhash.near_duplicates(docs, shingle=5)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert found(overlap.near_copies(docs)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert found(simhash.near_copies(docs, similarity=0.8)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [1, 4, 5]
