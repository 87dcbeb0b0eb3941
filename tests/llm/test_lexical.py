"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import lexical, queries
from corpuskiln.llm.sql import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, c.total()) for i, c in rows if c]
    n_docs, total = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c, n in rows:
            m = 25 + 75 * n * n_docs // total
            s = sum(a * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, a in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def case(seed, n=80):
    r = random.Random(seed)
    word = lambda: f"{r.choice(['W', 'w'])}{int(r.paretovariate(0.7)) % 90}"
    text = lambda n: "".join(word() + r.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(n)] + [(1000 + i, "w3 w5 é w5") for i in range(15)] + [(2000, None), (2001, "?!"), (2002, "w1 " * 3000)]
    items = [(i, text(r.choice([0, 1, 2, 8, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "w3 É w5 é"), (53, "never seen"), (None, "w7 w2"), (54, "w2"), (54, "w4 w2")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [1, 4, 10])
def test_search(spark, seed, k):
    docs, items = case(seed)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k=k)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_blocks_make_no_difference(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 20)
    monkeypatch.setattr(lexical, "VOCABULARY_ROWS", 7)
    docs, items = case(7)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_join_of_a_block(monkeypatch, cells):
    """Small matrices and small portions of contributions; the k best come out whatever the thresholds start from."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "CONTRIBUTIONS", max(1, cells // 4))
    r = np.random.default_rng(cells)
    n_docs, n_items, n_terms, k = 60, 9, 25, 3
    post = r.random((n_docs, n_terms)) < 0.2
    quotient = r.integers(1, 50, (n_docs, n_terms)) * post
    weight = r.integers(1, 9, (n_items, n_terms)) * (r.random((n_items, n_terms)) < 0.3)
    scores = quotient @ weight.T
    i, t = np.nonzero(weight)
    most = weight[i, t] * quotient.max(0)[t]
    floor = np.array([max([1, *[weight[a, b] * np.sort(quotient[:, b])[-k] for b in range(n_terms)]]) for a in range(n_items)])
    order = np.lexsort((-most, i))
    suffix = np.array([most[order][j:][i[order][j:] == i[order][j]].sum() for j in range(len(i))])
    essential = np.zeros(len(i), bool)
    essential[order] = suffix >= floor[i[order]]
    rest = np.array([most[(i == a) & ~essential].sum() for a in range(n_items)])
    by_term = np.argsort(t, kind="stable")
    table = pa.table({"item": i[by_term], "hash": t[by_term], "weight": weight[i, t][by_term], "essential": essential[by_term], "threshold": floor[i[by_term]], "rest": rest[i[by_term]]})
    block = lexical.QueryBlock(table, k)
    doc, term = np.nonzero(post)
    d, q, s = block.join(n_docs, doc, term, quotient[doc, term])
    for a in range(n_items):
        at = block.items.to_pylist().index(a) if a in block.items.to_pylist() else None
        best = [x for x in sorted(scores[:, a].tolist(), reverse=True) if x > 0][:k]
        assert sorted(s[q == at].tolist(), reverse=True)[:k] == best
        assert all(scores[x, a] == y for x, y in zip(d[q == at], s[q == at], strict=True))
    assert not essential.all()


def test_common_terms_make_no_candidates(spark):
    """Terms below the threshold are not essential, though every document has them."""
    docs = [(i, "the of and " + (f"rare{i} rare " if i < 20 else "")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = lexical.query_terms(spark.createDataFrame([(1, "the rare of and")], "item_id bigint, text string"), "item_id", "text")
    vocabulary, terms_ = lexical.write_vocabulary(asked)
    index = lexical.build_index(df, vocabulary)
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    bounds = lexical.query_bounds(terms_, lexical.term_statistics(index, 10, n_docs, n_terms))
    assert [r.essential for r in bounds.orderBy(F.desc("weight")).collect()][0] is True
    assert bounds.where("essential").count() == 1


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "w5 w7 naïve", "x"), (None, "no id", "y"), (3, None, "z")], "item_id bigint, text string, score string")
    got = lexical.search(odd, items)
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert lexical.search(none, items).count() == 0 == lexical.search(odd, items.limit(0)).count()
    with pytest.raises(ValueError):
        lexical.search(odd, items, k=0)


def test_op11_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.op11_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE_SQL["op11_search"]).fetchall())
