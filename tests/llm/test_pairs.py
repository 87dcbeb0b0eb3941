"""Decontamination, SimHash, substrings and fingerprints against brute force."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuskiln.llm import components, decontam, fingerprints, queries, simhash, substrings

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, m=13):
    words, hit, found = WORD.findall((text or "").encode().lower()), set(), set()
    for i, item in items:
        own = WORD.findall((item or "").encode().lower())
        k = min(m, len(own))
        wins = {tuple(own[s : s + k]) for s in range(len(own) - k + 1)} if own else set()
        for p in range(len(words) - k + 1 if wins else 0):
            if tuple(words[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add(i)
    return len(words), len(hit), found


def brute_longest(text, items, m=13):
    """Words and place of the longest match that is no shorter than its item's window."""
    words, best = WORD.findall((text or "").encode().lower()), (0, -1)
    for _, item in items:
        own = WORD.findall((item or "").encode().lower())
        for p in range(len(words)):
            for s in range(len(own)):
                n = 0
                while s + n < len(own) and p + n < len(words) and own[s + n] == words[p + n]:
                    n += 1
                if n >= min(m, len(own)) and (n, -p) > (best[0], -best[1]):
                    best = (n, p)
    return best


def small_case(seed, spark):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "B", "c,", "é", "9"]) for _ in range(n))
    items = [(i, text(r.randint(0, 9))) for i in range(6)] + [(7, None), (8, "")]
    docs = [(i, text(r.randint(0, 30))) for i in range(12)] + [(50, None), (51, "")]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(spark, seed, block):
    docs, items, d, b = small_case(seed, spark)
    got = {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in decontam.contamination(d, b, min_words=4, block_bytes=block).collect()}
    assert got == {i: brute_hits(t, items, 4) for i, t in docs}
    for r in decontam.contamination(d, b, min_words=4, block_bytes=block).collect():
        assert (r.longest, r.longest_at) == brute_longest(dict(docs)[r.doc_id], items, 4) and r.n_hit == sum(x.e - x.s for x in r.spans)
    left = {r.doc_id for r in decontam.decontaminate(d, b, min_words=4, block_bytes=block).collect()}
    assert left == {i for i, t in docs for n, h, _ in [brute_hits(t, items, 4)] if not (h > 0 and 20 * h >= n)}


def test_longest_matches(spark):
    docs, items, d, b = small_case(9, spark)
    got = {}
    for r in decontam.longest_matches(d, b, min_words=4).collect():
        got.setdefault((r.item_id, r.item_pos), set()).add((r.n_words, r.doc_id, r.doc_pos))
    want = {}
    for i, item in items:
        own = WORD.findall((item or "").encode().lower())
        need = min(4, len(own))
        for s in range(len(own) - need + 1 if own else 0):
            best = []
            for doc, text in docs:
                w = WORD.findall((text or "").encode().lower())
                for p in range(len(w)):
                    n = 0
                    while s + n < len(own) and p + n < len(w) and own[s + n] == w[p + n]:
                        n += 1
                    best.append((n, doc, p))
            top = max((x[0] for x in best), default=0)
            if top >= need:
                want[(i, s)] = {x for x in best if x[0] == top}
    assert got == want


def test_contamination_edges(spark, odd, none):
    b = spark.createDataFrame([(1, "no id here"), (None, "two words"), (3, None)], "item_id bigint, text string")
    rows = decontam.contamination(odd, b).collect()
    assert len(rows) == odd.count() and {r.n_hit for r in rows if r.doc_id == 9} == {2} and sum(r.n_hit == 3 for r in rows) == 1
    assert [r["items"] for r in rows if r.doc_id == 9] == [[]]
    assert decontam.contamination(none, b).count() == 0
    assert decontam.contamination(odd, b.limit(0)).where("n_hit > 0").count() == 0
    clean = decontam.decontaminate(odd, b)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_contamination_same_rows_for_any_blocks(spark, odd):
    """Null and repeated ids of documents and items; one block and many."""
    r = random.Random(4)
    passage = odd.where("doc_id = 1").first().text
    items = [(1, passage[:200]), (1, passage[:200]), (1, passage[100:400]), (None, "no id here"), (2, "two words"), (3, None), (4, ""), (5, "one"), (5, passage[:100])]
    items += [(10 + i, " ".join(f"w{r.randrange(300)}" for _ in range(20))) for i in range(30)]
    b = spark.createDataFrame(items, "item_id smallint, text string")
    one, many = (decontam.contamination(odd, b, block_bytes=n) for n in (1 << 20, 100))
    assert rows_of(one) == rows_of(many)
    for x in one.join(odd.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        n, hit, found = brute_hits(x.t, items)
        assert (x.n_words, x.n_hit, x["items"]) == (n, hit, sorted(i for i in found if i is not None)) and x.longest >= min(1, hit)
    clean = [decontam.decontaminate(odd, b, block_bytes=n) for n in (1 << 20, 100)]
    assert rows_of(clean[0]) == rows_of(clean[1])
    left = [x.text for x in clean[0].where("doc_id is null").collect()]
    assert left == [None]  # the row without id that an item covers goes


@pytest.mark.parametrize(("kind", "make"), [("string", str), ("int", int), ("date", None)])
def test_contamination_item_types(spark, kind, make):
    b = spark.createDataFrame([(1, "a b c"), (2, "c d")], "item_id bigint, text string")
    b = b.withColumn("item_id", F.date_add(F.lit("2020-01-01"), F.col("item_id").cast("int")) if kind == "date" else F.col("item_id").cast(kind))
    row = decontam.contamination(spark.createDataFrame([("x", "a b c d")], "doc_id string, text string"), b, min_words=2).first()
    assert row.doc_id == "x" and len(row["items"]) == 2 and (row.n_hit, row.longest, row.longest_at) == (4, 3, 0)


def test_contamination_repeated_words():
    """Neither repeated words nor a long copy make work for each pair of suffix and place."""
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.monotonic()
    for item, text, want in [("a " * 2000, "a " * 8000, (8000, 2000)), (" ".join(map(str, range(30_000))), "x " + " ".join(map(str, range(30_000))), (30_000, 30_000))]:
        test = decontam.TestSuffixes.build([item.encode()], 13)
        hits = decontam.Hits([text.encode(), None, b"y"])
        hits.add(test, pa.array([7]))
        assert (int(hits.merged_spans()[0][0]), int(hits.longest[0])) == want
        assert hits.item_lists(pa.int64()).to_pylist() == [[7], [], []]
    assert tracemalloc.get_traced_memory()[1] < 150e6 and time.monotonic() - start < 60
    tracemalloc.stop()


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    part = {n: n for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash_fingerprints(odd):
    got = sorted((r.doc_id or -1, r.fp) for r in simhash.fingerprints(odd).collect())
    assert got == sorted((r.doc_id or -1, int(np.uint64(brute_simhash(r.text)).astype(np.int64))) for r in odd.collect())


def test_steiner_blocks():
    """Any 5 of the 8 positions contain exactly one block, so that every pair sharing 5 bytes meets."""
    from itertools import combinations

    blocks = [set(b) for b in simhash.steiner_blocks()]
    assert len(blocks) == simhash.FIRST and all(sum(b <= set(c) for b in blocks) == 1 for c in combinations(range(8), 5))


def clustered(seed):
    """Fingerprints in chains of few differing bits, and a dense cluster that shares 4 bytes."""
    r, fps = random.Random(seed), []
    for _ in range(25):
        fps.append(r.getrandbits(64))
        for _ in range(r.randint(0, 12)):
            x = r.choice(fps[-6:])
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    base = r.getrandbits(64)
    for _ in range(80):
        x = base
        for _ in range(r.randint(0, 9)):
            x ^= 1 << r.randrange(20)
        fps.append(x)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize(("pairwise", "long"), [(1024, 1 << 18), (4, 1 << 18), (4, 6), (1024, 6)])
def test_simhash_links(spark, pairwise, long, monkeypatch):
    """The same links however lists are cut or posted again."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "LONG", long)
    fps = clustered(5)
    posts, edges, rounds = [(c, f) for f in fps for c in range(simhash.FIRST)], set(), 0
    while posts:
        rows = np.array([[c, int(np.uint64(f).astype(np.int64))] for c, f in posts])
        rows = rows[np.lexsort((rows[:, 1].view(np.uint64) & simhash.MASKS[rows[:, 0]], rows[:, 0]))]
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 41, i]) for i in range(2)], ["c", "fp"]) for k in range(0, len(rows), 41)]
        posts, rounds = [], rounds + 1
        for x in simhash._link_lists(iter(batches)):
            for a, b, c, f in zip(*(x.column(i).to_pylist() for i in range(4)), strict=True):
                if c is None:
                    edges.add((a % (1 << 64), b % (1 << 64)))
                else:
                    posts.append((c, f % (1 << 64)))
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert brute_components(fps, lambda a, b: (a, b) in edges or (b, a) in edges) == want
    assert (rounds == 3) == (long == 6) and len(edges) <= 14 * 16 * len(fps)


def test_simhash_tally_rejects():
    """Most pairs of a posting list share 4 bytes by chance and fall to the tally, before any bits are counted."""
    r = np.random.default_rng(1)
    x, y = r.integers(0, 1 << 63, (2, 20_000), np.uint64)
    y = (y & ~simhash.MASKS[0]) | (x & simhash.MASKS[0])
    tally = ((x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    assert (tally >= 4).all() and 0 < (tally >= simhash.SHARED).mean() < 0.05 and not simhash._verified(x, y).any()


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = sorted({n for p in pairs for n in p} - {400})
    both = set(pairs) | {(b, a) for a, b in pairs}
    want = brute_components(nodes, lambda a, b: (a, b) in both)
    assert {n: got.get(n, n) for n in nodes} == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(odd, unique, none):
    rows = {r.doc_id: r for r in simhash.near_duplicates(unique).collect()}
    fps = {i: brute_simhash(r.text) for i, r in ((x.doc_id, x) for x in unique.collect())}
    want = brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert {i: r.component_id for i, r in rows.items()} == want
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    text = simhash.near_duplicates(unique.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))).collect()
    assert {int(r.doc_id[1:]): int(r.component_id[1:]) for r in text} == want  # ids of another type
    kept = simhash.keep_one(unique)
    assert kept.columns == unique.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def brute_removed(docs, window=50):
    own = {}
    words = {i: (t or "").encode().split() for i, t in docs if i is not None}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            own.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if own[tuple(w[k : k + window])] < i:
                gone[k : k + window] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 5), (2, 20), (3, 3)])
def test_substrings_small(spark, seed, window):
    r = random.Random(seed)
    base = [r.choice("abcdefgh") for _ in range(400)]
    docs = []
    for i in range(30):
        at, n = r.randrange(300), r.randint(0, 90)
        w = base[at : at + n]
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = "Z"
        docs.append((i, " ".join(w)))
    docs += [(90, "a " * 60), (91, "a " * 80), (92, "a b " * 40)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), window=window).collect()}
    assert got == brute_removed(docs, window)


def test_substrings_edges(odd, unique, none):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(unique).collect()}
    assert got == brute_removed([(r.doc_id, r.text) for r in unique.collect()])
    assert substrings.dedup_substrings(odd).count() == odd.count() and substrings.dedup_substrings(none).count() == 0


def test_substrings_texts_under_one_id(spark):
    """Rows that share an id lose only what a smaller id has as well."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 80), ("b", 61), ("c", 70)))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, a), (3, c + " " + b), (4, c), (None, a), (None, c)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    want = [(1, 80, 0, a), (2, 80, 80, ""), (2, 61, 0, b), (2, 61, 0, b), (3, 80, 80, ""), (3, 131, 61, c), (4, 70, 70, ""), (0, 80, 0, a), (0, 70, 0, c)]
    assert got == sorted(want)


def form(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


@pytest.mark.parametrize("bits", [128, 2])
def test_fingerprints(odd, none, bits):
    """Equal exactly if the canonical texts are, also when digests of 2 bits collide all the time."""
    rows = fingerprints.fingerprints(odd, bits=bits).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(form(r.text))
    by_print = {}
    for r in rows:
        if r.doc_id is not None:
            by_print.setdefault(r.fingerprint, set()).update(texts[r.doc_id])
    assert all(len(v) == 1 for v in by_print.values())
    assert len(by_print) == len(set().union(*[v for k, v in texts.items() if k is not None]))
    assert fingerprints.fingerprints(none, bits=bits).count() == 0
    groups = {r.doc_id: (r.group_id, r.group_size) for r in fingerprints.duplicate_groups(odd).collect()}
    assert groups[10] == (1, 4) == groups[14] and groups[5] == (5, 1)


@pytest.mark.parametrize("bits", [128, 3])
def test_edit_report(unique, odd, none, bits):
    rows = sorted((r.doc_id, r.text or "") for r in unique.collect())
    got = {r.doc_id: r for r in fingerprints.edit_report(unique, bits=bits).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(form(edited) == form(t)), float(form(nxt) == form(t)))
    prints = [got[i].fingerprint for i, _ in rows]
    assert len(set(prints)) == len({form(t) for _, t in rows})
    assert fingerprints.edit_report(odd).count() == odd.count() and fingerprints.edit_report(none).count() == 0


def test_edit_report_least_and_repeated_ids(spark):
    """Null and the least id are different; rows of one id stand in the order of their texts."""
    least = -(1 << 63)
    rows = [(7, "b" * 300), (7, "b" * 20), (7, "a" * 5), (7, None), (least, "least one"), (None, "no id"), (None, "a null"), (9, "nine nine"), (9, "nine nine")]
    got = fingerprints.edit_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(t) == form(nxt))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op7_mix"])
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_query_op2_op4_op8(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf).collect()}
    assert {i: got[i].fingerprint for i, _ in docs} == {i: f"{brute_simhash(t):016x}" for i, t in docs}
    fps = {i: brute_simhash(t) for i, t in docs}
    assert {i: got[i].component_id for i, _ in docs} == brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substrings(spark, sf).collect()} == brute_removed(docs)
    assert queries.op8_fingerprint(spark, sf).where(F.col("fingerprint").isNull()).count() == 0
