"""Corpus, vocabulary, feature and embedding operators on small hand-made inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln import model
from corpuskiln.operators import corpus as ops
from corpuskiln.operators import embeddings as emb
from corpuskiln.operators import features, lookup, mapping, pairs, stats, vocab
from corpuskiln.sources import sinks


def corpus(spark, docs, kind="string", column="text", archive="a"):
    rows = [(archive, f"d{i}", i, d, None if d is not None else ("m", "bad")) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, f"archive string, doc_name string, doc_ord bigint, {column} {kind}, error {model.ERROR_TYPE}")


def tokens(spark, docs):
    return corpus(spark, docs, "array<array<string>>", "sentences")


def names(df):
    return [r.doc_name for r in df.orderBy("doc_ord").collect()]


def test_types():
    t = model.DOC_TYPES
    assert model.is_subtype(t["raw_text"], t["text"]) and not model.is_subtype(t["text"], t["raw_text"])
    assert model.is_subtype(model.annotations_type(["word", "pos", "x"]), model.annotations_type(["word", "pos"]))
    assert not model.is_subtype(model.annotations_type(["word"]), model.annotations_type(["word", "pos"]))
    assert model.common_type([t["text"], t["raw_text"]]) == t["text"]
    with pytest.raises(TypeError):
        model.common_type([t["label"], t["vector"]])
    with pytest.raises(ValueError):
        model.add_annotation_fields(t["tokenized"], ["word"])
    assert model.add_annotation_fields(t["tokenized"], ["pos"]).options == (("fields", ("word", "pos")),)


def test_number_rows_and_group(spark):
    r = random.Random(4)
    keys = [r.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int").repartition(5)
    got = {x.i: x.pos for x in model.number_rows(df, F.col("k"), "i").collect()}
    want = sorted(range(500), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert [got[i] for i in want] == list(range(500))
    joined = {x.i: x.pos for x in model.number_rows(df.withColumn("text", F.lit("t")), F.col("k"), "i", unique=("i",)).collect()}
    assert joined == got
    big = [(1 << 60) + i for i in range(10)]
    ids = {x.i: x.pos for x in model.number_rows(spark.createDataFrame([(i,) for i in reversed(big)], "i bigint").repartition(3), F.col("i")).collect()}
    assert ids == {i: k for k, i in enumerate(big)}  # beyond what a double tells apart
    plan = model.number_rows(df.withColumn("text", F.lit("t")), F.col("k"), "i", unique=("i",))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    empty = model.number_rows(df.limit(0), F.col("k"))
    assert empty.count() == 0 and "pos" in empty.columns
    grouped = ops.group(corpus(spark, ["x"] * 25), 2, "g")
    assert [r.archive for r in grouped.orderBy("doc_ord").collect()][:3] == ["g-00", "g-00", "g-01"]
    assert ops.group(corpus(spark, []), 2).count() == 0


@pytest.mark.parametrize("sizes", [(7, 3), (4, 4), (0, 5), (10, 3, 2)])
def test_interleave_takes_least_progress(spark, sizes):
    parts = [corpus(spark, ["t"] * n, archive=f"x{i}") for i, n in enumerate(sizes)]
    got = [(r.archive, r.doc_name) for r in ops.interleave(parts).orderBy("pos").collect()]
    progress, at, want = [0.0] * len(sizes), [0] * len(sizes), []
    for _ in range(sum(sizes)):
        i = min((i for i in range(len(sizes)) if at[i] < sizes[i]), key=lambda i: (progress[i], i))
        want.append((f"corp{i}_x{i}", f"d{at[i]}"))
        progress[i] += max(sizes) / sizes[i]
        at[i] += 1
    assert got == want
    assert ops.interleave(parts, scaled=True).count() == sum(sizes)


def test_interleave_formula_ignores_size(spark, monkeypatch):
    """Sizes for which the running sum and position / length order a tie otherwise."""
    monkeypatch.setattr(ops, "ONE_TASK", 1, raising=False)

    def order(sizes, scaled):
        rows = []
        for i, n in enumerate(sizes):
            progress = 0.0
            for k in range(n):
                rows.append((k / n if scaled else progress, i, k))
                progress += max(sizes) / n
        return [x[1:] for x in sorted(rows)]

    sizes = next((a, b) for a in range(2, 60) for b in range(2, 60) if order((a, b), True) != order((a, b), False))
    parts = [corpus(spark, ["t"] * n, archive=f"x{i}") for i, n in enumerate(sizes)]
    got = [(r.archive, r.doc_name) for r in ops.interleave(parts).orderBy("pos").collect()]
    assert got == [(f"corp{i}_x{i}", f"d{k}") for i, k in order(sizes, False)]


def test_concat_subset_split_shuffle(spark):
    a, b = corpus(spark, list("abc")), corpus(spark, list("de"), archive="b")
    both = ops.concat([a, b])
    assert [(r.archive, r.text) for r in both.orderBy("doc_ord").collect()] == [("corpus0_a", "a"), ("corpus0_a", "b"), ("corpus0_a", "c"), ("corpus1_b", "d"), ("corpus1_b", "e")]
    with pytest.raises(TypeError):
        ops.concat([a, tokens(spark, [[["x"]]])])
    gaps = corpus(spark, ["a", None, "b", None, "c", "d"])
    assert names(ops.subset(gaps, 2, 1)) == ["d1", "d2"]
    assert names(ops.subset(gaps, 2, 1, skip_invalid=True)) == ["d2", "d4"]
    assert names(ops.subset(gaps, 99, 5)) == ["d5"] and names(ops.subset(gaps, 1, 50)) == []
    big = corpus(spark, ["x"] * 100)
    for size, n in ((0.3, 30), (7, 7), (1.0, 100), (500, 100)):
        one, two = ops.split(big, size)
        assert (one.count(), two.count()) == (n, 100 - n) and not set(names(one)) & set(names(two))
    mixed = ops.shuffle(big)
    assert sorted(names(mixed)) == sorted(names(big)) and names(mixed) != names(big) and names(mixed) == names(ops.shuffle(big))
    assert 5 < ops.subsample(big, 0.2).count() < 40 and ops.subsample(corpus(spark, []), 5).count() == 0


def test_filter_align_unique(spark):
    c = corpus(spark, list("abcd"))
    keep, rest = ops.list_filter(c, spark.createDataFrame([("d1",), ("d3",), ("d3",), ("no",)], "value string"))
    assert (names(keep), names(rest)) == (["d1", "d3"], ["d0", "d2"])
    labels = corpus(spark, ["x", "y", "z"], column="label")
    assert ops.align([c, labels], strict=False).count() == 3
    with pytest.raises(Exception, match="not in all corpora"):
        ops.align([c, labels]).collect()
    with pytest.raises(Exception, match="repeated document"):
        model.check_unique(c.union(c)).collect()


def test_vocabulary_rules(spark):
    docs = [[["b", "a", "b"], []], [["a", "c"]], [["a", "d", "b"]], None, [[]]]
    c = tokens(spark, docs)
    words = lambda v: [(r.id, r.token, r.df) for r in v.words.orderBy("id").collect()]
    assert words(vocab.build(c)) == [(0, "b", 2), (1, "a", 3), (2, "c", 1), (3, "d", 1)]
    v = vocab.build(c, threshold=2, max_prop=0.5, include=["zz", "a", "b"], oov="OOV")
    assert words(v) == [(0, "b", 2), (1, "zz", 0), (2, "OOV", 3)]
    assert [r.token for r in v.stopwords.collect()] == ["a"]
    assert words(vocab.build(c, limit=2)) == [(0, "b", 2), (1, "a", 3)]
    assert words(vocab.build(c, stopwords=spark.createDataFrame([("b",)], "token string"))) == [(0, "a", 3), (1, "c", 1), (2, "d", 1)]
    assert vocab.build(c).stats.first().asDict() == {"num_docs": 4, "num_pos": 8, "num_nnz": 7}
    assert words(vocab.build(tokens(spark, []))) == []


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_vocabulary_mapping(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "FILE_ROWS", limit)
    c = tokens(spark, [[["b", "x", "a"], [], ["x"]], None, [], [[]]])
    words = spark.createDataFrame([(0, "b", 1), (1, "a", 1)], "id int, token string, df bigint")
    ids = lambda df: [r.lists for r in df.orderBy("doc_ord").collect()]
    mapped = vocab.map_tokens(c, words)
    assert ids(mapped) == [[[0, 2, 1], [], [2]], None, [], [[]]]
    assert ids(vocab.map_tokens(c, words, "skip")) == [[[0, 1]], None, [], []]
    assert ids(vocab.map_tokens(c, words, "a")) == [[[0, 1, 1], [], [1]], None, [], [[]]]
    with pytest.raises(ValueError):
        vocab.map_tokens(c, words, "none")
    back = lambda df: [(r.sentences, r.error is None) for r in df.orderBy("doc_ord").collect()]
    assert back(vocab.unmap_ids(mapped, words, "?")) == [([["b", "?", "a"], [], ["?"]], True), (None, False), ([], True), ([[]], True)]
    assert back(vocab.unmap_ids(mapped, words, "skip"))[0] == ([["b", "a"]], True)
    assert back(vocab.unmap_ids(mapped, words))[0] == (None, False)
    assert [(r.id, r.freq) for r in vocab.count(mapped, words, oov_excluded=True).orderBy("id").collect()] == [(0, 1), (1, 1), (2, 2)]


def test_stats(spark):
    got = stats.corpus_stats(tokens(spark, [[["ab", "c"], []], [["d"]], None])).first().asDict()
    assert (got["types"], got["tokens"], got["sentences"], got["characters"]) == (3, 3, 3, 4)
    assert (got["min_chars_per_sent"], got["max_chars_per_sent"], got["mean_sents_per_doc"]) == (-1, 4, 1.5)
    assert stats.corpus_stats(tokens(spark, [])).first()["mean_tokens_per_doc"] is None
    labels = spark.createDataFrame(list(enumerate("aabba")), "i int, label string")
    assert sorted(tuple(r) for r in stats.slice_sizes(labels, "i").collect()) == [(0, "a", 2), (1, "b", 2), (2, "a", 1)]
    assert stats.lengths(tokens(spark, [[["a"]], None])).first().asDict() == {"length": 2, "valid_documents": 1, "n_invalid": 1}


def test_embeddings(spark):
    e = spark.createDataFrame([(0, "a", 5, [3.0, 4.0]), (1, "b", 9, [0.0, 0.0]), (2, "c", 1, [6.0, 8.0]), (3, "d", 1, [1.0, 0.0])], "idx bigint, word string, count bigint, vector array<double>")
    scaled = {r.word: r.vector for r in emb.l2_normalize(e).collect()}
    assert scaled["a"] == [0.6, 0.8] and scaled["b"][0] != scaled["b"][0]
    near = [tuple(r)[:3] for r in emb.nearest(e.where("idx = 0"), e, 2).orderBy("rank").collect()]
    assert near == [(0, 1, 2), (0, 2, 3)]
    d = {(r.a, r.b): r.distance for r in emb.pairwise(e, "manhattan").collect()}
    assert d[(0, 3)] == 6.0
    with pytest.raises(ValueError):
        emb.pairwise(e, most=2)
    found = emb.doc_vectors(tokens(spark, [[["a", "zz"]]]), e).first().vectors
    assert found == [[3.0, 4.0], None]
    assert [r.idx for r in emb.concat([e, e]).orderBy("idx").collect()] == list(range(8))


def test_matcher(spark):
    s = [[("what", "WP"), ("meals", "NNS"), ("come", "VB"), ("with", "IN"), ("fries", "NNS")], [("what", "WP")]]
    c = corpus(spark, [s, None], "array<array<struct<word:string,pos:string>>>", "sentences")
    got = features.match_annotations(c, "what a=pos:pos[NN*] come with b=pos[NN*] | x=meals").orderBy("alternative").collect()
    assert [(r.start, [tuple(k) for k in r.kv]) for r in got] == [(0, [("a", "NNS"), ("b", "fries")]), (1, [("x", "meals")])]
    with pytest.raises(ValueError):
        features.parse_pattern("nothing taken")


def test_features(spark):
    kv = spark.createDataFrame([(0, 0, [("term", "t"), ("k", "v"), ("k", "v")]), (0, 1, [("k", "v")])], "doc_ord bigint, point int, kv array<struct<key:string,value:string>>")
    got = features.term_feature_list(kv, include_feature_keys=True).collect()
    assert [(r.term, r.features) for r in got] == [("t", {"k_v": 2})]
    toks = spark.createDataFrame([(["a", "b", "a"],)], "tokens array<string>")
    assert {(r.w1, r.w2): r.weight for r in features.cooccurrence(toks, 2).collect()} == {("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "a"): 1.0}
    dep = corpus(spark, [[[("dogs", "N", "2", "subj"), ("bark", "V", "0", "root")]]], "array<array<struct<word:string,pos:string,head:string,deprel:string>>>", "sentences")
    assert {(r.term, r.feature) for r in features.dependency_features(dep).collect()} == {("dogs", "subj_bark"), ("bark", "subjI_dogs")}


def test_resume_and_doc2bow(spark):
    c = corpus(spark, list("abc"))
    assert names(ops.after(c, "a", "d0")) == ["d1", "d2"]
    with pytest.raises(ValueError):
        ops.after(c, "a", "none")
    words = spark.createDataFrame([(0, "b", 1)], "id int, token string, df bigint")
    known, missing = vocab.doc2bow(tokens(spark, [[["b", "x", "b"]], None]), words)
    assert [tuple(r) for r in known.collect()] == [(0, 0, 2)] and [tuple(r) for r in missing.collect()] == [(0, "x", 1)]


def test_annotator_without_library(spark):
    from corpuskiln.operators import annotators

    with pytest.raises(Exception, match="spacy"):
        mapping.map_documents(corpus(spark, ["a b"]), annotators.spacy_tokenizer()).collect()
    plug = annotators.external("up", "text string", lambda: str.upper, lambda f, d: {"text": f(d["text"])})
    assert mapping.map_documents(corpus(spark, ["a b"]), plug).first().text == "A B"


def test_map_documents(spark):
    def upper(state, doc):
        if doc["text"] == "boom":
            raise ValueError("no")
        if doc["text"] == "skip":
            raise mapping.SkipDocument
        return {"out": doc["text"].upper()}

    c = corpus(spark, ["a", "boom", "skip", None])
    got = mapping.map_documents(c, mapping.MapPlan("up", "out string", upper, allow_skip=True)).orderBy("doc_ord").collect()
    assert [(r.doc_name, r.out, r.error.module_name if r.error else None) for r in got] == [("d0", "A", None), ("d1", None, "up"), ("d3", None, "m")]
    batch = mapping.MapPlan("b", "out string", process_batch=lambda s, docs: [{"out": d["text"] * 2} for d in docs])
    assert mapping.map_documents(c, batch).where("error is null").count() == 3


def test_shuffle_linear(spark):
    c = corpus(spark, [f"t{i}" for i in range(60)])
    rows = ops.shuffle_linear(c, 3, bin_size=10).orderBy("pos").collect()
    assert sorted(r.text for r in rows) == sorted(f"t{i}" for i in range(60)) and [r.pos for r in rows] == list(range(60))
    assert [r.text for r in rows] != [f"t{i}" for i in range(60)]
    assert [r.text for r in ops.shuffle_linear(c, 3, bin_size=10).orderBy("pos").collect()] == [r.text for r in rows]
    one = ops.shuffle_linear(c, 3, num_bins=1).orderBy("pos").collect()
    assert [r.text for r in one] == [r.text for r in ops.shuffle(c, 3).orderBy("pos").collect()]


def test_lookup_branches_agree(spark, monkeypatch):
    """A vocabulary in one file and one in a file for each word give the same rows, invalid documents, empty sentences and
    nulls too."""
    bad = ("m", "info")
    rows = [("a", "1", 1, [["x", "y"], [], ["q"]], None), ("a", "2", 2, [["x"]], bad), ("a", "3", 3, [], None), ("a", "4", 4, None, bad), ("a", "5", 5, None, None), ("a", "6", 6, [None, ["x", None, "q"]], None)]
    c = spark.createDataFrame(rows, "archive string, doc_name string, doc_ord bigint, sentences array<array<string>>, error struct<module_name:string,error_info:string>")
    words = spark.createDataFrame([(0, "x", 1), (1, "y", 1)], "id int, token string, df bigint")
    for oov in (None, "skip", "y"):
        found = []
        for limit in (1_000_000, 1):
            monkeypatch.setattr(lookup, "FILE_ROWS", limit)
            ids = vocab.map_tokens(c, words, oov)
            found.append((sorted(map(str, ids.select("doc_name", "lists", "error").collect())), sorted(map(str, vocab.unmap_ids(ids, words).select("doc_name", "sentences", "error.module_name").collect()))))
        assert found[0] == found[1]
        assert "Row(doc_name='2', lists=None" in found[0][0][1]
        assert "Row(doc_name='5', lists=None" in found[0][0][4]
        assert {"skip": "lists=[[0]]", "y": "lists=[None, [0, 1, 1]]", None: "lists=[None, [0, 2, 2]]"}[oov] in found[0][0][5]


def test_repeated_order_is_an_error(spark):
    """Rows of one doc_ord would be joined with each other's numbers."""
    twice = corpus(spark, ["x", "y", "z"]).withColumn("doc_ord", F.when(F.col("doc_ord") == 2, 1).otherwise(F.col("doc_ord")).cast("bigint"))
    for make in (lambda: ops.split(twice, 0.5)[0], lambda: ops.shuffle(twice)):
        with pytest.raises(ValueError, match="repeat"):
            make().collect()


@pytest.mark.parametrize("at_once", [3, 4096])
def test_window_counts(monkeypatch, at_once):
    """Windows with each pair of words, by looking at every window."""
    monkeypatch.setattr(features, "WINDOWS_AT_ONCE", at_once)
    r = random.Random(at_once)
    for _ in range(60):
        code = [r.choice([-1, -1, 0, 1, 2, 4]) for _ in range(r.randint(1, 30))]
        window = r.randint(1, 12)
        sets = [{w for w in code[i : i + window] if w >= 0} for i in range(max(len(code) - window + 1, 1))]
        want = {(a, b): n for a in range(5) for b in range(a, 5) if (n := sum(a in s and b in s for s in sets))}
        key, n = features._windows_with(np.array(code), 5, window)
        got: dict = {}
        for k, x in zip(key.tolist(), n.tolist(), strict=True):
            got[divmod(k, 5)] = got.get(divmod(k, 5), 0) + x
        assert got == want


def test_sorted_table(spark, monkeypatch):
    """Keys of one hash are told apart; files without keys, repeated, null and unknown keys."""
    monkeypatch.setattr(lookup, "FILE_ROWS", 3)
    table = spark.createDataFrame([(f"k{i}", [float(i)]) for i in range(20)] + [(None, [9.0]), ("", [-1.0]), ("é", None)], "key string, value array<double>")
    found = lookup.write(table, "key", "value")
    assert (found.rows, found.files) == (22, 8)
    keys = pa.array(["k3", None, "zz", "", "k3", "é", "k19"])
    assert found.find(keys).to_pylist() == [[3.0], None, None, [-1.0], [3.0], None, [19.0]]
    assert found.find(pa.array([], pa.string())).to_pylist() == []
    same = lookup.SortedTable("", 1, 3, pa.string(), pa.int64())
    same._open[0] = (np.array([lookup.xxhash.xxh64_intdigest(b"b", 42)] * 3, np.uint64).view(np.int64), pa.array(["a", "b", "c"]), pa.array([1, 2, 3]))
    assert same.find(pa.array(["b", "a"])).to_pylist() == [2, None]
    numbers = lookup.write(spark.range(5).select("id", (F.col("id") * 2).alias("v")), "id", "v")
    assert numbers.find(pa.array([4, 7, 0])).to_pylist() == [8, None, 0]
    nothing = lookup.write(table.limit(0), "key", "value")
    assert nothing.find(keys).null_count == len(keys)


def test_map_keeps_integers(spark):
    """A null integer reaches the function as None, others as int."""
    seen = spark.createDataFrame([("a", "1", 1, 5, None), ("a", "2", 2, None, None)], "archive string, doc_name string, doc_ord bigint, n bigint, error struct<module_name:string,error_info:string>")
    out = mapping.map_documents(seen, mapping.MapPlan("t", "kind string", lambda state, doc: {"kind": f"{type(doc['n']).__name__}"}))
    assert [r.kind for r in out.orderBy("doc_ord").collect()] == ["int", "NoneType"]


def test_append_is_checked(spark, tmp_path):
    c = corpus(spark, ["x", "y"])
    path = f"{tmp_path}/c"
    sinks.store(c, path)
    with pytest.raises(Exception, match="repeated document"):
        sinks.store(c, path, append=True)
    assert sinks.store(c.withColumn("doc_name", F.concat(F.lit("n"), "doc_name")), path, append=True).count() == 4


@pytest.mark.parametrize("symmetric,weighting,once", [(True, True, False), (True, False, True), (False, True, False), (True, True, True)])
def test_cooccurrence_of_numbers(spark, symmetric, weighting, once):
    """Pairs in packed blocks: as pairs of rows."""
    r = np.random.default_rng(2)
    docs = [([int(x) for x in r.zipf(1.3, n) % 20_000],) for n in (0, 1, 2, 40, 900)] + [(None,), ([5, None, 5, 19_999, 0, 20_000],)]
    df = spark.createDataFrame(docs, "tokens array<bigint>").repartition(3)
    rows = df.withColumn("tokens", F.transform("tokens", lambda x: F.when(x < 20_000, x)))
    read = lambda x: {(p.w1, p.w2): p.weight for p in x.collect()}
    options = {"symmetric": symmetric, "distance_weighting": weighting, "once": once}
    packed = features.cooccurrence(df, 6, n_words=20_000, **options)
    want, got = read(features.cooccurrence(rows, 6, **options)), read(packed)
    assert got == pytest.approx(want, rel=1e-12) and "HashAggregate" not in packed._jdf.queryExecution().toString()


def test_packed_pairs():
    r = np.random.default_rng(1)
    for n, most in ((1, 2), (300, 40), (3000, 10**12)):
        keys, values = np.unique(r.integers(0, 10**15, n)), r.integers(1, most, n)
        values = values[: len(keys)]
        block = pairs.pack(keys, values)
        assert all((a == b).all() for a, b in zip(pairs.unpack(*block), (keys, values), strict=True))
        assert (pairs.unpack(*pairs.pack(keys, values / 7), np.float64)[1] == values / 7).all()
    dense = np.arange(0, 400_000, 4) + r.integers(0, 4, 100_000)
    assert sum(map(len, pairs.pack(dense, r.integers(1, 16, 100_000))[2:])) < 200_000  # bytes
    keys, totals = pairs.merged([(np.array([1, 5]), np.array([2, 3])), (np.array([0, 5]), np.array([7, 1]))])
    assert keys.tolist() == [0, 1, 5] and totals.tolist() == [7, 2, 4]
