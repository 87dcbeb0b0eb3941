"""Stored forms of trees, entities and scored features, and document types of one's own."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpuskiln import model
from corpuskiln.functions import structures as st


def some_tree(r, depth=0):
    """(label, children) with words as strings."""
    if depth > 5 or r.random() < 0.3:
        return r.choice(["NP", "V", "-LRB-", "é"]), [r.choice(["saw", "him", "🙂", "a/b"]) for _ in range(r.randint(1, 2))]
    return r.choice(["S", "VP", "NP|x"]), [some_tree(r, depth + 1) if r.random() < 0.8 else "w" for _ in range(r.randint(1, 3))]


def bracketed(tree):
    return f"({tree[0]} {' '.join(x if isinstance(x, str) else bracketed(x) for x in tree[1])})"


def words_of(tree):
    return [w for x in tree[1] for w in ([x] if isinstance(x, str) else words_of(x))]


def spans(tree, label, at=0):
    out, start, inside = [], at, []
    for x in tree[1]:
        if isinstance(x, str):
            at += 1
        else:
            found, at = spans(x, label, at)
            inside += found
    if tree[0] == label:
        out.append((start, at - 1))
    return out + inside, at


def test_parse_tree():
    assert st.parse_tree("(S (NP I) (VP (V saw) him))") == {
        "labels": ["S", "NP", None, "VP", "V", None, None],
        "words": [None, None, "I", None, None, "saw", "him"],
        "parents": [-1, 0, 1, 0, 3, 4, 3],
    }
    assert st.parse_tree("( (S x))")["labels"] == ["", "S", None]
    for bad in ("", "x", "(S", "(S x))", "(S)", "(S x) (S y)", "(S x) y", "()", "(S ((V x)))", ")"):
        with pytest.raises(ValueError):
            st.parse_tree(bad)
    deep = "(A " * 20_000 + "x" + ")" * 20_000
    assert st.format_tree(*st.parse_tree(deep).values()) == deep


def test_trees_round_trip(spark):
    r = random.Random(2)
    docs = [[some_tree(r) for _ in range(r.randint(0, 3))] for _ in range(40)]
    rows = [("a", str(i), i, [bracketed(t) for t in d], None) for i, d in enumerate(docs)]
    rows += [("a", "bad", 100, ["(S x)", "(S"], None), ("a", "null", 101, None, None), ("a", "old", 102, None, ("m", "i")), ("a", "none", 103, [None], None)]
    corpus = spark.createDataFrame(rows, f"archive string, doc_name string, doc_ord bigint, trees array<string>, error {model.ERROR_TYPE}").repartition(3)
    parsed = st.parse_trees(corpus)
    assert st.format_trees(parsed).where("doc_ord < 100").orderBy("doc_ord").select("trees").collect() == corpus.where("doc_ord < 100").orderBy("doc_ord").select("trees").collect()
    odd = {x.doc_name: x for x in parsed.where("doc_ord >= 100").collect()}
    assert odd["bad"].trees is None and odd["bad"].error.error_info == "brackets are left open" and odd["none"].error.error_info == "no tree"
    assert odd["null"].trees is None and odd["null"].error is None and odd["old"].error.module_name == "m"
    flat = parsed.where("doc_ord < 100").select("doc_ord", F.posexplode("trees").alias("n", "t")).select("doc_ord", "n", st.leaves(F.col("t")).alias("w"), st.spans_of(F.col("t"), "NP").alias("np")).collect()
    for x in flat:
        tree = docs[x.doc_ord][x.n]
        assert x.w == words_of(tree) and [tuple(s) for s in x.np] == spans(tree, "NP")[0]


def test_entities(spark):
    m = lambda text, a, b, c, d: {"sentNum": 0, "startIndex": a, "endIndex": b, "text": text, "headStartIndex": c, "headEndIndex": d}
    data = [
        {"id": 7, "mentions": [m("the Old Dog!", 4, 16, 8, 16), m("it", 20, 22, 20, 22)], "gender": "neuter", "genderProb": 0.5},
        {"id": 2, "mentions": [m("She", 0, 3, 0, 3)], "category": "person"},
        {"id": 3, "mentions": [m("a cat", 0, 5, 2, 5), m("zoo bat", 9, 16, 9, 16)]},
    ]
    rows = [("a", "1", 1, json.dumps(data), None), ("a", "2", 2, "[{", None), ("a", "3", 3, '[{"mentions": []}]', None), ("a", "4", 4, "[]", None), ("a", "5", 5, None, None), ("a", "6", 6, "[]", ("m", "i"))]
    corpus = spark.createDataFrame(rows, f"archive string, doc_name string, doc_ord bigint, text string, error {model.ERROR_TYPE}")
    got = {x.doc_ord: x for x in st.entities_of(corpus).withColumn("heads", F.transform("entities", lambda e: st.head_word(e))).collect()}
    assert [e.id for e in got[1].entities] == [2, 3, 7] and got[1].entities[2].genderProb == 0.5 and got[1].heads == [None, "bat", "dog"]
    assert got[2].error.module_name == "entities_of" == got[3].error.module_name
    assert got[4].entities == [] and got[4].error is None and got[5].error is None and got[6].entities is None and got[6].error.module_name == "m"
    again = st.entities_of(st.entities_of(corpus.where("doc_ord = 1")).withColumn("text", st.encode_entities(F.col("entities"))).drop("entities"))
    assert again.first().entities == got[1].entities


def test_scored_features(spark):
    raw = "0.5:1,2=3,7=0.25\n\n-1.20:3\r\n2:\nx:4=y"
    got = spark.createDataFrame([(raw,), ("",), (None,)], "raw string").select(st.decode_scored(F.col("raw")).alias("p")).withColumn("back", st.encode_scored(F.col("p"))).collect()
    points = [(p.score, [(f.feature, f.weight) for f in p.features]) for p in got[0].p]
    assert points == [(Decimal("0.5"), [(1, 1), (2, 3), (7, Decimal("0.25"))]), (Decimal("-1.2"), [(3, 1)]), (2, []), (None, [(4, None)])]
    assert got[0].back.split("\n")[:3] == ["0.5:1,2=3,7=0.25", "-1.2:3", "2:"] and got[1].p == [] and got[2].p is None


def test_own_document_type(spark, tmp_path):
    """A type registered here is read, mapped, stored and queried by path."""
    from corpuskiln.sources import readers, sinks

    kind = model.register_type("report", {"data": "variant"}, decode=lambda raw: {"data": F.try_parse_json(raw)}, encode=lambda c: F.to_json(c["data"]), parent="raw")
    assert model.DOC_TYPES["report"] is kind and model.is_subtype(kind, model.DOC_TYPES["raw"])
    raw = spark.createDataFrame([("a", "1", 1, '{"title": "x", "tags": ["p", "q"], "n": 3}', None), ("a", "2", 2, "{bad", None), ("a", "3", 3, '{"n": "text"}', None), ("a", "4", 4, None, ("m", "i"))], f"archive string, doc_name string, doc_ord bigint, raw string, error {model.ERROR_TYPE}")
    corpus = model.decode_documents(raw, "report")
    assert dict(corpus.dtypes)["data"] == "variant"
    sinks.store(corpus, f"{tmp_path}/reports")
    back = readers.load(spark, f"{tmp_path}/reports")
    got = {x.doc_ord: x for x in back.select("doc_ord", F.try_variant_get("data", "$.n", "int").alias("n"), F.try_variant_get("data", "$.tags[1]", "string").alias("tag"), "error").collect()}
    assert (got[1].n, got[1].tag, got[3].n) == (3, "q", None)
    assert got[2].error.module_name == "report" and got[4].error.module_name == "m" and got[3].error is None
    longer = back.withColumn("data", F.when(F.try_variant_get("data", "$.n", "int") > 0, F.parse_json(F.lit('{"n": 9}'))).otherwise(F.col("data")))
    texts = {x.doc_ord: x.raw for x in model.encode_documents(longer, "report").collect()}
    assert json.loads(texts[1]) == {"n": 9} and json.loads(texts[3]) == {"n": "text"} and texts[2] is None
    with pytest.raises(ValueError, match="registered"):
        model.register_type("report", {"x": "int"}, decode=lambda raw: {}, encode=lambda c: c["x"])
    with pytest.raises(ValueError, match="column"):
        model.register_type("other", {"error": "int"}, decode=lambda raw: {}, encode=lambda c: c["error"])
    with pytest.raises(ValueError, match="no parent"):
        model.register_type("other", {"x": "int"}, decode=lambda raw: {}, encode=lambda c: c["x"], parent="nothing")
    del model.DOC_TYPES["report"]
