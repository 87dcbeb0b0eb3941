"""What operators' tasks get at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpuskiln import workers
from corpuskiln.operators import models, vocab
from corpuskiln.sources import readers


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 6000, 1, 1).select(F.array(F.array_repeat(F.col("id").cast("string"), 300)).alias("s"))
    got = workers.map_arrow(rows, sizes, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 1.2 * workers.PIECE_BYTES and len(got) > 2
    short = pa.RecordBatch.from_pydict({"x": pa.array([["a"], None, ["b" * 50], []])})
    assert [p.column(0).to_pylist() for p in workers.pieces(iter([short, short.slice(0, 0)]), 40)] == [[["a"], None], [["b" * 50], []], []]


def test_lookups_over_several_pieces(spark):
    corpus = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_ord"), F.array(F.array_repeat((F.col("id") % 7).cast("string"), 300), F.array(F.lit("x"))).alias("sentences"), F.lit(None).cast("string").alias("error"))
    words = vocab.build(corpus, max_prop=0.5).words
    assert {(r.id, r.token) for r in words.collect()} == {(i, str(i)) for i in range(7)} and "x" not in {r.token for r in words.collect()}
    for r in vocab.map_tokens(corpus, words, "skip").select("doc_ord", F.array_distinct(F.flatten("lists")).alias("d"), F.size("lists").alias("n")).collect():
        assert (r.d, r.n) == ([r.doc_ord % 7], 1)


def test_word2vec_learns_in_parts(spark, monkeypatch):
    given = {}
    own = models.Word2Vec
    monkeypatch.setattr(models, "Word2Vec", lambda **o: given.update(o) or own(**o))
    corpus = spark.createDataFrame([([["a", "b", "c"]] * 20, None)], "sentences array<array<string>>, error string")
    assert models.train_word2vec(corpus, size=2, min_count=1, iterations=1).count() == 3
    assert given["numPartitions"] == spark.sparkContext.defaultParallelism > 1


def test_word2vec_gives_what_it_learned(spark, tmp_path, monkeypatch):
    """The query's vectors are those of the model, so another model gives other rows."""
    from corpuskiln.plans import registry

    text = "\n".join(["a b c d"] * 30)
    spark.createDataFrame([(i, "s", text) for i in range(4)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vector for r in registry.QUERIES["word2vec"](spark, str(tmp_path)).collect()}
    assert set(got) == set("abcd") and all(len(v) == 8 and any(v) for v in got.values())
    own = models.train_word2vec
    monkeypatch.setattr(models, "train_word2vec", lambda *a, **o: own(*a, **o | {"seed": 2}))
    other = {r.word: r.vector for r in registry.QUERIES["word2vec"](spark, str(tmp_path)).collect()}
    assert set(other) == set(got) and all(other[w] != got[w] for w in got)


def test_archives_are_read_member_by_member(spark, tmp_path):
    import tarfile

    with tarfile.open(tmp_path / "a b%20.tar", "w") as t:
        for i in range(5):
            (tmp_path / "m").write_text(f"{i}" * 600_000)
            t.add(tmp_path / "m", f"d{i}.txt")
    found = readers.text_archives(spark, [f"{tmp_path}/a b%20.tar"])
    assert [(r.doc_ord, r.doc_name, r.text[:1], len(r.text)) for r in found.orderBy("doc_ord").collect()] == [(i, f"d{i}", f"{i}", 600_000) for i in range(5)]
    assert "content:binary" not in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
