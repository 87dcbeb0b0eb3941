"""Readers, sinks, the pipeline language, streaming, and the query registry."""

import gzip
import random
import re
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators.corpus import interleave, subset
from corpuskiln.plans import config, modules
from corpuskiln.plans.pipeline import Pipeline, main
from corpuskiln.sources import readers, sinks
from corpuskiln.streaming import incremental


def texts(df):
    return [(r.doc_name, r.text) for r in df.orderBy("doc_ord").collect()]


def test_text_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.txt").write_text("l1\nl2\nl3\nl4")
    (tmp_path / "x" / "a.txt").write_text("é", encoding="latin1")
    got = readers.text_files(spark, [f"{tmp_path}/a.txt:2-3", f"?{tmp_path}/missing.txt"])
    assert texts(got) == [("a.txt", "l2\nl3")]
    both = readers.text_files(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/x"], encoding="latin1")
    assert texts(both) == [("a.txt-0", "l1\nl2\nl3\nl4"), ("a.txt-1", "é")]
    assert texts(readers.text_files(spark, [str(tmp_path)], exclude=[f"{tmp_path}/x"])) == [("a.txt", "l1\nl2\nl3\nl4")]
    with pytest.raises(FileNotFoundError):
        readers.text_files(spark, [f"?{tmp_path}/none"])


def test_empty_files_are_documents(spark, tmp_path):
    """In a path with spaces, signs and a letter beyond ASCII, too."""
    d = tmp_path / "a+b %20 é"
    d.mkdir()
    for name, text in (("a", ""), ("b 1", "x\ny"), ("c%2B", ""), ("d+e", "")):
        (d / name).write_text(text)
    assert texts(readers.text_files(spark, [str(tmp_path)])) == [("a", ""), ("b 1", "x\ny"), ("c%2B", ""), ("d+e", "")]
    assert texts(readers.text_files(spark, [f"{tmp_path}/*:2-3"], exclude=[f"{tmp_path}/a+b %20 é/a"])) == [("b 1", "y"), ("c%2B", ""), ("d+e", "")]


@pytest.mark.parametrize("name", ["text_files_lines", "doc_embeddings"])
def test_empty_texts_as_in_sql(spark, sf, tmp_path, name):
    """Documents without a text, an empty one, and texts of white space only."""
    import duckdb

    from corpuskiln.plans import registry

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    odd = [(-1 - i, "src0", x) for i, x in enumerate([None, "", " ", "\n", "a\r\nb\r\nc\r\n", " \n\t\n"])]
    docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, source string, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    assert sorted(got) == sorted(want)


def test_xml_elements(spark, tmp_path):
    """Nested elements, references, CDATA, comments, lost and stray end tags, by hand."""
    read = readers.xml_elements
    assert read("<a><doc n='1'>x<doc>y &#233;&#x1F642;</doc>z</doc></a>", "doc") == [(" n='1'", "xy é🙂z"), ("", "y é🙂")]
    assert read("<DOC>a<![CDATA[<b>&amp;]]><!-- <doc>no</doc> --></DOC></doc>", "doc") == [("", "a<b>&amp;")]
    assert read("<doc>a<doc>b", "doc") == [("", "ab"), ("", "b")] and read("<doc/>x<docs>y</docs>", "doc") == [("/", "")]
    assert read("<?xml version='1.0'?><doc t=\"a>b\">x</doc>", "doc") == [(' t="a>b"', "x")] and read("", "doc") == []
    (tmp_path / "n.xml").write_text('<r><doc filename="o&amp;p" lang="en">1<doc>2</doc></doc><doc filename="q" lang="de">3</doc></r>')
    got = readers.xml_files(spark, [f"{tmp_path}/n.xml"]).orderBy("doc_ord").select("doc_name", "text").collect()
    assert [tuple(r) for r in got] == [("o&p", "12"), ("n.xml-1", "2"), ("q", "3")]
    assert [r.text for r in readers.xml_files(spark, [f"{tmp_path}/n.xml"], attrs={"lang": "de"}).collect()] == ["3"]


def test_xml_query_against_loops(spark, sf):
    """Every paragraph of every page, by walking over the page's tags one by one."""
    from corpuskiln.plans import registry

    import html
    import re

    want = []
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        open_, found = [], []
        for part in re.split(r"(<!--.*?-->|<[^>]*>)", page.html, flags=re.S):
            if not part.startswith("<"):
                for k in open_:
                    found[k].append(html.unescape(part))
            elif re.match(r"<p[\s>]", part, re.I):
                open_.append(len(found))
                found.append([])
            elif re.match(r"</p[\s>]", part, re.I) and open_:
                open_.pop()
        want += [(f"{page.page_id}-{i}" if i else str(page.page_id), "".join(x)) for i, x in enumerate(found)]
    assert sorted(map(tuple, registry.QUERIES["xml_files_written"](spark, sf).collect())) == sorted(want)


def test_encoding_errors(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"a\xffb")
    read = lambda e: readers.text_files(spark, [f"{tmp_path}/t.txt"], encoding_errors=e).first().text
    assert (read("ignore"), read("replace")) == ("ab", "a\ufffdb")
    with pytest.raises(ValueError):
        read("other")


def test_numbered_lines(spark, tmp_path):
    """Lines of a file that is read in many splits, without a window over them."""
    (tmp_path / "v.txt").write_text("".join(f"w{i} {i}.5 1\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = readers._numbered_lines(spark, f"{tmp_path}/v.txt")
        got = lines.collect()
        assert lines.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["at"]: r.value.split()[0] for r in got} == {i: f"w{i}" for i in range(5000)}


def test_archives_xml_vertical(spark, tmp_path):
    for n in ("p", "q"):
        with tarfile.open(tmp_path / f"{n}.tar.gz", "w:gz") as t:
            (tmp_path / "m.txt").write_text(n * 3)
            t.add(tmp_path / "m.txt", "dir/m.txt")
    assert texts(readers.text_archives(spark, [f"{tmp_path}/p.tar.gz"])) == [("dir/m", "ppp")]
    assert texts(readers.text_archives(spark, [f"{tmp_path}/p.tar.gz", f"{tmp_path}/q.tar.gz"])) == [("p/dir/m", "ppp"), ("q/dir/m", "qqq")]
    xml = '<r><doc filename="one" lang="en">a &amp; <b>b</b></doc><doc>two</doc><doc lang="en">x</doc></r>'
    (tmp_path / "f.xml.gz").write_bytes(gzip.compress(xml.encode()))
    assert texts(readers.xml_files(spark, [f"{tmp_path}/f.xml.gz"])) == [("one", "a & b"), ("f.xml.gz-1", "two"), ("f.xml.gz-2", "x")]
    assert len(texts(readers.xml_files(spark, [f"{tmp_path}/f.xml.gz"], attrs={"lang": "en"}))) == 2
    (tmp_path / "v.vrt").write_text("<text id=1>\n<sentence>\na\tX\nb\tY\n</sentence>\n<sentence>\nc\tZ\n</sentence>\n</text>\n<text>\nlost\tL\n")
    (v,) = readers.vertical_text(spark, [f"{tmp_path}/v.vrt"], ["word", "pos"]).collect()
    assert [[tuple(w) for w in s] for s in v.sentences] == [[("a", "X"), ("b", "Y")], [("c", "Z")]]


def test_embedding_files(spark, tmp_path):
    e = spark.createDataFrame([(0, "a b", 7, [1.0, 2.0]), (1, "c d", 3, [0.5, -1.0])], "idx bigint, word string, count bigint, vector array<float>")
    sinks.store_word2vec(e, str(tmp_path / "m.bin"))
    back = readers.word2vec(spark, str(tmp_path / "m.bin")).orderBy("idx").collect()
    assert [(r.word, r["count"], r.vector) for r in back] == [("a b", 7, [1.0, 2.0]), ("c d", 3, [0.5, -1.0])]
    assert (tmp_path / "m.bin").read_bytes().startswith(b"2 2\na<space>b " + struct.pack("<2f", 1, 2))
    (tmp_path / "t.vec").write_text("2 2\nx 1 2\ny 3 4\n")
    assert [(r.idx, r.word, r["count"], r.vector) for r in readers.fasttext_vec(spark, str(tmp_path / "t.vec")).orderBy("idx").collect()] == [(0, "x", 1, [1.0, 2.0]), (1, "y", 0, [3.0, 4.0])]
    assert readers.fasttext_vec(spark, str(tmp_path / "t.vec"), 1).count() == 1
    (tmp_path / "g.txt").write_text("x 1 2\ny 3 4\n")
    assert readers.glove_text(spark, str(tmp_path / "g.txt")).count() == 2
    sinks.store_tsv(e, str(tmp_path / "tsv"))
    assert spark.read.text(f"{tmp_path}/tsv/embeddings.tsv").first()[0] == "1.0\t2.0"
    with pytest.raises(ValueError):
        readers.fasttext_vec(spark, "x.zip")


def test_document_archives_and_custom_reader(spark, tmp_path):
    import json

    def block(b):
        n, out = len(b), b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out + b

    docs = [("d1", "short"), ("d2", "é" * 300), ("d3", "")]
    (tmp_path / "a-0.prc").write_bytes(b"".join(block(json.dumps({"name": n}).encode()) + block(t.encode()) for n, t in docs))
    got = readers.document_archives(spark, [f"{tmp_path}/a-0.prc"])
    assert texts(got) == docs and got.first().archive == "a-0"
    made = readers.custom(spark, ["x", "y"], lambda k: iter([(f"{k}1", {"text": k}), (f"{k}2", {})]), "text string")
    assert texts(made) == [("x1", "x"), ("x2", None), ("y1", "y"), ("y2", None)]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("a", "d.txt", 0, "x", None), ("a", "e", 1, None, ("m", "i"))], "archive string, doc_name string, doc_ord bigint, text string, error struct<module_name:string,error_info:string>")
    assert sinks.store(c, f"{tmp_path}/s").count() == 2
    with pytest.raises(Exception, match="repeated document"):
        sinks.store(c.union(c), f"{tmp_path}/s2")
    sinks.text_corpus(c, f"{tmp_path}/t", archive_dirs=True, suffix=".out", invalid="empty")
    assert (tmp_path / "t/a/d.out").read_text() == "x" and (tmp_path / "t/a/e.out").read_text() == ""
    sinks.text_corpus(c, f"{tmp_path}/u", tar=True)
    with tarfile.open(tmp_path / "u/a.tar") as t:
        assert t.getnames() == ["d.txt"]
    (tmp_path / "f1").write_text("1")
    assert len(sinks.collect_files(spark, [[f"{tmp_path}/f1"], [f"{tmp_path}/f1"]], f"{tmp_path}/col")) == 2
    assert (tmp_path / "col/1_f1").read_text() == "1"


PIPELINE = """
[pipeline]
name=demo
[vars]
where=%(project_root)s
[docs]
type=input.text.raw_text_files
files=%(where)s/in/*.txt
modvar_lang={lang}
[tok]
type=text.simple_tokenize
filter=T
[norm]
type=text.normalize
case={low}lower|{up}upper
%%variant:short min_word_length=3
%%novariant min_word_length=2
[vocab]
type=corpora.vocab_builder
[again]
%%copy norm case
case=lower
input=tok
[both]
type=corpora.concat
input_corpora=*norm,again*2
[same]
type=alias
input=vocab[low].stopwords
"""


def test_pipeline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The cat\nsat of a")
    (tmp_path / "in/b.txt").write_text("the dog")
    conf = tmp_path / "p.conf"
    conf.write_text(PIPELINE)
    p = Pipeline.load(conf)
    assert list(p.modules) == ["docs", "tok", "norm[low]", "norm[up]", "vocab[low]", "vocab[up]", "again", "both"]
    assert p.modules["again"].options == {"min_word_length": "2", "case": "lower"} and len(p.modules["both"].inputs["corpora"]) == 4
    assert sorted(p.variants) == ["main", "short"]
    words = [r.token for r in p.output(spark, "vocab[low].vocab").orderBy("id").collect()]
    assert words == ["the", "cat", "sat", "of", "dog"]
    assert p.status("vocab[up]") == "WAITING" and p.status("tok") == "FILTER"
    ran = p.run(spark, ["vocab[up]"])
    assert ran == ["docs", "norm[up]", "vocab[up]"] and p.status("vocab[up]") == "COMPLETE"
    assert Pipeline.load(conf).output(spark, "vocab[up]").count() == 5 and p.run(spark, ["vocab[up]"]) == []
    assert p.output(spark, "same").columns == ["value"]
    assert p.output(spark, "both").count() == 8
    p.dump("vocab[up]", str(tmp_path / "v.tgz"))
    p.reset("vocab[up]")
    p.load_dump("vocab[up]", str(tmp_path / "v.tgz"))
    assert p.status("vocab[up]") == "COMPLETE" and p.output(spark, "vocab[up]").count() == 5
    assert "norm[up]" in p.reset("norm[up]") and p.status("vocab[up]") == "WAITING"
    short = Pipeline.load(conf, "short")
    assert short.modules["norm[up]"].options["min_word_length"] == "3"
    assert main([str(conf), "status"]) == 0 and main([str(conf), "variants"]) == 0
    assert main([str(conf), "show", "vocab[low]"]) == 0


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (("type=text.normalize", "type=text.nothing"), "unknown type"),
        (("case={low}lower|{up}upper", "cases=lower"), "no option cases"),
        (("case={low}lower|{up}upper", "case=odd"), "case=odd"),
        (("again*2", "nobody"), "no module nobody"),
        (("[vocab]", "[norm]"), "occurs twice"),
        (("name=demo", "nam=demo"), "needs a .pipeline."),
        (("%%novariant", "%%odd"), "unknown directive"),
        (("*norm,again*2", "tok.odd"), "no output odd"),
    ],
)
def test_pipeline_errors(tmp_path, change, message):
    conf = tmp_path / "p.conf"
    conf.write_text(PIPELINE.replace(*change))
    with pytest.raises(config.PipelineError, match=message):
        Pipeline.load(conf)


def expand(text, tmp_path):
    conf = tmp_path / "e.conf"
    conf.write_text("[pipeline]\nname=x\n[src]\ntype=input.stored\ndir=/d\n" + text)
    sections, _ = config.read(conf)
    return config.expand(sections, {"input.stored"})[0]


def test_alternatives_and_modvars(tmp_path):
    names = lambda t: [m.name for m in expand(t, tmp_path)[1:]]
    assert names("[m]\ntype=t\na=1|2\nb=x|y") == ["m[a=1~b=x]", "m[a=1~b=y]", "m[a=2~b=x]", "m[a=2~b=y]"]
    assert names("[m]\ntype=t\ntie_alts=T\na=1|2\nb=x|y\nalt_naming=pos") == ["m[1~x]", "m[2~y]"]
    assert names("[m]\ntype=t\ntie_alts=a|b\na=1|2\nb=x|y\nc=p|q\nalt_naming=option(a,c)") == ["m[1~p]", "m[1~q]", "m[2~p]", "m[2~q]"]
    assert names("[m]\ntype=t\na=1|2\n[n]\ntype=t\n[o]\ntype=t\ninput=n") == ["m[1]", "m[2]", "n[1]", "n[2]", "o[1]", "o[2]"]
    mods = {m.name: m for m in expand('[m]\ntype=t\na={en}1|{de}2\nmodvar_lang=altname()\nmodvar_n=3\n[n]\ntype=t\nfile=$(map(lang, "en" -> "english" | * -> "other"))-$(n).txt\n[o]\ntype=t\ninput=*m\nfiles=$(join("+", lang))\nk=$(len(lang))\nfirst=$(lang[0])', tmp_path)}
    assert [mods[f"n[{k}]"].options["file"] for k in ("en", "de")] == ["english-3.txt", "other-3.txt"]
    assert mods["o"].options == {"files": "en+de", "k": "2", "first": "en"}
    with pytest.raises(config.PipelineError, match="different numbers"):
        expand("[m]\ntype=t\ntie_alts=T\na=1|2\nb=1|2|3", tmp_path)


def test_include_and_multistage(spark, tmp_path):
    (tmp_path / "part.conf").write_text("%%abstract\n[docs]\ntype=input.stored\ndir=/nowhere\n")
    (tmp_path / "main.conf").write_text("[pipeline]\nname=i\n%%include part.conf\n[s]\ntype=corpora.subset\nsize=2k\n")
    p = Pipeline.load(tmp_path / "main.conf")
    assert list(p.modules) == ["docs", "s"] and modules.to_int("2k") == 2000
    with pytest.raises(config.PipelineError, match="abstract"):
        Pipeline.load(tmp_path / "part.conf")
    modules.multistage("test.clean", [("tok", "text.simple_tokenize", {}), ("norm", "text.normalize", {"case": "lower"})])
    df = spark.createDataFrame([("a", "d", 0, "Ab C", None)], "archive string, doc_name string, doc_ord bigint, text string, error struct<module_name:string,error_info:string>")
    out = modules.TYPES["test.clean"].run(spark, {"corpus": [df]}, {"norm_min_word_length": 2})
    assert out["corpus"].first().sentences == [["ab"]]


def test_streaming(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src, to, mark = (str(tmp_path / x) for x in ("in", "out", "ck"))
    upper = lambda df: df.select("doc_id", F.upper("text").alias("text"))
    docs.where("doc_id < 50").write.parquet(src)
    incremental.map_new_documents(spark, src, docs.schema, upper, to, mark)
    docs.where("doc_id >= 50").write.mode("append").parquet(src)
    incremental.map_new_documents(spark, src, docs.schema, upper, to, mark)
    assert incremental.map_new_documents(spark, src, docs.schema, upper, to, mark) == 0
    assert spark.read.parquet(to).count() == docs.count()
    assert incremental.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).count() > 0


def test_registry(spark, sf):
    import duckdb

    import __spark_entry__
    from corpuskiln.plans import registry

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in registry.ORACLE_SQL:
        got = registry.QUERIES[name](spark, sf).toPandas()
        want = con.sql(registry.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        whole = [c for c in columns if c in want and str(want[c].dtype) == "Int64"]  # whole numbers with nulls; toPandas makes them floats
        got = got.astype(dict.fromkeys(whole, "Int64"))
        as_rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))  # noqa: B023, E731
        assert columns == sorted(want.columns) and as_rows(got) == as_rows(want), name


def equal_sql(spark, sf, *names):
    import duckdb

    from corpuskiln.plans import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in names:
        got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        as_rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))  # noqa: B023, E731
        assert columns == sorted(want.columns) and as_rows(got) == as_rows(want), name


@pytest.mark.parametrize("sizes", [(52, 39), (39, 52), (300, 275), (0, 3), (5, 0), (1, 17)])
def test_interleave_rounds_as_its_sql(spark, tmp_path, sizes):
    """For the first three sizes sums of steps added one by one order ties otherwise than the SQL."""
    import duckdb

    from corpuskiln.plans import registry

    con = duckdb.connect()
    for table, key, n in zip(("documents", "benchmark"), ("doc_id", "item_id"), sizes, strict=True):
        at = f"{tmp_path}/{table}.parquet"
        con.sql(f"copy (select i * 3 as {key}, 's' || i % 2 as source, 't' as text from range({n}) t(i) order by hash(i)) to '{at}'")
        con.sql(f"create view {table} as select * from '{at}'")
    frame = registry.QUERIES["interleave_corpora"](spark, str(tmp_path))
    got = sorted((r.pos, r.archive, r.doc_name) for r in frame.collect())
    assert got == sorted(con.execute(registry.ORACLE_SQL["interleave_corpora"]).fetchall()) and len(got) == sum(sizes)
    with pytest.raises(ValueError, match="exclude"):
        interleave([registry.documents(spark, str(tmp_path))], scaled=True, in_blocks=True)


def test_whole_vocabulary(spark, sf, tmp_path):
    from collections import Counter

    from corpuskiln.plans import registry

    equal_sql(spark, sf, "vocab_map", "vocab_map_skip", "vocab_unmap", "vocab_count", "doc_bow", "doc2bow_missing")
    words = [f"w{i}" for i in range(260)]
    texts = [" ".join(words[i:] + words[:i]) for i in range(12)]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 16, len(w))):
                want[w[i], w[j]] += 1 / (j - i)
                want[w[j], w[i]] += 1 / (j - i)
    ids = {w: i for i, w in enumerate(words)}
    got = {(r.w1, r.w2): r.weight for r in registry.QUERIES["cooccurrence"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(ids[a], ids[b]) for a, b in want} and all(abs(got[ids[a], ids[b]] - x) < 1e-4 for (a, b), x in want.items())
    assert registry.QUERIES["glove_vectors"](spark, str(tmp_path)).count() == 260


def test_whole_texts(spark, sf, tmp_path):
    import difflib

    from corpuskiln.plans import registry

    equal_sql(spark, sf, "format_documents")
    r = random.Random(4)
    line = lambda: "".join(r.choice("abc d") for _ in range(r.randint(0, 200)))
    texts = ["\n".join(line() for _ in range(k)) for k in (1, 2, 5, 9)]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in enumerate(texts):
        x = t.splitlines()
        want |= {(i, k): round(difflib.SequenceMatcher(None, x[k], x[k + 1]).ratio(), 6) for k in range(len(x) - 1)}
    assert {(x.doc_id, x.line): x.ratio for x in registry.QUERIES["line_similarity"](spark, str(tmp_path)).collect()} == want


def test_whole_sets(spark, sf):
    from corpuskiln.plans import registry

    equal_sql(spark, sf, "name_filter", "embeddings_concat")
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert registry.QUERIES["embeddings_concat"](spark, sf).where("word not like 'second%'").count() == n > 100


def test_plans_push_down(spark, sf):
    """A name filter reaches the scan, and a projection reads only its columns."""
    from corpuskiln.plans import registry

    plan = registry.QUERIES["name_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(source, [src1,src2])" in re.sub(r"IsNotNull\(\w+\), ", "", plan)
    kept = subset(registry.documents(spark, sf), 5).select("doc_name")._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in kept


def test_entry_imports_without_session():
    """The driver lists the queries before it starts Spark."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
