"""Text functions and codecs against plain Python, edge cases included."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import codecs, strings, text

EDGE = ["", "\n", "a", "a\n", "a\r\nb\r\n", "\n\na", " a  b ", " a ", "x\x85y z", "\U0001f600 é", "... !", "12 3", "a\x1cb\x1dc", "\r\n\n", "a\tb"]


def run(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def some_texts(seed, n=200):
    r = random.Random(seed)
    alphabet = ["a", "b", "Z", "é", " ", " ", "\n", "\r\n", ".", ",", "1", "_", "-", " ", "\U0001f600", "/"]
    return EDGE + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_split_lines_equals_python(spark):
    values = some_texts(1)
    assert run(spark, values, text.split_lines) == [v.splitlines() for v in values]


def test_strip_equals_python(spark):
    values = some_texts(2)
    assert run(spark, values, text.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("splitter", [" ", "a", ".", "\\E"])
def test_simple_tokenize(spark, splitter):
    values = some_texts(3)
    want = [[[w for w in line.strip().split(splitter) if w] for line in v.splitlines()] for v in values]
    assert run(spark, values, lambda c: text.simple_tokenize(c, splitter)) == want


def test_char_tokenize(spark):
    values = some_texts(4)
    assert run(spark, values, text.char_tokenize) == [[list(line) for line in v.splitlines()] for v in values]


def test_text_normalize(spark):
    values = some_texts(5)
    got = run(spark, values, lambda c: text.text_normalize(c, case="lower", strip_lines=True, drop_blank=True))
    assert got == ["\n".join(x for x in (y.strip() for y in v.lower().splitlines()) if x) for v in values]
    with pytest.raises(ValueError):
        text.text_normalize(F.lit("x"), case="title")


def test_token_normalize_documented_and_compatible(spark):
    s = spark.createDataFrame([([["Ab", "c.d", "é!", "12", "x1"], ["...", "!"], [], ["word"]],)], "s array<array<string>>")
    one = lambda **o: s.select(text.token_normalize(F.col("s"), **o)).first()[0]
    assert one(case="lower", remove_punct=True) == [["ab", "cd", "é", "12", "x1"], [], [], ["word"]]
    assert one(remove_nums=True, remove_empty=True) == [["Ab", "c.d", "é!", "x"], ["...", "!"], ["word"]]
    assert one(remove_only_punct=True) == [["Ab", "c.d", "é!", "12", "x1"], ["word"]]
    assert one(remove_only_punct=True, strict_compat=True) == [["Ab", "c.d", "é!", "12", "x1"], ["...", "!"]]
    assert one(min_word_length=2)[0] == ["Ab", "c.d", "é!", "12", "x1"]
    assert one(min_word_length=2, strict_compat=True)[0] == ["c.d"]


def test_europarl_lines(spark):
    v = "<CHAPTER 1>\nName. - (DE) Hello there.\n- dash\n(applause)\n\nplain (EN) text\n"
    assert run(spark, [v], text.europarl_lines) == [["Hello there.", "dash", "plain text"]]


def test_small_helpers(spark):
    assert run(spark, ["abcdef", "abc"], lambda c: text.truncate(c, 5)) == ["ab...", "abc"]
    assert run(spark, ["a, b_c! d"], text.strip_punctuation) == ["a b c d"]
    assert run(spark, ["NNS", "VB", "JJ", "RB", "DT"], text.coarse_pos) == ["n", "v", "j", "r", "o"]
    assert run(spark, ["Hello, world 3.5"], text.nist_tokenize) == [[["Hello", ",", "world", "3.5"]]]
    v = spark.createDataFrame([([0.5, 2.0],)], "v array<double>")
    assert v.select(text.format_document("vector", F.col("v"))).first()[0] == "0: 0.500\n1: 2.000"


def test_text_codecs_round_trip(spark):
    s = spark.createDataFrame([([["a/b", "c"], ["d"]], [[("x", None), ("y\tz", "N\nM")], [("w", "V")]])], "s array<array<string>>, a array<array<struct<word:string,pos:string>>>")
    got = s.select(codecs.decode_segmented(codecs.encode_segmented(F.col("s"))), codecs.decode_tokenized(codecs.encode_tokenized(F.col("s"))), codecs.decode_annotations(codecs.encode_annotations(F.col("a"), ["word", "pos"]), ["word", "pos"]), codecs.encode_segmented(F.col("s"))).first()
    assert got[0] == [["a/b", "c"], ["d"]] == got[1]
    assert [[tuple(w) for w in x] for x in got[2]] == [[("x", None), ("y\tz", "N\nM")], [("w", "V")]]
    assert got[3] == "a@slash@b/c\nd"


def test_binary_codecs_round_trip(spark):
    r = random.Random(8)
    for width, signed in codecs.INT_CODES:
        low = -(1 << (8 * width - 1)) if signed else 0
        top = (1 << (8 * width - signed)) - 1
        rows = [[r.randint(low, top) for _ in range(r.randint(0, 4))] for _ in range(5)]
        assert codecs.unpack_lists(codecs.pack_lists(rows, width, signed), width, signed) == rows
        table = [[r.randint(low, top) for _ in range(3)] for _ in range(4)]
        assert codecs.unpack_table(codecs.pack_table(table, 3, width, signed), 3, width, signed) == table
    with pytest.raises(ValueError):
        codecs.pack_table([[1, 2], [3]], 2)
    assert codecs.unpack_floats(codecs.pack_floats([1.5, -2.0])) == [1.5, -2.0]
    encode, decode = codecs.int_lists_codec()
    df = spark.createDataFrame([([[1, 2], []],), (None,)], "x array<array<bigint>>")
    assert [r.y for r in df.select(decode(encode("x")).alias("y")).collect()] == [[[1, 2], []], None]


def test_matching_blocks_equal_difflib(monkeypatch):
    """Both branches, short strings and those of which difflib leaves out frequent characters; ties, repeats, astral ones."""
    import difflib
    import random

    r = random.Random(5)
    make = lambda letters: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 7, 60, 199, 200, 350])))
    pairs = [(make(x), make(x)) for x in ["ab", "abc d", "abcdefghij " * 3 + "XYZ", "\U0001d518é語abcdefghijklmnopqrstuvwxyz 0123456789"] for _ in range(60)]
    pairs += [(a, b[:20] + a[5:60] + b[20:]) for a, b in pairs] + [(a, a) for a, _ in pairs[:20]] + [("x" * 300, "x" * 299), ("", "")]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    held = [strings.matching(a, b) for a, b in pairs]
    assert sum(n is not None for n in held) > 0.9 * len(pairs)
    assert [strings.ratio(a, b) for a, b in pairs] == want
    monkeypatch.setattr(strings, "MOST_LENGTH", 2)
    assert [strings.ratio(a, b) for a, b in pairs] == want
    monkeypatch.setattr(strings, "MOST_CELLS", 0)
    assert [strings.ratio(a, b) for a, b in pairs] == want
