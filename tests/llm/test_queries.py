"""Contract queries against brute force over the whole smallest table, and the pipeline's stages on odd tables."""

import collections
import hashlib
import math
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpuskiln.llm import queries


@pytest.fixture(scope="module")
def texts(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def test_op5_counts_and_base(spark, sf, texts):
    tokens = {i: [*split(lowered(t)), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = queries.op5_lm(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op8_whole_query(spark, sf, texts):
    form = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, sf).collect()}
    by_form, by_print = {}, {}
    for k, (i, text) in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(form(text) == form(edited)), float(form(text) == form(after)))
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert by_form.setdefault(form(t), p) == p and by_print.setdefault(p, form(t)) == form(t)


def test_op10_whole_query(spark, sf, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op10_tokens(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, sf, odd, none, name):
    """Nulls, long texts, ties, repeated rows and clashing names: columns stay as they are, and kept rows unchanged;
    an empty table stays empty."""
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, sf)
    assert got.columns == odd.columns
    rows, kept = collections.Counter(map(tuple, odd.collect())), collections.Counter(map(tuple, got.collect()))
    assert set(kept) <= set(rows)
    if name != "mixed":
        assert all(n <= rows[r] for r, n in kept.items())
    empty = stage(spark, none, sf)
    assert empty.columns == odd.columns and empty.count() == 0


def test_last_stage_on_odd_tables(spark, sf, odd, none):
    pytest.importorskip("public_tokenizers")
    stage = corpus_pipeline.STAGES[-1][1]
    got = stage(spark, odd, sf)
    assert got.count() == odd.count() and stage(spark, none, sf).count() == 0
