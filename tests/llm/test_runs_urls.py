"""Periodic runs and URL filters against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import periodic, queries, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, 2 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(r):
    n, k = r.randint(0, 350), r.choice([1, 2, 3, 10, 200])
    words = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.randint(0, 3) if n else 0):
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - a) // 2))
        for i in range(a, r.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 40])
def test_find_in(least):
    r = random.Random(least)
    for _ in range(150):
        words = [w.encode() for w in some_words(r)]
        assert periodic.find_in(words, least) == brute_runs(words, least)


def test_long_periods_and_fibonacci():
    r = random.Random(3)
    block = [b"%d" % r.randrange(10**6) for _ in range(700)]
    assert periodic.find_in([b"x", *block, *block, *block[:100], b"y"]) == [(1, 1500, 700)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.find_in(b) == brute_runs(b)


def test_work_grows_with_the_words():
    """One word throughout has one run; the number of lags compared doesn't grow with the text."""
    compared = []
    for n in (4_000, 64_000):
        seen = periodic.equal_stretches
        calls = []
        periodic.equal_stretches = lambda *a: calls.append(a[2]) or seen(*a)
        try:
            assert periodic.find_in([b"x"] * n) == [(0, n, 1)]
        finally:
            periodic.equal_stretches = seen
        compared.append(len(calls))
    assert compared[0] == compared[1] <= 64


def test_find_runs_odd_rows(spark, odd, none):
    got = periodic.find_runs(odd).collect()
    assert len(got) == odd.count() and periodic.find_runs(none).collect() == []
    by_text = {(r.doc_id, r.text) for r in odd.collect()}
    want = sorted(((i, brute_kept(WORD.findall(t or ""), brute_runs(WORD.findall(t or ""))) if len(t or "") < 10_000 else None) for i, t in by_text if i is not None and i != 10), key=str)
    have = {r.doc_id: r for r in got}
    for i, kept in want:
        if kept is not None:
            assert have[i].kept == kept
    assert have[16].runs == [(0, 140, 70)] or have[16].runs[0]["length"] == 140
    assert all(r.kept is not None and r.runs is not None for r in got)
    assert spark.createDataFrame([(1, "a b " * 7)], "runs int, kept string").transform(lambda d: periodic.find_runs(d, id_col="runs", text_col="kept")).first()["runs"][0]["period"] == 2


def brute_op13(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(brute_kept(w, runs)))


def test_op13_whole_query(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(some_words(r))) for i in range(120)] + [(200, None), (201, ""), (202, " \t\n"), (203, "é " * 30 + "\x0bx"), (-5, "a\x85b " * 14), (17, "one")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_op13(i, t) for i, t in rows)


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/x?y=/z", "http://example.net/de/1", "http://b.net", "http://b.net/", "http://b.net?x", "x://example.com/de/", "x://notexample.com/de/1", "http://www.example.com/de",
    "http://q.org/fr/#a", "http://org/fr/", "no scheme", "", None, "://", "a://b://c.net/d", "http://u:p@h.net:80/x", "http://ÄB.net/ß/", "http://x.example.org/fr/a#b?c", "http://a..net/", "//x", "http://h\n.net/p\nq?r", "http://h.com/" + "p" * 20_000,
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_url(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), u
        assert got[i].verdict == (rule.verdict if rule else "block" if got[i].p_block >= 0.5 else "allow")
    assert urls.judge(df, rules=()).where("rule is not null").count() == 0


def brute_grams(text, mark):
    t = f"{mark}<{text}>"
    return [mark + t[i : i + n] for n in urls.GRAMS for i in range(len(t) - n + 1)]


def test_buckets_and_probability(spark):
    """Buckets of the n-grams and the weighted sum, one url at a time."""
    some = [u for u in URLS if u is None or len(u) < 200] + [u for u, _ in urls.labelled_urls(60)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(some)], "page_id bigint, url string")
    model = urls.fitted(spark)
    host, path = urls.url_parts(F.col("url"))
    found = {r.page_id: r.b for r in df.select("page_id", urls.buckets(host, path).alias("b")).collect()}
    p = {r.page_id: r.p_block for r in urls.judge(df).collect()}
    for i, u in enumerate(some):
        h, q = brute_url(u)
        grams = list(dict.fromkeys(brute_grams(h, "h") + brute_grams(q, "p")))
        hashes = spark.createDataFrame([(g,) for g in grams], "g string").select((F.xxhash64("g").bitwiseAND((1 << urls.BUCKET_BITS) - 1) + 1).alias("b")).collect() if i % 9 == 0 else None
        assert hashes is None or set(found[i]) == {r.b for r in hashes}
        z = model.bias + model.weights[np.array(found[i]) - 1].sum() / max(1, len(found[i])) ** 0.5
        assert p[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_fit_is_a_minimum():
    r = random.Random(5)
    rows = [[r.randrange(1, 40) for _ in range(6)] + ([50] if i % 3 == 0 else []) for i in range(90)]
    y = [int(i % 3 == 0) for i in range(90)]
    model = urls.fit(rows, y, steps=6000)
    x = np.zeros((90, 1 << urls.BUCKET_BITS))
    for i, b in enumerate(rows):
        np.add.at(x[i], np.array(b) - 1, 1 / len(b) ** 0.5)
    share = np.where(np.array(y) == 1, 0.5 / 30, 0.5 / 60)
    error = share * (1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y)
    assert np.abs(x.T @ error + 0.1 / 90 * model.weights).max() < 1e-4 and abs(error.sum()) < 1e-4
    with pytest.raises(ValueError):
        urls.fit(rows, [0] * 90)


def test_held_out_accuracy(spark):
    """Urls made with another seed, from the same words but other syllables."""
    held = spark.createDataFrame(urls.labelled_urls(2000, seed=99), "url string, blocked int").withColumn("page_id", F.monotonically_increasing_id())
    got = urls.judge(held, rules=()).join(held.select("page_id", "blocked"), "page_id").groupBy("blocked").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("p")).collect()
    share = {r.blocked: r.p for r in got}
    assert share[1] > 0.95 and share[0] < 0.05, share


def test_op12_whole_query(spark, sf):
    got = queries.op12_urls(spark, sf)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow", "Exchange"))
    model, pages = urls.fitted(spark), {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages) == 50
    for r in rows:
        host, path = brute_url(pages[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert rule is None or r.verdict == rule.verdict
    assert model is urls.fitted(spark)


def test_filter_urls_keeps_rows(spark, none):
    df = spark.createDataFrame([(1, "http://a.org/fr/x", "k"), (1, "http://a.org/fr/x", "k"), (2, "http://a.net/", "gone"), (None, "http://garden-school.com/en/3", "k"), (4, "https://casino-bets.com/slots/1", "gone")], "p_block int, url string, host string")
    assert sorted(r.host for r in urls.filter_urls(df).collect()) == ["k", "k", "k"]
    assert urls.filter_urls(df).columns == df.columns
    assert urls.filter_urls(none.withColumn("url", F.col("text"))).count() == 0
