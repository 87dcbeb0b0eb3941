"""URL filters: rules of host and path first, else a logistic regression on hashed character n-grams.

DataFrame functions only: parts, rules, n-grams, hashes and the weighted sum are expressions of one scan without shuffle.
The regression is fitted to a small labelled table of URLs; its weights become one array literal of fixed size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: n-grams are hashed into 2 ** 16 buckets, so the weights are 512 KB whatever is scored.
BUCKET_BITS = 16
#: Most labelled rows that a model is fitted to. They are the "small labelled table", so more is an error, not a sample.
MAX_LABELLED = 100_000


@dataclass(frozen=True)
class Rule:
    """What to do with a host, its subdomains and all paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without "://"."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    head = F.regexp_extract(after, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.substring_index(head, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substr(head, F.length(F.substring_index(head, "/", 1)) + 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule that fits, as (name, verdict), else null.

    A host's own name and those of its parent domains, no deeper than any rule's host, are looked up in a map.
    Of rules that are equally long the one whose name is greatest in code-point order wins.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    one = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict"))
    known = F.create_map(*itertools.chain.from_iterable((F.lit(h), F.array(*[one(r) for r in rs])) for h, rs in by_host.items()))
    deepest = max(h.count(".") for h in by_host) + 1
    suffixes = F.array(*[F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= d - 1, F.substring_index(host, ".", -d)) for d in range(1, deepest + 1)])
    found = F.flatten(F.transform(F.filter(suffixes, lambda s: s.isNotNull()), lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast("array<struct<size:int,name:string,path:string,verdict:string>>"))))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["verdict"].alias("verdict")))


def _grams(text: Column, mark: str) -> Column:
    """The n-grams of a text between marks, as an array of strings; the mark keeps hosts and paths apart.

    They are put together from the characters side by side, never by positions in the text, so long texts cost no more
    for each character than short ones.
    """
    c = F.split(F.concat(F.lit(mark + "<"), text, F.lit(">")), "")
    size = F.size(c)
    made: list[Column] = []
    for n in GRAMS:
        shifted = [F.slice(c, F.lit(i + 1), F.greatest(size - (n - 1), F.lit(0))) for i in range(n)]
        made.append(F.transform(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted), lambda g: F.concat(F.lit(mark), g)))
    return F.concat(*made)


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams, in order of first place: 1 to 2 ** BUCKET_BITS."""
    both = F.concat(_grams(host, "h"), _grams(path, "p"))
    return F.array_distinct(F.transform(both, lambda g: (F.xxhash64(g).bitwiseAND((1 << BUCKET_BITS) - 1) + 1).cast("int")))


@dataclass
class Model:
    """Log-odds of block: bias plus the weights of a url's buckets, divided by the root of their number."""

    weights: np.ndarray
    bias: float

    def probability(self, found: Column) -> Column:
        # one foldable expression, so that the plan holds the array once
        weights = F.split(F.lit(" ".join(repr(float(w)) for w in self.weights)), " ").cast("array<double>")
        total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.element_at(weights, b))
        return 1.0 / (1.0 + F.exp(-(F.lit(float(self.bias)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1))))))


def fit(rows: list[list[int]], labels: list[int], *, l2: float = 0.1, steps: int = 500, rate: float = 8.0) -> Model:
    """Logistic regression by full gradient steps with Nesterov's momentum; classes weigh the same. Deterministic."""
    size = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate([np.asarray(r, np.int64) - 1 for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    value = 1.0 / np.sqrt(np.maximum(size, 1))[row]
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        raise ValueError("labelled urls of both verdicts are needed")
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(1 << BUCKET_BITS), 0.0
    last_w, last_b = w, b
    for t in range(steps):
        pull = t / (t + 3.0)
        w_, b_ = w + pull * (w - last_w), b + pull * (b - last_b)
        p = 1 / (1 + np.exp(-(np.bincount(row, w_[at] * value, len(y)) + b_)))
        error = share * (p - y)
        last_w, last_b = w, b
        w = w_ - rate * (np.bincount(at, error[row] * value, len(w_)) + l2 / len(y) * w_)
        b = b_ - rate * error.sum()
    return Model(w, float(b))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked", **options) -> Model:
    """Fits to a small table of urls with label 1 (block) or 0 (allow); rows without a label are left out.

    A table above MAX_LABELLED rows is refused. Equal rows count each; a null url has no host and no path.
    """
    host, path = url_parts(F.col("u"))
    pinned = labelled.select(F.col(f"`{url_col}`").alias("u"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y is not null")
    got = pinned.select(buckets(host, path).alias("b"), F.coalesce("u", F.lit("")).alias("u"), "y").orderBy("u", "y").limit(MAX_LABELLED + 1).collect()
    if len(got) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    return fit([r.b for r in got], [r.y for r in got], **options)


#: Words of hosts and paths that a filter should block, and words that it should leave alone.
_BAD = (
    "casino poker bets betting jackpot slots roulette gamble lottery adult xxx porn sex escort nude webcam pills viagra cialis pharma meds spam farm "
    "ads adserver banner track tracker click popup malware phish warez crack keygen torrent loans payday bitcoin replica cheap free win prize"
).split()
_GOOD = (
    "news daily times school college library museum science journal history garden kitchen recipes travel city river mountain music art books health "
    "weather sports research archive forum wiki docs help shop market house family photo code data cloud press review guide school world green north"
).split()
#: Bad words that are also part of harmless names; they are evidence only beside another bad word.
_WEAK = {"cheap", "free", "win", "farm", "prize", "click", "track"}


def labelled_urls(n: int = 12_000, seed: int = 12) -> list[tuple[str, int]]:
    """A small labelled table, made by rule: hosts of bad words, of good words and of arbitrary syllables."""
    import random

    r = random.Random(seed)
    strong = [w for w in _BAD if w not in _WEAK]
    onset = [*"bcdfghjklmnpqrstvwyz", "ch", "sh", "th", "wh", "st", "tr", "br", "pl", "sc", "gr", "thr", ""]
    close = ["", "", "", *"ndrstlmky", "th", "ng", "nd", "nt", "st", "rs", "ble", "ck", "sh"]
    syllable = lambda: r.choice(onset) + r.choice(["a", "e", "i", "o", "u", "ou", "ea", "io", "ie", ""]) + r.choice(close)
    invented = lambda: "".join(syllable() for _ in range(r.randint(2, 5)))[:24] or "x"
    end = lambda: r.choice(["example.com", "example.org", "example.net", "com", "org", "net", "info", "co.uk", "de", "fr"])
    lead = lambda: r.choice(["", "", "www.", "m.", "blog.", "shop.", "en."])
    word = lambda: r.choice([*_GOOD, invented(), invented(), invented()])

    def tail() -> str:
        steps = "/".join([r.choice(["en", "de", "fr", "es", "a", "page", "item", word()]) for _ in range(r.randint(0, 3))] + [str(r.randint(1, 99999))])
        return f"/{steps}" + r.choice(["", "/", ".html", "?page=2&ref=x", "#top", "?utm_source=feed"])

    out = []
    for i in range(n):
        bad = int(i % 3 == 0)
        if bad:
            names = [r.choice(strong), r.choice([*_BAD, invented(), "x", "24", "best", "online"])]
            r.shuffle(names)
            if r.random() < 0.15:  # two weak words, or a harmless host with a bad path
                names = r.sample(sorted(_WEAK), 2)
            host = r.choice(["", "-", "-", "-"]).join(names[: r.choice([1, 2, 2, 2])] if names[0] in strong else names)
            url = f"{lead()}{host}.{end()}{tail()}"
            if r.random() < 0.1:
                url = f"{lead()}{word()}.{end()}/{r.choice(strong)}{r.choice(['/', '-'])}{r.choice(_BAD)}{tail()}"
        else:
            host = r.choice(["", "-"]).join([word() for _ in range(r.choice([1, 1, 2]))])
            if r.random() < 0.1:
                host = r.choice(sorted(_WEAK)) + "-" + r.choice(_GOOD)
            url = f"{lead()}{host}.{end()}{tail()}"
        out.append((r.choice(["http://", "https://"]) + url, bad))
    return out


_fitted: dict[int, Model] = {}


def fitted(spark: SparkSession, rows: int = 12_000) -> Model:
    """The model of labelled_urls(rows), fitted once a process."""
    if rows not in _fitted:
        _fitted[rows] = train(spark.createDataFrame(labelled_urls(rows), "url string, blocked int"))
    return _fitted[rows]


def judge(urls: DataFrame, *, rules: Iterable[Rule] = RULES, model: Model | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, p_block, verdict: the rule's verdict where one fits, else block if the model's
    probability reaches threshold.

    A null url, or one without "://", has empty host and path, fits no rule and is judged by the model. The whole
    url is used at any length. Rows stand for themselves (null and repeated ids are fine); an empty table gives no
    rows; other columns are ignored. Nothing is shuffled.
    """
    model = model or fitted(urls.sparkSession)
    host, path = url_parts(F.col("u"))
    rows = urls.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), tuple(rules))).withColumn("p_block", model.probability(buckets(F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), "p_block", verdict.alias("verdict"))


def filter_urls(pages: DataFrame, *, url_col: str = "url", **options) -> DataFrame:
    """The rows of pages whose url isn't blocked, with all their columns."""
    model = options.pop("model", None) or fitted(pages.sparkSession)
    threshold, rules = options.pop("threshold", 0.5), tuple(options.pop("rules", RULES))
    if options:
        raise TypeError(f"unknown options: {sorted(options)}")
    host, path = url_parts(F.col(f"`{url_col}`"))
    blocked = F.coalesce(matching_rule(host, path, rules)["verdict"] == "block", model.probability(buckets(host, path)) >= threshold)
    return pages.where(~blocked)
