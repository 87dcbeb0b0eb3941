"""Personal data: generators propose spans, boosted trees choose among them. DataFrame functions only.

Spans of the four base kinds are fixed by pattern and check, and always stay. Wider generators propose more:
obfuscated addresses, national phone numbers, numbered identities, bank accounts, secrets (tokens of 16 characters or more behind a key,
known forms of keys), and base matches that failed their check. Each candidate gets features of its format
and context, all computed by Spark; boosted trees, fitted on the driver to a generated sample of fixed size, become
one expression. A candidate is redacted if its calibrated probability reaches its kind's threshold, it overlaps no
base span, and no candidate of a higher probability that is redacted overlaps it.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in their order, with patterns that find the contract's leftmost matches without rescanning long runs
#: (possessive parts give up nothing that a match could need; a run that failed once is not tried from inside).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
_HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
#: Wider generators: what spans are called, pattern, hint. The number is the generator's feature.
WIDE = {
    "email": (4, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++", "[(\\[{]at[)\\]}]"),
    "phone": (5, r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])", "[0-9][) ./-]{1,2}[0-9]{2,4}[ ./-][0-9]{2}"),
    "identity": (6, r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-[0-9]{2}-"),
    "account": (7, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "secret": (8, r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9+/_-]{8,}+)*+=*+", "[A-Za-z0-9+/_-]{16}"),
}
ORDER = ["email", "ip", "card", "phone", "identity", "account", "secret"]
#: Context words that speak for (by kind) or against a candidate.
CONTEXT = {
    "email": "mail|write|contact|reach|address", "phone": "phone|tel|call|mobile|cell|fax|dial|text", "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|master", "identity": "ssn|social|security|identity|passport|tax", "account": "iban|account|bank|transfer|konto",
    "secret": "[a-z_-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?",
}
#: What stands between a key's name and a secret.
KEY_GAP = r"""["']?\s{0,2}(?:[=:]|=>|is)?\s{0,2}["'`]?$"""
DATE = r"^(?:[0-9]{4}([./-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./ -])[0-9]{2}\2(?:[0-9]{2}|[0-9]{4}))$"
#: Forms that keys of well-known services have: fixed prefixes.
KEY_FORM = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|eyJ)"
AGAINST = "order|invoice|version|isbn|serial|part|model|section|page|item|ticket|build|case|ref|number of|total|sku"
FEATURES = ["generator", "digits", "length", "luhn", "marks", "letters", "in_range", "context", "against", "left_alnum", "right_alnum", "groups", "spaces", "cases", "keyed", "form", "quoted", "hex", "dated", "zero"]
THRESHOLD_PRECISION = 0.95


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    """True if all parts between dots are at most 255, whatever their leading zeros."""
    return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int") <= 255, F.lit(False)))


def _luhn(x: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", x), F.lit(False))


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": _octets(m), "card": n.between(12, 19) & _luhn(_digits(m)), "phone": n.between(9, 15)}[kind]


def _matches(text: Column, pattern: str, hint: str, kind: str, generator: int, keep) -> Column:
    """Array of (kind, s, e, m, before, after, generator): the pattern's matches that keep(m) accepts.

    The pieces between the matches give their places; positions are code points.
    """
    kind_of = "array<struct<kind:string,s:int,e:int,m:string,before:string,after:string,generator:int>>"
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    both = F.zip_with(both, F.slice(pieces, 2, F.size(found)), lambda b, after: F.struct(b["p"].alias("p"), b["m"].alias("m"), after.alias("after")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(32)).alias("before"), F.left(x["after"], F.lit(4)).alias("after"), F.lit(generator).alias("generator"))
        return F.struct(e.alias("at"), F.when(keep(x["m"]), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    spans = F.aggregate(both, zero, step, lambda a: a["out"])
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(kind_of))


def base_spans(text: Column) -> Column:
    """Array of the base matches of a text (null: empty), by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    every = F.concat(*[_matches(text, p, _HINT[k], k, i, lambda m, k=k: _passes(k, m)) for i, (k, p) in enumerate(BASE.items())])
    return _by_place(every)


def _by_place(spans: Column) -> Column:
    def key(x: Column) -> Column:
        return F.struct(x["s"], F.array_position(F.array(*[F.lit(k) for k in ORDER]), x["kind"]), x["e"])

    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(key(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def candidates(text: Column) -> Column:
    """Array of what the wider generators propose: their matches, and base matches that failed their check but look
    near to one."""
    text = F.coalesce(text, F.lit(""))
    failed = {
        "ip": lambda m: ~_octets(m),
        "card": lambda m: F.length(_digits(m)).between(12, 19) & ~_luhn(_digits(m)),
        "phone": lambda m: F.length(_digits(m)).between(7, 8),
    }
    parts = [_matches(text, BASE[k], _HINT[k], k, list(BASE).index(k), f) for k, f in failed.items()]
    parts += [_matches(text, p, hint, k, g, lambda m: F.lit(True)) for k, (g, p, hint) in WIDE.items()]
    return F.concat(*parts)


def feature_values(x: Column) -> dict[str, Column]:
    """The features of a candidate."""
    m, before = x["m"], F.lower(x["before"])
    near = F.lit(False)
    for k, words in CONTEXT.items():
        near = F.when(x["kind"] == k, before.rlike(rf"\b(?:{words})")).otherwise(near)
    kinds = [m.rlike("[a-z]"), m.rlike("[A-Z]"), m.rlike("[0-9]"), m.rlike("[^A-Za-z0-9]")]
    n = F.length(_digits(m))
    values = {
        "generator": x["generator"], "digits": n, "length": F.length(m), "luhn": _luhn(_digits(m)), "marks": F.length(F.regexp_replace(m, "[A-Za-z0-9 ]", "")),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "in_range": F.coalesce(F.regexp_extract(m, r"^\(?([0-9]{3})", 1).try_cast("int").between(100, 899), F.lit(False)),
        "context": near, "against": before.rlike(rf"\b(?:{AGAINST})"), "left_alnum": before.rlike("[a-z0-9]$"), "right_alnum": x["after"].rlike("^[A-Za-z0-9]"),
        "groups": F.size(F.split(m, "[ .-]+")), "spaces": F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))),
        "cases": reduce(lambda a, b: a + b, [k.cast("int") for k in kinds]), "keyed": before.rlike(rf"\b(?:{CONTEXT['secret']}){KEY_GAP}"),
        "form": m.rlike(KEY_FORM), "quoted": before.rlike("""["'`]$"""), "hex": m.rlike("^[0-9a-f]+$") & kinds[0] & kinds[2],
        "dated": m.rlike(DATE), "zero": m.rlike(r"^\(?0"),
    }
    return {k: values[k].cast("double") for k in FEATURES}


@dataclass
class Trees:
    """Boosted trees of depth 2: (feature, cut, ((feature, cut), (feature, cut)), four leaves), with Platt's scale."""

    trees: list[tuple]
    bias: float
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, c, sides, leaves in self.trees:
            right = x[:, f] > c
            lower = np.where(right, x[:, sides[1][0]] > sides[1][1], x[:, sides[0][0]] > sides[0][1])
            out += np.asarray(leaves)[right * 2 + lower]
        return out

    def expression(self, values: list[Column]) -> Column:
        """The calibrated probability as one expression."""
        parts = []
        for f, c, sides, leaves in self.trees:
            low = F.when(values[sides[0][0]] > sides[0][1], float(leaves[1])).otherwise(float(leaves[0]))
            high = F.when(values[sides[1][0]] > sides[1][1], float(leaves[3])).otherwise(float(leaves[2]))
            parts.append(F.when(values[f] > c, high).otherwise(low))
        total = reduce(lambda a, b: a + b, parts, F.lit(self.bias))
        return 1.0 / (1.0 + F.exp(-(total * self.scale[0] + self.scale[1])))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float]:
    """Gain, feature and cut of the best split."""
    best = (0.0, 0, np.inf)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        values = x[rows, f]
        for c in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12), method="lower")) if len(rows) else ():
            left = rows[values <= c]
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c))
    return best


def boost(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, *, rounds: int = 60, rate: float = 0.3) -> Trees:
    """Gradient boosting on logistic loss; every third row is left for calibration and thresholds."""
    held = np.arange(len(y)) % 3 == 2
    xt, yt = x[~held], y[~held].astype(float)
    bias = float(np.log((yt.mean() + 1e-3) / (1 - yt.mean() + 1e-3)))
    trees, s = [], np.full(len(yt), bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        g, h = yt - p, p * (1 - p) + 1e-6
        _, f, c = _split(xt, g, h, np.arange(len(yt)))
        parts, sides, leaves = [np.flatnonzero(xt[:, f] <= c), np.flatnonzero(xt[:, f] > c)], [], []
        for rows in parts:
            _, f2, c2 = _split(xt, g, h, rows)
            sides.append((f2, c2))
            for some in (rows[xt[rows, f2] <= c2], rows[xt[rows, f2] > c2]):
                leaves.append(float(rate * g[some].sum() / (h[some].sum() + 1)))
        trees.append((f, c, tuple(sides), tuple(leaves)))
        right = xt[:, f] > c
        lower = np.where(right, xt[:, sides[1][0]] > sides[1][1], xt[:, sides[0][0]] > sides[0][1])
        s += np.asarray(leaves)[right * 2 + lower]
    model = Trees(trees, bias, (1.0, 0.0), {})
    raw, yh = model.raw(x[held]), y[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt's scale by Newton steps, kept near 1 by a weak prior
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - yh) * raw).sum() + (a - 1), (p - yh).sum() + b])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    model.scale = (float(a), float(b))
    p = 1 / (1 + np.exp(-(a * raw + b)))
    for k in ORDER:
        mine = kinds[held] == k
        cuts = [t for t in np.arange(0.5, 0.96, 0.05) if (mine & (p >= t)).any() and yh[mine & (p >= t)].mean() >= THRESHOLD_PRECISION]
        model.thresholds[k] = float(min(cuts)) if cuts else 1.1  # never
    return model


def sample_texts(n: int = 5000, seed: int = 6) -> list[tuple[str, int, int]]:
    """Generated texts with one marked place each: (text, start, end of the personal data; -1 for a decoy)."""
    r = random.Random(seed)
    words = "the a of and to in that it was for on with as at by from this be are an or which had not but".split()
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    area = lambda: str(r.randint(201, 899))
    lead = {"email": ["mail", "write to", "contact", "reach me:"], "phone": ["phone", "tel:", "call", "mobile", "fax"], "card": ["card", "visa", "credit card", "payment by"], "identity": ["SSN", "social security", "passport", "tax id"], "account": ["IBAN", "account", "bank transfer to"]}
    bad = ["order", "invoice", "version", "ISBN", "serial", "part", "model", "section", "ticket", "ref"]
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))
    lead |= {"secret": ["token", "api_key", "API-KEY", "password", "secret", "access_key", "auth_token", "passwd", "client_secret", "Bearer"], "ip": ["ip", "host", "server", "login from", "address"]}
    at, dot = ["(at)", "[at]", " (at) ", " [at] "], ["(dot)", "[dot]", ".", " [dot] "]
    make = {
        "email": lambda: f"{name()}.{name()}{r.choice(at)}{name()}{r.choice(dot)}{r.choice(['com', 'org', 'net'])}",
        "phone": lambda: r.choice([f"({area()}) {num(3)}-{num(4)}", f"{area()}-{num(3)}-{num(4)}", f"{area()}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)}/{num(3)} {num(4)}"]),
        "card": lambda: r.choice([num(16), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"]),
        "identity": lambda: f"{area()}-{r.randint(10, 99)}-{num(4)}",
        "secret": lambda: r.choice([hexa(r.choice([32, 40, 64])), mixed(r.choice([20, 24, 32, 40])), "AKIA" + num(4) + "".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(12)), "ghp_" + mixed(36), "sk_live_" + mixed(24), f"eyJ{mixed(20)}.{mixed(40)}.{mixed(30)}"]),
        "ip": lambda: ".".join(str(r.randint(0, 999)) for _ in range(3)) + f".{r.randint(256, 999)}",
        "account": lambda: r.choice(["DE", "FR", "GB", "ES", "NL"]) + num(2) + r.choice(["", " "]).join(["", num(4), num(4), num(4), num(4)]),
    }
    out = []
    for _ in range(n):
        kind = r.choice(list(make))
        body, true = make[kind](), r.random() < 0.5
        if kind == "ip":
            true = False  # an address whose parts are at most 255 is a base span already; others are versions or places
        if kind == "secret":
            # a form tells alone, a key's name before it as well; digests, names and paths are not secrets
            bare = body.startswith(("AKIA", "ghp_", "sk_live_", "eyJ"))
            if not true:
                body = r.choice([hexa(40), hexa(64), "-".join(name() + name() for _ in range(3)), "/".join(name() for _ in range(5)), (name() + name() + name()).ljust(18, "e"), name() + "_" * 16, "-" * 20, num(18), "=".join([name() * 4, ""])])
            gap = r.choice([' = "', ": ", "=", '": "', " ", " = '", "= "])
            before = " ".join(r.choice(words) for _ in range(r.randint(3, 12))) + " "
            before += (r.choice(lead[kind]) + gap) if true and (not bare or r.random() < 0.5) else r.choice(["", "commit ", "sha256 ", "sha1: ", "digest = ", "etag ", "checksum: ", "file ", "see ", 'id "', "path = "])
            out.append((before + body + r.choice(['" ', " ", ", ", "' ", "### "]) + words[0], len(before) if true else -1, len(before) + len(body) if true else -1))
            continue
        if kind in ("email", "account") and not true and r.random() < 0.7:
            body = r.choice([f"{name()} (at) {name()}.", f"AB{num(2)} {num(4)} {num(4)} {num(4)}", f"XX{num(2)}{num(12)}"])
        local = kind == "phone" and body.startswith("0")  # these formats don't tell alone
        if kind == "phone" and not true and r.random() < 0.5:
            local = True  # dates and other numbers are none, whatever stands before them
            body = r.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)} {num(2)} {num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{r.randint(1, 9)}{num(2)}.{num(3)}.{num(3)}"])
        dated = kind == "phone" and not true and body[:2].isdigit() and len(body) == 10 and len(body.replace("-", ".").split(".")) == 3
        cue = r.choice(lead[kind]) if true or (dated and r.random() < 0.5) else r.choice([*bad, *words])
        if true and kind in ("email", "phone", "identity") and not local and r.random() < 0.3:
            cue = r.choice(words)  # its format alone tells
        if not true and kind in ("email", "phone", "identity") and not local and cue not in bad:
            cue = r.choice(bad)  # without a cue against it, the same format is personal data
        before = " ".join(r.choice(words) for _ in range(r.randint(3, 12))) + f" {cue} "
        after = r.choice([" ", ". ", ", "]) + " ".join(r.choice(words) for _ in range(r.randint(2, 8)))
        out.append((before + body + after, len(before) if true else -1, len(before) + len(body) if true else -1))
    return out


_fitted: dict[int, Trees] = {}


def fitted(spark: SparkSession, rows: int = 5000) -> Trees:
    """Trees fitted to sample_texts(rows), once a process; the candidates' features come from the same expressions
    that score documents."""
    if rows not in _fitted:
        texts = spark.createDataFrame(sample_texts(rows), "text string, s int, e int")
        found = texts.select("text", "s", "e", F.explode(candidates(F.col("text"))).alias("x"))
        hit = (F.col("x.s") < F.col("e")) & (F.col("s") < F.col("x.e"))
        got = found.select("text", F.col("x.s").alias("at"), F.col("x.kind").alias("kind"), hit.cast("int").alias("y"), F.array(*feature_values(F.col("x")).values()).alias("f"))
        got = sorted((r.text, r["at"], r.kind, r.y, r.f) for r in got.collect())
        order = random.Random(rows).sample(range(len(got)), len(got))
        _fitted[rows] = boost(np.array([got[i][4] for i in order]), np.array([got[i][3] for i in order]), np.array([got[i][2] for i in order]))
    return _fitted[rows]


def chosen(found: Column, base: Column, model: Trees) -> Column:
    """The candidates that the trees accept and that overlap neither base spans nor one another: of overlapping ones the
    one of the highest calibrated probability (ties: the first)."""
    scored = F.transform(found, lambda x: F.struct(x.alias("x"), model.expression(list(feature_values(x).values())).alias("p")))
    good = F.filter(scored, lambda c: c["p"] >= _threshold(c["x"]["kind"], model))
    good = F.filter(good, lambda c: ~F.exists(base, lambda b: (b["s"] < c["x"]["e"]) & (c["x"]["s"] < b["e"])))
    ranked = F.array_sort(F.transform(good, lambda c: F.struct((-c["p"]).alias("p"), c["x"]["s"].alias("s"), c["x"]["generator"].alias("g"), c["x"].alias("x"))))
    ranked = F.transform(ranked, lambda c: c["x"])

    def step(a: Column, x: Column) -> Column:
        free = ~F.exists(a, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.when(free, F.concat(a, F.array(x))).otherwise(a)

    return F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), step)


def _threshold(kind: Column, model: Trees) -> Column:
    out = F.lit(1.1)
    for k, t in model.thresholds.items():
        out = F.when(kind == k, F.lit(t)).otherwise(out)
    return out


def find(docs: DataFrame, *, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (kind, s, e, m, ...) in code points, end exclusive; spans holds base as well.

    Null texts count as empty; null and repeated ids are fine; other columns are ignored. Nothing is shuffled.
    """
    model = model or fitted(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), base_spans(text).alias("base"), candidates(text).alias("found"))
    rows = rows.withColumn("added", F.when(F.size("found") > 0, chosen(F.col("found"), F.col("base"), model)).otherwise(F.col("found")))
    return rows.select("doc_id", "base", F.when(F.size("added") > 0, _by_place(F.concat("base", "added"))).otherwise(F.col("base")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, *, model: Trees | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span found replaced by its kind in square brackets; overlapping spans become one. All columns
    are kept; null texts stay null."""
    model = model or fitted(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    base = base_spans(text)
    spans = _by_place(F.concat(base, chosen(candidates(text), base, model)))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        add = F.when(x["s"] >= a["at"], F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], add).alias("out"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, done)
