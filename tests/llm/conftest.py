import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns named like ours."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Ä", "naïve", "e-mail", "🙂"]
    long = " ".join(r.choice(words) for _ in range(20_000))
    passage = " ".join(r.choice(words) for _ in range(70))
    rows = [
        (1, passage, "s1"), (2, None, "s1"), (3, "", None), (4, "   \n\t ", "s2"), (5, long, "s2"), (6, long + " end", "s1"), (7, f"before {passage} after", "s2"),
        (8, "one", "s1"), (9, "two words", ""), (10, passage, "s1"), (10, passage, "s1"), (None, "no id here", "s1"), (None, None, None), (13, "x" * 50_000, "s2"),
        (14, passage.upper(), "s1"), (15, "mail me: a.b@c.de or +1 (743) 555-3824", "s1"), (16, f"{passage} {passage}", None),
    ]
    full = [(i, t, "en", s, len(t or ""), "x", 1, "y", 2) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, size int, _gone string, repeats int").repartition(3)


@pytest.fixture(scope="session")
def unique(odd):
    """The same without null and repeated ids."""
    return odd.where("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
