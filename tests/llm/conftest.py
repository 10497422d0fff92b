import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def nasty():
    """(doc_id, text) with nulls, empty, wordless and very long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mí", "ne", "ß") for b in ("ra", "tu", "vé", "x", "日本", "")] + ["a", "I"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(30)
    texts = [None, "", " \t\n ", "one", "one", "two words", prose(20), prose(19), passage, passage, passage + " " + prose(40), prose(60) + "\n" + passage]
    base = prose(200)
    texts += [base, base, base.replace(" ", "\n", 5), base + " tail", base.upper()]
    texts += [prose(5) * 1, "line a b\n" * 30, "x " * 400, prose(12000), "😀 " + prose(70) + " 😀", "a b c d " + prose(60)]
    texts += ["mail a@b.co, +1 (743) 555-3824 or 4111 1111 1111 1111 at 10.0.0.255", "1.2.3.4.5.6.7.8 999.1.1.1 a@b.com_x@y.co.uk", "call me at (555) 123-4567", "order no 555-123-4567"]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(None, passage), (None, None), (7, base), (7, base)]


@pytest.fixture(scope="session")
def docs(spark, nasty):
    return spark.createDataFrame(nasty, "doc_id long, text string").repartition(5)
