"""BM25 and mentions of odd texts against plain versions, and how often the documents are read."""

import math
import re
import sys
import unicodedata
from collections import Counter

from millrace.functions.passages import all_words_of, words_of
from millrace.operators import rank

DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (3, ""), (4, "alpha_beta gamma, gamma; Éclair ½ x 2nd"), (5, "ALPHA alpha alpha the of"), (None, "beta beta gamma"),
    (7, "one two three four five six seven EIGHT nine"), (7, "éclair ½"), (8, "zeta theta"), (9, "alpha other beta"), (10, "İx and Kelvin"),
]
ITEMS = [(1, "alpha beta gamma"), (2, None), (3, "éclair ½"), (4, "one two three four five six seven eight nine ten"), (5, "..."), (6, "alpha beta gamma"), (None, "beta beta"), (8, "kelvin")]


def frames(spark):
    return spark.createDataFrame(DOCS, "d long, t string").repartition(3), spark.createDataFrame(ITEMS, "q long, t string")


def test_mentions_of_odd_texts(spark):
    docs, items = frames(spark)
    want = set()
    for q, x in ITEMS:
        own = all_words_of(x)
        n = min(8, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for d, t in DOCS:
            w = all_words_of(t)
            if any(tuple(w[i : i + n]) in runs for i in range(len(w) - n + 1)):
                want.add((q, d))
    assert {tuple(r) for r in rank.mentions(docs, items, "d", "t", "q", "t").collect()} == want and len(want) > 5


def test_words_are_letters_and_numbers():
    assert not [c for c in map(chr, range(sys.maxunicode + 1)) if bool(re.match(r"[^\W_]", c)) != (unicodedata.category(c)[0] in "LN")]


def test_bm25_of_odd_texts_in_small_steps(spark, monkeypatch):
    docs, items = frames(spark)
    lens = [len(words_of(t)) for _, t in DOCS if t is not None]
    mean, want = sum(lens) / len(lens), {}
    have = [Counter(words_of(t)) for _, t in DOCS]
    for q, x in ITEMS:
        for (d, _), own in zip(DOCS, have, strict=True):
            hit = [t for t in set(words_of(x)) if t in own]
            df = {t: sum(t in o for o in have) for t in hit}
            s = sum(math.log(1 + (len(DOCS) - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean)) for t in hit)
            if hit:
                want.setdefault(q, []).append((-round(s, 6), d is not None, d))
    reads, keep = [], rank.stored
    monkeypatch.setattr(rank, "STEP_CELLS", 16)
    monkeypatch.setattr(rank, "stored", lambda df: reads.append(1) or keep(df))
    got = {}
    for r in rank.bm25(docs, items, "d", "t", "q", "t", 3).orderBy("rank").collect():
        got.setdefault(r.q, []).append((-r.score, r.d is not None, r.d))
    assert reads == [1] and got == {q: sorted(rows)[:3] for q, rows in want.items()}
