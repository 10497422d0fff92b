"""Quality, repeats, contamination, near duplicates and personal data against plain versions."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.contamination import decontaminate
from millrace.llm.pii import find_personal_data, redact
from millrace.llm.quality import QualityRules, quality_rules
from millrace.llm.simhash import fingerprint_links, keep_one_of_each, near_copies, near_duplicates, shard_links
from millrace.llm.components import components
from millrace.llm.frames import spread_join
from millrace.llm.substrings import remove_repeats

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(params=["nasty", "real"])
def table(request, docs, real):
    df = docs if request.param == "nasty" else real
    return df, [tuple(r) for r in df.collect()]


QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality(table):
    df, plain = table
    want = Counter((i, *brute.quality(t, QualityRules())) for i, t in plain)
    assert rows(quality_rules(df, keep=["doc_id"]), "doc_id", *QUALITY) == want


def test_repeats(table):
    df, plain = table
    assert rows(remove_repeats(df, keep=["doc_id"]), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats(plain))


def test_kept_text_is_what_its_hash_says(docs):
    got = remove_repeats(docs).select("kept_sha256", F.sha2("kept_text", 256)).collect()
    assert all(a == b for a, b in got)


def test_contamination(spark, table):
    df, plain = table
    items = [(1, plain[6][1]), (2, "Ka-ra LO mí"), (None, "one"), (3, None), (4, "..."), (5, "line a b line a b line a b line a b line a b")]
    items += [(r.item_id + 10, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(brute.contaminated(plain, items))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate(df, bench, keep=["doc_id"]), *columns) == want
    assert rows(decontaminate(df, bench, keep=["doc_id"], max_pattern_chars=500), *columns) == want


def test_contamination_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Élan: THE quick,brown fox! x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    got = decontaminate(docs, bench).first()
    assert [got.text[s.start : s.end] for s in got.spans] == ["THE quick,brown fox"]


def test_near_duplicates(table):
    df, plain = table
    assert rows(near_duplicates(df), "doc_id", "fingerprint", "component_id") == Counter(brute.components(plain))


def test_links_of_a_dense_cluster(spark):
    import random

    rng = random.Random(5)
    center, fps = rng.getrandbits(64), set()
    for _ in range(700):
        v = center
        for b in rng.sample(range(64), rng.randrange(5)):
            v ^= 1 << b
        fps.add(v)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    got = {r.node: r.root for r in components(fingerprint_links(spark.createDataFrame([(signed(v),) for v in fps], "fp long"))).collect()}
    left, groups = set(fps), []
    while left:
        group, front = set(), [left.pop()]
        while front:
            v = front.pop()
            group.add(v)
            near = {u for u in left if (u ^ v).bit_count() <= 2}
            left -= near
            front += near
        groups.append(group)
    for group in groups:
        assert len({got.get(signed(v), signed(v)) for v in group}) == 1
    assert len({got.get(signed(v), signed(v)) for v in fps}) == len(groups)


def test_one_of_each_stays(docs, nasty):
    label = brute.similar(nasty, 0.8)
    assert label == brute.similar(nasty, 0.65)  # no pair is near the limit
    least = [min((i for i, _ in (nasty[k] for k in range(len(nasty)) if label[k] == g) if i is not None), default=None) for g in set(label)]
    assert rows(keep_one_of_each(docs), "doc_id") == Counter({(i,): 1 for i in least})


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_copies_are_the_components_of_like_shingles(spark, sf):
    """Pairs of similarity 0.8 and more are together, and nothing is that no chain of such pairs connects."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    plain = [tuple(r) for r in docs.collect()]
    want: dict[int, set[int]] = {}
    for (i, _), g in zip(plain, brute.similar(plain, 0.8), strict=True):
        want.setdefault(g, set()).add(i)
    got: dict[int, set[int]] = {}
    for r in near_copies(docs).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(k == min(v) for k, v in got.items())


def test_many_rows_of_one_key_meet_their_row(spark):
    rows = spark.range(20_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    single = spark.range(15_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = spread_join(rows, single, "k")
    assert got.columns == ["k", "id", "v"] and got.selectExpr("sum(v)", "count(*)").first() == rows.join(single, "k").selectExpr("sum(v)", "count(*)").first()


def test_near_copies_of_made_likeness(spark):
    """Copies with single words changed, at known similarities: caught from 0.9 on, left alone under 0.6."""
    import random

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, like = [], []
    for k in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 600))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0.004, 0.01, 0.1, 0.2]))):
            copy[at] = rng.choice(vocabulary)
        a, b = (brute.shingles(" ".join(x)) for x in (base, copy))
        like.append(len(a & b) / len(a | b))
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    group = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(j >= 0.9 for j in like) > 30 and sum(j < 0.6 for j in like) > 30
    for k, j in enumerate(like):
        assert j < 0.9 or group[2 * k] == group[2 * k + 1]
        assert j >= 0.6 or group[2 * k] != group[2 * k + 1]


def test_a_shard_of_many_copies_is_linked_by_its_middle():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, 8, np.uint64)
    fps = np.repeat(center[None], 3000, axis=0)
    for row in fps:
        for bit in rng.choice(512, rng.integers(0, 40), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b = shard_links(np.zeros(3000, np.uint64), fps, 78)
    assert sorted(a.tolist()) == list(range(1, 3000)) and set(b.tolist()) == {0}


def test_a_component_without_ids_keeps_one(spark):
    docs = spark.createDataFrame([(None, "some words of one text"), (None, "some words of one text"), (3, "quite another thing altogether it is")], "doc_id long, text string")
    assert rows(keep_one_of_each(docs), "doc_id") == Counter({(None,): 1, (3,): 1})


def test_base_spans(table):
    df, plain = table
    got = Counter((r.doc_id, tuple(tuple(s) for s in r.pii_base)) for r in find_personal_data(df).collect())
    assert got == Counter((i, tuple(brute.pii(t))) for i, t in plain)


def test_added_spans_need_their_context(docs):
    more = {r.text: [tuple(s) for s in r.pii_spans] for r in find_personal_data(docs).collect()}
    assert more["call me at (555) 123-4567"] == [("phone", 11, 25)]
    assert more["order no 555-123-4567"] == []


def test_redaction_leaves_no_base_span(docs):
    for before, after in zip(docs.collect(), redact(docs).collect(), strict=True):
        assert (after.text is None) == (before.text is None)
        assert brute.pii(after.text) == [] and (brute.pii(before.text) or after.text == before.text or "[PHONE]" in after.text)


HOSTILE = {"numbers": "12 ab " * 170_000, "cards": "4111111111111111 ab " * 50_000, "phones": "tel 555-123-4567 x " * 50_000}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_personal_data_in_long_texts_takes_time_in_proportion(spark, name):
    """A megabyte of matches; a fold that copied its result at every match took minutes for a quarter of that."""
    found = redact(spark.createDataFrame([(1, HOSTILE[name])], "doc_id long, text string")).first().text
    mark = {"numbers": None, "cards": "[CARD]", "phones": "[PHONE]"}[name]
    word = HOSTILE[name].split(" ")[0] if name != "phones" else "555-123-4567"
    assert found == (HOSTILE[name].replace(word, mark) if mark else HOSTILE[name])


def test_personal_data_keeps_columns_of_any_name(spark):
    made = spark.createDataFrame([(1, "mail a@b.co now", 7, 8, 9, 10)], "doc_id long, text string, t int, base int, scored int, pii_spans int")
    assert redact(made).first().asDict() == {"doc_id": 1, "text": "mail [EMAIL] now", "t": 7, "base": 8, "scored": 9, "pii_spans": 10}


@pytest.mark.parametrize("apply", [quality_rules, remove_repeats, near_duplicates, find_personal_data, redact, keep_one_of_each])
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_give_way(spark, docs):
    clash = docs.withColumns({c: F.lit("old") for c in ("kept", "N_WORDS", "n_removed", "contaminated", "pii_spans", "fp", "removed")})
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert rows(quality_rules(clash), "doc_id", *QUALITY) == rows(quality_rules(docs), "doc_id", *QUALITY)
    assert rows(remove_repeats(clash), "doc_id", "n_removed") == rows(remove_repeats(docs), "doc_id", "n_removed")
    assert rows(decontaminate(clash, bench), "doc_id", "contaminated") == rows(decontaminate(docs, bench), "doc_id", "contaminated")
    assert find_personal_data(clash).count() == docs.count() and "fp" in redact(clash).columns
    assert near_duplicates(clash).count() == docs.count()


def test_columns_named_as_intermediate_results_stay(spark, docs):
    odd = {"order_id": 1, "removed": 2, "hits_found": 3, "items_found": 4, "fp": 5, "node": 6, "root": 7, "shard": 8, "n": 9, "spans0": 10}
    table = docs.select("doc_id", "text", *(F.lit(v).alias(k) for k, v in odd.items()))
    bench = spark.createDataFrame([(1, "Ka-ra LO mí")], "item_id long, text string")
    for done in (remove_repeats(table), decontaminate(table, bench), quality_rules(table), redact(table), keep_one_of_each(table)):
        assert {tuple(r) for r in done.select(*odd).distinct().collect()} == {tuple(odd.values())}


def test_decontamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_items > 0 or contaminated").count() == 0
