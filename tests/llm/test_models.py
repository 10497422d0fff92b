"""Language models, packing, pages, archives and the pipeline."""

import gzip
import io
import time
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text, kneser_ney, packing, simhash, warc
from millrace.llm.cross_entropy import score_documents
from millrace.llm.hashing import chunks
from millrace.llm.html_blocks import BLOCK, CLOSES, RAW, VOID, blocks, vectors
from millrace.llm.kneser_ney import classify_quality, fit
from millrace.llm.ngrams import Lookup, trusted_sample

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_lookup_finds_all_and_nothing_else():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    table = Lookup(keys[::2], np.arange(len(keys[::2])))
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.find(keys[1::2]) == -1).all()


def test_cross_entropy_difference(spark, docs, nasty):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in nasty if i is not None and i % 2], "doc_id long, quality int, toxic int")
    plain = [(i, t) for i, t in nasty if i is not None and i != 7]
    table = docs.where("doc_id is not null and doc_id <> 7")
    target = set(trusted_sample(table, labels, 100, 10**6))
    want = brute.bigram_losses(plain, target)
    for r in score_documents(table, labels).collect():
        background, own = want[r.doc_id]
        if background is None:
            assert r.n_words == 0 and r.difference is None
        else:
            assert r.background_loss == pytest.approx(background) and r.target_loss == pytest.approx(own)


def test_cross_entropy_without_rows_or_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_documents(docs, none).where("n_words > 0 and difference is null").count() == 0
    assert score_documents(docs.limit(0), none).count() == 0


def test_kneser_ney_probabilities(spark):
    texts = [r.text for r in read(spark, "documents").orderBy("doc_id").limit(60).collect()]
    model = fit(spark.createDataFrame([(t,) for t in texts[:40]], "text string"))
    plain = brute.kneser_ney(texts[:40])
    import pyarrow as pa

    for chunk in chunks(pa.array(texts[30:])):
        n, loss = model.scores(chunk)
        for i in range(chunk.n):
            want = plain(texts[30 + chunk.first + i])
            assert want is None and n[i] == 0 or loss[i] == pytest.approx(want)


def test_quality_classifier_keeps_the_clean(spark):
    sf = "/root/testdata/sf0.1"  # a plain quantile of 0.99 needs some hundred texts a language
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = classify_quality(docs, labels).join(labels, "doc_id").where("n_words >= 50")
    clean = found.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    scores = {r.quality: r.m for r in found.groupBy("quality").agg(F.avg("log_perplexity").alias("m")).collect()}
    assert clean > 0.99 and scores[0] > scores[1] + 2


def test_quality_classifier_counts_all_trusted_texts(spark, docs, nasty):
    """The model is that of all trusted texts, and each of them counts for its threshold under the texts of other folds."""
    labels = read(spark, "labels").select("doc_id", "quality", "toxic").union(spark.createDataFrame([(10**6 + i, 1, 0) for i in (7, 30, 36, 39)], "doc_id long, quality int, toxic int"))
    odd = docs.select(F.col("doc_id") + 10**6, "text", F.lit(None).cast("string"))
    table = read(spark, "documents").select("doc_id", "text", "lang").union(odd).repartition(3).cache()
    good = {r.doc_id for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    rows = table.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT))).collect()
    trusted = {(r.doc_id, r.text): r for r in rows if r.doc_id in good}.values()
    plain, whole = brute.kneser_ney([r.text for r in trusted]), [r.text for r in trusted]
    held = {}
    for k in range(kneser_ney.HELD_OUT):
        model = brute.kneser_ney([r.text for r in trusted if r.fold != k], whole)
        for r in trusted:
            if r.fold == k and brute.words(r.text):
                held.setdefault(r.lang, []).append(model(r.text))
    limits = {x: np.quantile(v, 0.99) for x, v in held.items() if x} | {None: np.quantile(sum(held.values(), []), 0.99)}
    want = {(r.doc_id, r.text): plain(r.text) for r in rows}
    got, split = (classify_quality(table, labels, bucket_words=n).collect() for n in (kneser_ney.BUCKET_WORDS, 2000))
    assert len(got) == len(rows) and len({r.lang for r in trusted}) > 2
    for r in got + split:  # frequent words in one bucket, and in several
        loss = want[r.doc_id, r.text]
        assert r.log_perplexity is None if loss is None else r.log_perplexity == pytest.approx(loss)
        assert r.threshold == pytest.approx(limits[r.lang], abs=2e-4) and r.kept == (loss is not None and r.log_perplexity <= r.threshold)


def test_quality_classifier_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    got = classify_quality(table, none)
    assert got.where("n_words > 0 and not kept").count() == 0 and got.where("n_words = 0 and kept").count() == 0
    some = spark.createDataFrame([(30, 1, 0), (36, 1, None), (39, 1, 0), (60, 1, 0), (63, 1, 0)], "doc_id long, quality int, toxic int")
    assert classify_quality(table, some).count() == docs.count()
    assert classify_quality(table.limit(0), some).count() == 0


def test_packing_places_every_token_once(docs, nasty):
    got = packing.best_fit_packing(docs, capacities=(16, 64, 256), shard_tokens=4000).collect()
    sizes = Counter()
    bins = {}
    for r in got:
        sizes[r.doc_id] += r.n_tokens
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None
    want = Counter()
    for i, t in nasty:
        want[i] += len(brute.words(t))
    assert sizes == want
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == rows[0].bin_used <= rows[0].bin_capacity
        assert rows[0].bin_capacity == min(c for c in (16, 64, 256) if c >= at)


def test_packing_takes_the_tightest_bin():
    lengths = np.array([60, 50, 30, 14, 10, 4])
    bins, offsets, use, cap = packing.pack(lengths, (64,), float)
    assert bins.tolist() == [0, 1, 2, 1, 2, 0] and use.tolist() == [64, 64, 40] and cap.tolist() == [64, 64, 64]
    assert offsets.tolist() == [0, 0, 0, 50, 30, 60]


@pytest.mark.parametrize("seed", range(6))
def test_packing_agrees_with_a_plain_version(seed):
    """Several capacities at once, at two prices: the plain version tries every open bin and every capacity."""
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 65 if seed % 2 else 20, int(rng.integers(1, 250))))[::-1]
    for capacities, cost in (((16, 32, 64), packing.sequence_cost), ((8, 24, 64), lambda c: c + 5 + c * c / 100), ((64,), float)):
        if lengths.max() <= max(capacities):
            bins, offsets, use, cap = packing.pack(lengths, capacities, cost)
            want = brute.pack(lengths.tolist(), capacities, cost)
            assert (bins.tolist(), use.tolist(), cap.tolist()) == want
            filled = [0] * len(use)
            for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
                assert o == filled[b]
                filled[b] += n


def test_packing_of_nothing_and_of_one_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(empty).count() == 0
    same = spark.createDataFrame([(5, "a b c " * 100, "bin", 3)] * 400, "doc_id long, text string, shard string, n int")
    got = packing.best_fit_packing(same, shard_tokens=10_000).collect()
    assert sum(r.n_tokens for r in got) == 400 * 300 and len({r.bin_id >> 32 for r in got}) > 6  # one id spreads over the shards


def test_packing_wastes_little(spark):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 4000, 5000))[::-1]
    _, _, use, cap = packing.pack(lengths)
    assert use.sum() == lengths.sum() and use.sum() / cap.sum() > 0.99


def test_blocks_of_broken_markup():
    page = "<p>a<p>b &amp; c<br>d<script>var x='</p>';</script><ul><li>e<li><b>f</ul><div class=\"x y\">g<!-- <p>no --></div>tail <a href=q>h</a>"
    assert [b.text for b in blocks(page)] == ["a", "b & c d", "e", "f", "g", "tail h"]
    assert blocks(None) == [] and blocks("<<<>") != None  # noqa: E711
    assert [b.text for b in blocks("x" * 300_000)] == ["x" * 300_000]


def test_formulas_and_objects_are_text():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc²</mi></math> here</p><p>See <object data='x.swf'>the drawing</object> too</p><svg><text>no</text></svg></article>"
    assert [b.text for b in blocks(page)] == ["Energy is E=mc² here", "See the drawing too"]


def test_blocks_agree_with_a_plain_parser(spark):
    rng = np.random.default_rng(3)
    pages = [r.html for r in read(spark, "pages").collect()] + [html_text.seed_page(rng)[0] for _ in range(150)]
    for page in pages:
        assert [(b.path, b.text) for b in blocks(page)] == brute.blocks(page, BLOCK, RAW, VOID, CLOSES)


def test_labels_agree_with_a_plain_loop():
    rng = np.random.default_rng(4)
    model = html_text.fitted()
    found = [f for _ in range(6) if (f := blocks(html_text.seed_page(rng)[0]))]
    for page in found:
        x, mask = html_text.padded([vectors(page)])
        assert model.probabilities(x, mask)[:, 0] == pytest.approx(brute.labels(model.weights, vectors(page), html_text.HIDDEN), abs=1e-4)
    both, mask = html_text.padded([vectors(p) for p in found])  # and in one padded batch
    for i, page in enumerate(found):
        alone, own = html_text.padded([vectors(page)])
        assert model.probabilities(both, mask)[: len(page), i] == pytest.approx(model.probabilities(alone, own)[:, 0], abs=1e-5)


HOSTILE = {
    "nested": "<div>x" * 170_000, "unended": "<a" * 500_000, "closings": "<div>" * 80_000 + "</p>" * 80_000 + "end", "quotes": "<a '\">" * 150_000,
    "drawings": "x<svg/>" * 140_000, "comment": "a<!--" * 200_000, "names": f'<div class="{"ab " * 150_000}">' + "".join(f"<p id=n{'a' * (i % 50)}>x" for i in range(40_000)),
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages_take_time_and_memory_in_proportion(name):
    """A megabyte each: within a minute, and within a gigabyte for the blocks, paths and vectors of 170 000 blocks."""
    began = time.perf_counter()
    tracemalloc.start()
    found = blocks(HOSTILE[name])
    vectors(found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.perf_counter() - began < 60 and most < 1e9
    assert len(found) == {"nested": 170_000, "unended": 1, "closings": 1, "drawings": 1, "comment": 1, "names": 40_000}.get(name, len(found))


def test_labeller_on_pages_it_has_not_seen():
    model = html_text.fitted()
    right = total = 0
    for x, y in html_text.seed_set(150, 77):
        batch, mask = html_text.padded([x])
        right += int(((model.probabilities(batch, mask)[:, 0] >= 0.5) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.98


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = html_text.train(20, 1)
    pages = html_text.seed_set(4, 8)
    x, mask = html_text.padded([p[0] for p in pages])
    y = np.zeros(mask.shape, np.float32)
    for i, (_, labels) in enumerate(pages):
        y[: len(labels), i] = labels
    _, grads = model.gradients(x, mask, y)
    for name in ("fw", "bu", "fb", "v"):
        flat = model.weights[name].reshape(-1)
        at = int(rng.choice(np.flatnonzero(np.abs(grads[name].reshape(-1)) > 1e-3)))
        kept, losses = flat[at], []
        for step in (0.02, -0.02):
            flat[at] = kept + step
            losses.append(model.gradients(x, mask, y)[0])
        flat[at] = kept
        assert (losses[0] - losses[1]) / 0.04 == pytest.approx(grads[name].reshape(-1)[at], rel=0.05, abs=2e-3)


def test_main_text_of_the_pages(spark):
    import html
    import re

    pages = read(spark, "pages")
    bad = 0
    for r in html_text.extract_main_text(pages).collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        bad += r.text != "\n\n".join(p for p in parts if p) or r.n_chars != len(r.text)
    assert bad == 0
    edge = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<nav>x</nav>", "old")], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in html_text.extract_main_text(edge).orderBy("page_id").collect()] == [(1, ""), (2, ""), (3, "")]


def test_archives_round_trip(spark):
    long = "<p>same</p>" * 20
    rows = [(1, "http://b.org/x y", long), (2, "http://a.org:80/\r\nEvil: 1", long), (3, None, "short"), (4, "http://[bad", "short"), (5, "HTTP://A.org/", None), (None, "http://a.org/n", long)]
    rows += [(6, "http://a.org/z", "WARC/1.1\r\n\r\n" * 30 + "日本"), (7, "http://c.org", long), (7, "http://c.org", long), (1, "http://b.org/x y", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(pages).collect()
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        seen = html == long and page != 1
        want[(page, len(data), brute.sha(data), "revisit" if seen else "response", 1 if seen else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.capture_time, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_large_pages_and_odd_columns_are_archived(spark):
    big = "<p>" + "y" * 100_000
    rows = [(i, f"http://a.org/{i}", big if i % 2 else big + str(i), 1, "x") for i in range(20)] + [(100 + i, None, None, 1, "x") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int, payload string")
    got = warc.archive_round_trip(pages).collect()
    assert Counter(r.record_type for r in got) == {"response": 11 + 50, "revisit": 9} and {r.refers_to for r in got} == {None, 1}
    keys = [(r.url_key, r.capture_time) for r in got]
    assert keys == sorted(keys)  # one order over all partitions
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(empty).count() == 0


def test_damaged_archives_are_refused():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert len(list(warc.read_records(io.BytesIO(record * 2)))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b"no record\r\n")))))


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 0, 4], [1] * 7, [9, 2, 30, 1, 0, 4]])
def test_loser_tree_merges(sizes):
    rng = np.random.default_rng(len(sizes))
    runs = [sorted(rng.integers(0, 10, n).tolist()) for n in sizes]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= before
            docs = out.checkpoint()
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == kept
    assert all(brute.pii(r.text) == [] for r in docs.collect())
    assert all(brute.quality(r.text, __import__("millrace.llm.quality", fromlist=["x"]).QualityRules())[0] >= 40 for r in docs.collect())


def plain_losses(text, own, texts):
    """Mean loss of a text under a bigram model of own, over the vocabulary of texts: every word and pair counts."""
    n = Counter(w for t in own for w in t.split())
    pairs = Counter(p for t in own for p in zip(t.split(), t.split()[1:]))
    size, total = len({w for t in texts for w in t.split()}), sum(n.values())
    loss, last = 0, None
    for w in text.split():
        p = (n[w] + 0.5) / (total + 0.5 * (size + 1))
        if last is not None:
            after = [c - 0.75 for (a, _), c in pairs.items() if a == last]
            p = max(pairs[last, w] - 0.75, 0) / max(n[last], 1) + max(1 - sum(after) / max(n[last], 1), 1e-9) * p
        loss, last = loss - np.log(p), w
    return loss / len(text.split())


def test_rare_words_and_pairs_count_alike_at_any_size(spark):
    """Beside a corpus of three million words, of which a millionth would cut words and pairs that occur once or twice."""
    rows = [(1, "aa bb cc dd"), (2, "aa bb"), (3, "ee ff"), (4, "aa bb zz"), (5, None), (5, "ee ff")]
    rows += [(100 + i, "common filler " * 5000) for i in range(300)]
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    texts = [t for _, t in rows if t]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels).where("doc_id < 100").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in rows[:6])
    for r in got:
        if r.text is None:
            assert r.n_words == 0 and r.difference is None
        else:
            assert r.background_loss == pytest.approx(plain_losses(r.text, texts, texts))
            assert r.target_loss == pytest.approx(plain_losses(r.text, ["aa bb"], texts))


def test_every_trusted_text_counts_once_for_the_target(spark):
    """More of them than were sampled before; rows that repeat, and texts without id, do not count again."""
    rows = [(i, f"aa b{i % 7} c{i % 11}") for i in range(4200)] + [(None, "aa aa aa"), (None, "b1 c1")] + [(7, "dd ee")] * 5 + [(7, None), (5000, "ff aa")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4200)] + [(None, 1, 0), (5000, 0, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    texts, target = [t for _, t in rows if t], [t for i, t in rows[:4200]] + ["dd ee"]
    got = {(r.text, round(r.target_loss, 6), round(r.background_loss, 6)) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels).where("text is not null").collect()}
    asked = ["aa aa aa", "dd ee", "ff aa", rows[5][1]]
    assert {x for x in got if x[0] in asked} == {(t, round(plain_losses(t, target, texts), 6), round(plain_losses(t, texts, texts), 6)) for t in asked}


def test_a_shard_of_near_copies_is_searched_in_little_memory():
    rng = np.random.default_rng(3)
    fps = np.repeat(rng.integers(0, 1 << 63, (1, 8), dtype=np.uint64), 1000, axis=0) ^ (np.uint64(1) << rng.integers(0, 60, (1000, 8)).astype(np.uint64))
    tracemalloc.start()
    a, b = simhash.shard_links(np.zeros(1000, np.int64), fps, 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) and peak < 10e6  # fingerprints of all pairs side by side took 19 MB
    pairs = rng.integers(0, 1000, (2, 70_001))
    assert (simhash._distances(fps, *pairs) == simhash._distance(fps[pairs[0]], fps[pairs[1]])).all()


def test_a_trusted_text_that_does_not_fit_ends_nothing(spark):
    rows = [(i, "good text " * 10) for i in range(1, 20)] + [(20, "long " * 1000)] + [(21, "hot text")] * 2000 + [(21, "other")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 22)], "doc_id long, quality int, toxic int")
    assert sorted(trusted_sample(table, labels, 100, 4000)) == [*range(1, 20), 21]
    with pytest.raises(ValueError):
        trusted_sample(table, labels.where("doc_id = 20"), 100, 4000)
    assert trusted_sample(table, labels.where("doc_id > 99"), 100, 4000) == []


def test_thresholds_cover_trusted_texts_outside_the_sample(spark):
    table = spark.createDataFrame([(i, "the old house by the sea is the best house of all") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    sample = trusted_sample(table, labels, 16, 10**6)
    rare = [i for i in range(80) if i not in sample][:9]
    table = table.withColumn("lang", F.when(F.col("doc_id").isin(rare), "xx").otherwise("en"))
    table = table.withColumn("text", F.when(F.col("lang") == "xx", F.concat(F.lit("sea qa qe qi of house "), F.repeat(F.lit("qu "), F.col("doc_id").cast("int")))).otherwise(F.col("text")))
    found = [r for r in classify_quality(table, labels, max_train_docs=16).collect() if r.lang == "xx"]
    want = np.quantile([r.log_perplexity for r in found], 0.99)  # of all nine, none of which is in the sample
    assert all(r.threshold == pytest.approx(want, abs=1e-3) and r.kept == (r.log_perplexity <= r.threshold) for r in found)
    assert len(found) == 9 and sum(r.kept for r in found) == 8


def test_own_columns_give_way_to_results(spark, docs):
    odd = {"n_words": 1, "log_perplexity": 2, "threshold": 3, "kept": 4, "target_loss": 5, "difference": 6, "quality": 7, "block": 8, "bin_id": 9}
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), *(F.lit(v).alias(k) for k, v in odd.items()))
    labels = spark.createDataFrame([(30, 1, 0), (36, 1, 0), (39, 1, 0), (60, 1, 0), (63, 1, 0)], "doc_id long, quality int, toxic int")
    for done, own in ((classify_quality(table, labels), ("quality", "block", "bin_id")), (score_documents(table, labels), ("kept", "threshold", "quality", "block", "bin_id"))):
        assert done.count() == docs.count() and len(set(done.columns)) == len(done.columns)
        assert {tuple(r) for r in done.select(*own).distinct().collect()} == {tuple(odd[c] for c in own)}
    assert packing.best_fit_packing(table).columns == [f.split()[0] for f in packing.PACKED.split(", ")]


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline

    read(spark, "benchmark").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = read(spark, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert html_text.extract_main_text(read(spark, "pages").limit(0)).count() == 0


def test_stages_take_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    read(spark, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    own = {"N_Words": 7, "kept": "mine", "spans": "mine", "items": 1.5, "pii_spans": 8, "contaminated": "no", "node": 3, "root": 4, "component_id": 5, "shingles": 6}
    rows = rows.withColumns({k: F.lit(v) for k, v in own.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns and after.count() <= docs.count(), name
        assert {tuple(r) for r in after.select(*own).distinct().collect()} == {tuple(own.values())}, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= docs.count()
