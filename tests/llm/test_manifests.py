"""Tokenizers and manifests against their libraries and plain versions."""

import random
from collections import Counter

import brute
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import alignment as A
from millrace.llm import pieces as P
from millrace.llm.merkle import manifest
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FIRST = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    bits = ["a", "b", "e", "n", "t", "h", " ", "  ", "\n", "\t", "▁", "日本", "語", "😀", "é", "0", "12", "\0", "<s>", "</s>", "<0x0A>", "ﬁ", "́", "ing", "tion", ".", "--", "==", "\x85", "\x1c", "Independ", "Histor", "iefs"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(1500)]
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(8000))
    return [*texts, "", " ", "▁", "  ", "a" * 1000, "ab" * 700, " " * 999, long, "日本語" * 3000, "x" * 256, "xy" * 128 + " z"]


def test_ids_are_those_of_the_library(odd, library):
    memory = P.Memory(MODEL)
    for texts in (odd[:700], odd[700:], odd[::3]):  # the second and third time units are known
        ids, counts = memory.encode(texts)
        ends = counts.cumsum()
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == library.encode(texts)


def test_units_are_forgotten(odd, library, monkeypatch):
    monkeypatch.setattr(P, "MOST_UNITS", 50)
    memory = P.Memory(MODEL)
    for at in range(0, 300, 20):
        ids, _ = memory.encode(odd[at : at + 20])
        assert ids.tolist() == [i for one in library.encode(odd[at : at + 20]) for i in one]


def test_decode_is_that_of_the_library(library):
    rng = random.Random(4)
    ids = [[rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(300) for _ in range(rng.randrange(12))] for _ in range(2000)]
    assert P.decode(ids, MODEL) == [library.decode(x) if x else "" for x in ids]


def test_pieces_of_a_table(spark, docs, library):
    table = docs.withColumn("IDS", F.lit("mine")).withColumn("decoded", F.lit(1)).withColumn("kind", F.lit("k"))
    found = P.encode_pieces(table, MODEL)
    assert found.columns == ["doc_id", "text", "kind", "ids", "decoded"]
    rows = found.collect()
    assert len(rows) == table.count()
    for r in rows:
        want = library.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want) and r.kind == "k"
    assert P.encode_pieces(docs.limit(0), MODEL).count() == 0


def test_pieces_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {tuple(r) for r in QUERIES["op12_sentencepiece"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    encoded = {i: library.encode(t or "", add_eos=True) for i, t in texts.items()}
    assert got == {(i, len(e), brute.sha(" ".join(map(str, e))), brute.sha(library.decode(e))) for i, e in encoded.items()}


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def damaged():
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, text).otherwise(F.col("text"))}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {None: 3, "": 2, "é": 1, "z": 300, "hot": 4200}, {f"s{i}": 1 for i in range(300)}])
def test_manifest(spark, sizes):
    rng, ids = random.Random(2), iter(random.Random(3).sample(range(10**6), sum(sizes.values())))
    rows = [
        (next(ids), s, rng.choice([None, "en", "日本"]), rng.choice([None, 5, -7]), rng.choice([None, "", "ABC d", "É x", "lower"]) if rng.random() < 0.5 else f"Text {rng.random()}")
        for s, n in sizes.items() for _ in range(n)
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    found = manifest(df, fields=FIELDS, tampered=damaged(), keep=["doc_id"])
    assert Counter(map(tuple, found.select(*MANIFEST).collect())) == Counter(brute.merkle(rows))


def test_manifest_with_repeats_nulls_and_own_columns(spark):
    rows = [(None, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumn("pos", F.lit(9)).withColumn("tree", F.lit("t"))
    found = manifest(df, keep=["doc_id", "source", "pos", "tree"]).collect()
    assert len(found) == 5 and all(r.verified and r.pos == 9 and r.tree == "t" for r in found)
    assert len({r.leaf for r in found}) == 4 and len({r.root for r in found}) == 1 and len({r.subroot for r in found}) == 2
    assert manifest(df).columns == ["doc_id", "source", "pos", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert manifest(df.limit(0)).count() == 0


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()]
    assert Counter(map(tuple, QUERIES["op13_merkle_manifest"](spark, SF).select(*MANIFEST).collect())) == Counter(brute.merkle(rows))


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [A.BLOCK_BYTES, 3000])
def test_alignment(spark, docs, nasty, odd, block, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    rows = [*nasty, *((1000 + i, t) for i, t in enumerate([*odd[:120], "<|endoftext|> x", "a  b \n c", "\u0085 a \u001c b", "▁ y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = A.align_tokenizers(df, FIRST, MODEL, keep=["doc_id"])
    assert Counter(map(tuple, found.select(*ALIGNED).collect())) == Counter(brute.alignment(rows, FIRST, MODEL))


def test_alignment_with_own_columns_and_no_rows(spark, docs):
    table = docs.withColumns({"N_A": F.lit("mine"), "block": F.lit(1), "k0": F.lit(2), "bucket": F.lit(3)})
    found = A.align_tokenizers(table, FIRST, MODEL)
    assert found.columns == ["doc_id", "text", "block", "k0", "bucket", *A.RESULTS]
    assert {(r.block, r.k0, r.bucket) for r in found.collect()} == {(1, 2, 3)}
    assert A.align_tokenizers(docs.limit(0), FIRST, MODEL).count() == 0


def test_groups_and_their_products(spark, docs, nasty):
    rows = A.aligned_tokens(docs, FIRST, MODEL).collect()
    want = {(r[0], r[7]) for r in brute.alignment(nasty, FIRST, MODEL)}
    text = lambda groups: ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in groups)
    assert {(r.doc_id, brute.sha(text(r.groups)) if r.groups else "") for r in rows} == want
    pairs = Counter((a, b) for r in rows for g in r.groups for a in set(g.a) for b in set(g.b))
    assert {(r.a, r.b): r.n_groups for r in A.group_products(A.aligned_tokens(docs, FIRST, MODEL)).collect()} == pairs


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_tokenizer_alignment"](spark, SF).select(*ALIGNED).collect())) == Counter(brute.alignment(rows, FIRST, MODEL))
