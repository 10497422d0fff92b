"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cross_entropy import _batch, _by_key, _dealt, _encode, _opened, _packed, _several, _steps, _unpacked, _unseveral, _unsteps, _with_target
from .frames import cut, fresh, n_buckets, schema_of, scratch, without
from .hashing import Chunk, Words, chunks, mix, words
from .ngrams import Lookup, trusted_sample

#: Trusted texts are dealt by their ids into so many folds; thresholds come from losses under the counts of all others.
HELD_OUT = 4
#: Words of all texts for each bucket of trigrams; a word that occurs more often has buckets of its own, by the word before it.
BUCKET_WORDS = 1_000_000
#: Sums of losses are whole numbers of so small parts, so that they are the same in any order.
PARTS = float(1 << 24)
#: Numbers of words: those of no word and of the start, and the first of a known one.
NO_WORD, NO_TEXT, FIRST = np.uint64(0), np.uint64(1), np.uint64(2)
#: What goes to a bucket of words or trigrams, or to a block of texts; of kind 0 is what comes first there.
_SENT = "bucket int, kind int, block long, a binary, b binary, c binary, d binary, e binary"
#: Bits of a text's length that hold its fold: none, one of HELD_OUT, or the one after these, which counts for thresholds only.
_FOLD_BITS = 3
#: Thresholds are quantiles of losses rounded to so many decimals, so that counts of a bounded number of values give them.
DECIMALS = 4
#: Of each language's held-out trusted texts, the share of perplexities that a threshold covers.
QUANTILE = 0.99
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
START, UNKNOWN = np.uint64(1), np.uint64(2)
_ready: dict[str, object] = {}


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of its first words and that of its last."""
    return mix(left * _SPREAD + right)


def _history(w: Words, known: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its key, and those of the two before it; a text starts after two start marks."""
    last = w.hashes()
    last = np.where(known.find(last) >= 0, last, UNKNOWN)
    place = np.arange(len(last)) - w.first[w.doc]
    one, two = np.full(len(last), START), np.full(len(last), START)
    one[1:], two[2:] = last[:-1], last[:-2]
    one[place < 1], two[place < 2] = START, START
    return two, one, last


def _trigrams(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready.clear()
            _ready[name] = Lookup(held.value, np.zeros(len(held.value), np.bool_))
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                rows = np.stack(_history(words(chunk), _ready[name]), axis=1)
                rows, n = np.unique(rows, axis=0, return_counts=True)
                columns = [pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=["u", "v", "w", "n"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            keys, n = np.unique(words(chunk).hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["w", "n"])


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams occur one to four times; 0.75 of what is too rare to tell."""
    if 0 in n[:2]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    made = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k for k in (1, 2, 3)]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(made, 1)]


def _order(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of one order: each n-gram's discounted share of its context, and each context's weight for the order below."""
    row = counts.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    d = discounts([row[f"n{k}"] for k in range(1, 5)])
    taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    groups = counts.groupBy(*context) if context else counts
    sums = groups.agg(F.sum("n").alias("total"), F.sum(taken).alias("held"))
    if len(context) < 2:  # at most a row for each word of the bounded sample; a frequent word then gathers nowhere
        both = counts.join(F.broadcast(sums), context) if context else counts.crossJoin(F.broadcast(sums))
    else:
        both = counts.join(sums, context)
    return both.withColumn("share", (F.col("n") - taken) / F.col("total")), sums.withColumn("weight", F.col("held") / F.col("total"))


class KneserNey:
    """The fitted model in arrays: shares of n-grams, weights of contexts."""

    def __init__(self, known: np.ndarray, shares: list[tuple[np.ndarray, np.ndarray]], weights: list[tuple[np.ndarray, np.ndarray]], floor: float, rare: int):
        self.known = Lookup(known, np.zeros(len(known), np.bool_))
        self.shares = [Lookup(k, v) for k, v in shares]
        self.weights = [Lookup(k, v) for k, v in weights]
        self.floor, self.rare = floor, np.log(max(1, rare))

    @staticmethod
    def _value(table: Lookup, keys: np.ndarray, missing: float) -> np.ndarray:
        row = table.find(keys)
        return np.where(row >= 0, table.values[row], missing) if len(table.values) else np.full(len(keys), missing)

    def log_probabilities(self, w: Words) -> np.ndarray:
        two, one, last = _history(w, self.known)
        pair = _joined(one, last)
        p = self._value(self.shares[0], last, 0.0) + self.floor
        p = self._value(self.shares[1], pair, 0.0) + self._value(self.weights[0], one, 1.0) * p
        context = _joined(two, one)
        p = self._value(self.shares[2], _joined(two, pair), 0.0) + self._value(self.weights[1], context, 1.0) * p
        return np.log(p) - np.where(last == UNKNOWN, self.rare, 0.0)

    def scores(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and minus the mean log probability of one."""
        w = words(chunk)
        sums = np.bincount(w.doc, -self.log_probabilities(w), minlength=chunk.n)
        return w.counts, np.divide(sums, w.counts, out=np.zeros(chunk.n), where=w.counts > 0)


def fit(texts: DataFrame, text: str = "text") -> KneserNey:
    """A model in arrays of texts that are few enough for it (classify_quality keeps its own in buckets).

    The n-grams are counted in Spark, sharded by n-gram, and joined with their contexts.

    Trigrams have their own counts; pairs and words have continuation counts, the number
    of different words before them.  Words that occur once are the unknown word, whose
    probability is shared out evenly among as many words as they were.
    """
    spark = texts.sparkSession
    source = cut(texts.select(text))
    counted = cut(source.mapInArrow(_word_counts, schema_of("w long, n long")).groupBy("w").agg(F.sum("n").alias("n")))
    rare, known = counted.where("n = 1").count(), counted.where("n > 1")
    known = known.select("w").orderBy("w").toArrow()["w"].to_numpy().view(np.uint64)
    held, name = spark.sparkContext.broadcast(known), uuid.uuid4().hex
    found = source.mapInArrow(_trigrams(held, name), schema_of("u long, v long, w long, n long"))
    three = cut(found.groupBy("u", "v", "w").agg(F.sum("n").alias("n")).repartition(n_buckets(texts), "u", "v"))
    two = cut(three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")))
    one = cut(two.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    grams, contexts = zip(_order(one, []), _order(two, ["v"]), _order(three, ["u", "v"]), strict=True)
    u64 = lambda frame, c: frame[c].to_numpy().view(np.uint64)
    value = lambda frame, c: frame[c].to_numpy()
    g = [x.select(*c, "share").toArrow() for x, c in zip(grams, (["w"], ["v", "w"], ["u", "v", "w"]), strict=True)]
    c2, c3 = (x.select(*c, "weight").toArrow() for x, c in zip(contexts[1:], (["v"], ["u", "v"]), strict=True))
    base = contexts[0].select("weight").first()
    share = [
        (u64(g[0], "w"), value(g[0], "share")),
        (_joined(u64(g[1], "v"), u64(g[1], "w")), value(g[1], "share")),
        (_joined(u64(g[2], "u"), _joined(u64(g[2], "v"), u64(g[2], "w"))), value(g[2], "share")),
    ]
    weight = [(u64(c2, "v"), value(c2, "weight")), (_joined(u64(c3, "u"), u64(c3, "v")), value(c3, "weight"))]
    floor = (base["weight"] if base and base["weight"] is not None else 1.0) / (len(known) + 1)
    return KneserNey(known, share, weight, floor, rare)


def _threshold(held: DataFrame, lang: str, quantile: float) -> Column:
    """The quantile of the held-out texts of a row's language, or of all where it has none."""
    level = F.percentile("loss", F.lit(quantile), F.col("n"))
    overall = F.lit(held.agg(level.alias("t")).first()["t"]).cast("double")
    rows = held.where("lang is not null").groupBy("lang").agg(level.alias("t")).collect()  # one for each language
    if not rows:
        return overall
    limits = F.create_map(*(F.lit(x) for r in rows for x in (r["lang"], r["t"])))
    return F.coalesce(F.when(F.col(lang).isNotNull(), F.try_element_at(limits, F.col(lang))), overall)


@dataclass(frozen=True)
class _Deal:
    """Which bucket a trigram goes to: by its middle word, or also by its first where the middle word is frequent."""

    buckets: int
    frequent: np.ndarray
    spread: np.ndarray

    def numbers(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        made = (one % np.uint64(self.buckets)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, one), len(self.frequent) - 1)
            own = np.flatnonzero(self.frequent[at] == one)
            at = at[own]
            made[own] = self.buckets + (np.cumsum(self.spread) - self.spread)[at] + (mix(two[own]) % self.spread[at].astype(np.uint64)).astype(np.int64)
        return made

    def word(self, bucket: int) -> int | None:
        """The place of the frequent word that has a bucket."""
        return int(np.searchsorted(np.cumsum(self.spread), bucket - self.buckets, side="right")) if bucket >= self.buckets else None

    def trigrams(self, row: tuple) -> tuple[np.ndarray, ...]:
        """Of what a block sent: the words before, the words, and each one's text and fold."""
        n, fold = _unseveral(row[7], 2)
        one, word = _unpacked(row[4]), self.word(row[0])
        one = one * np.uint64(self.buckets) + np.uint64(row[0]) if word is None else np.full(len(one), self.frequent[word])
        return _unpacked(row[3]), one, _unpacked(row[5]), np.repeat(_unsteps(row[6]), n), np.repeat(fold, n)


def _ask_words(parts: int):
    """A block's words with their counts in all texts and in trusted ones, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, a, b, c = (batch.column(k)[i].as_py() for k in range(4))
                keys, numbers, lens, fold = _opened(a, b, c, _FOLD_BITS)
                n, t = (np.bincount(numbers, x, minlength=len(keys)) for x in (None, np.repeat((fold > 0) & (fold <= HELD_OUT), lens)))
                yield _batch(_SENT, [(k, 0, block, _steps(keys[own]), _several(n[own], t[own])) for k, own in enumerate(_dealt(keys, parts)) if len(own)])

    return run


def _number_words(parts: int, most: int):
    """Answers to blocks: numbers of their words, frequent ones low, none for words that trusted texts have once or not.

    And how many are known, how many rare and how often others occur; and which occur more than most times, and how often.
    """

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = [_unsteps(r[3]) for r in rows]
        keys, place = np.unique(np.concatenate(pieces), return_inverse=True)
        n, t = (np.bincount(place, x, minlength=len(keys)).astype(np.int64) for x in np.concatenate([_unseveral(r[4], 2) for r in rows], axis=1))
        known = np.flatnonzero(t > 1)
        known = known[np.argsort(-t[known], kind="stable")]
        ids = np.full(len(keys), NO_WORD)
        ids[known] = FIRST + np.arange(len(known), dtype=np.uint64) * np.uint64(parts) + np.uint64(rows[0][0])
        often = known[n[known] > most]
        told, at = [(rows[0][0], 4, None, _packed(np.array([len(known), np.count_nonzero(t == 1), n[t < 2].sum()])), _packed(ids[often]), _packed(n[often]))], 0
        for r, piece in zip(rows, pieces, strict=True):
            told.append((r[0], 1, r[2], _packed(ids[place[at : at + len(piece)]])))
            at += len(piece)
        yield _batch(_SENT, told)

    return lambda batches: _by_key(batches, 0, settle)


def _deal_trigrams(parts: int, deal: _Deal):
    """Every word of a block with the two before it, by bucket, in the order of the texts."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, a, b, c = rows[0][2:6]
        keys, numbers, lens, fold = _opened(a, b, c, _FOLD_BITS)
        ids, answers = np.full(len(keys), NO_WORD), {r[0]: r[3] for r in rows[1:]}
        for k, own in enumerate(_dealt(keys, parts)):
            if len(own):
                ids[own] = _unpacked(answers[k])
        last, doc = ids[numbers], np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(last)) - np.repeat(np.cumsum(lens) - lens, lens)
        one, two = np.full(len(last), NO_TEXT), np.full(len(last), NO_TEXT)
        one[1:], two[2:] = last[:-1], last[:-2]
        one[place < 1], two[place < 2] = NO_TEXT, NO_TEXT
        bucket = deal.numbers(two, one)
        order, sent = np.argsort(bucket, kind="stable"), []
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            k, (docs, n) = int(bucket[own[0]]), np.unique(doc[own], return_counts=True)
            middle = one[own] // np.uint64(deal.buckets) if k < deal.buckets else np.zeros(len(own), np.uint64)
            sent.append((k, 0, block, _packed(two[own]), _packed(middle), _packed(last[own]), _steps(docs.astype(np.uint64)), _several(n, fold[docs])))
        yield _batch(_SENT, sent)

    return lambda batches: _by_key(batches, 2, settle)


class _Order:
    """N-grams of one order: their counts in all trusted texts and in those outside each fold, and sums for each context."""

    def __init__(self, grams: np.ndarray, contexts: np.ndarray, n: np.ndarray, sums: np.ndarray | None = None):
        self.grams, self.n = grams, n.astype(np.int64)
        self.contexts, at = np.unique(contexts, return_inverse=True)
        self.sums = sums if sums is not None else np.array([[np.bincount(at, own, minlength=len(self.contexts)) for own in (x, x == 1, x == 2, x > 2)] for x in n], np.int64)

    def probabilities(self, d: np.ndarray, model: np.ndarray, gram: np.ndarray, context: np.ndarray, low: np.ndarray) -> np.ndarray:
        """From those of the order below and the discounts of each model."""
        if not len(self.grams):
            return low
        at, of = np.searchsorted(self.grams, gram), np.searchsorted(self.contexts, context)
        at[at == len(self.grams)], of[of == len(self.contexts)] = 0, 0
        n = np.where(self.grams[at] == gram, self.n[model, at], 0)
        total, *kinds = (np.where(self.contexts[of] == context, self.sums[model, k, of], 0) for k in range(4))
        held = sum(d[model, k] * x for k, x in enumerate(kinds, 1))
        whole = np.maximum(total, 1)
        return (n - d[model, np.minimum(n, 3)]) / whole + np.where(total > 0, held / whole, 1.0) * low


def _sums(n: np.ndarray) -> np.ndarray:
    """Of each model, the sum, and how many n-grams occur once, twice and more often."""
    return np.array([[x.sum(), *(np.count_nonzero(own) for own in (x == 1, x == 2, x > 2))] for x in n], np.int64)


def _frequencies(n: np.ndarray) -> np.ndarray:
    """Of each model, how many n-grams occur one to four times."""
    return np.array([[np.count_nonzero(x == k) for k in range(1, 5)] for x in n])


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys of different trigrams, rising, their words and their counts in each fold."""
    two, one, last, n = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
    keys, at, place = np.unique(_joined(two, _joined(one, last)), return_index=True, return_inverse=True)
    counts = np.array([np.bincount(place, x, minlength=len(keys)) for x in n], np.int64)
    return keys, two[at], one[at], last[at], counts


def _counted(rows: list[tuple], deal: _Deal, most: int) -> tuple[_Order, _Order, np.ndarray]:
    """A bucket's trigrams of trusted texts and its pairs of words, with the last word of each pair."""
    none = np.zeros(0, np.uint64)
    held, size = [(none, none, none, np.zeros((HELD_OUT, 0), np.int64))], 0
    for row in rows:
        two, one, last, _, fold = deal.trigrams(row)
        own = (fold > 0) & (fold <= HELD_OUT)
        held.append((two[own], one[own], last[own], fold[own] == np.arange(1, HELD_OUT + 1)[:, None]))
        size += len(held[-1][0])
        if size > most:
            held, size = [_merged(held)[1:]], 0
    keys, two, one, last, n = _merged(held)
    n = np.concatenate([n.sum(axis=0)[None], n.sum(axis=0) - n])
    pairs, at, place = np.unique(_joined(one, last), return_index=True, return_inverse=True)
    before = np.array([np.bincount(place, x > 0, minlength=len(pairs)) for x in n])
    return _Order(keys, _joined(two, one), n), _Order(pairs, one[at], before), last[at]


def _ask_last(parts: int, deal: _Deal, most: int):
    """A bucket's last words, packed by bucket of words, and its frequencies of frequencies.

    With how many words it has before each; where a frequent word has more buckets, with how many it has before the pair of both.
    """

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        three, two, last = _counted(rows, deal, most)
        shared = deal.word(rows[0][0]) is not None
        seen = np.unique(np.concatenate([np.unique(_unpacked(r[5])) for r in rows]))
        n = np.array([np.bincount(np.searchsorted(seen, last), x if shared else x > 0, minlength=len(seen)) for x in two.n])
        shard = np.where(seen < FIRST, 0, (seen - FIRST) % np.uint64(parts))
        sent = [(rows[0][0], 4, None, _packed(np.concatenate([_frequencies(three.n), _frequencies(two.n[:, :0] if shared else two.n)]).ravel()))]
        for k in np.unique(shard):
            own = shard == k
            sent.append((int(k), 0, rows[0][0], _steps(seen[own]), _several(*n[:, own])))
        yield _batch(_SENT, sent)

    return lambda batches: _by_key(batches, 0, settle)


def _added_up(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of what buckets sent, each word's place among them, and its sums."""
    ids, place = np.unique(np.concatenate([_unsteps(r[3]) for r in rows]), return_inverse=True)
    n = np.concatenate([_unseveral(r[4], HELD_OUT + 1) for r in rows], axis=1)
    return ids, place, np.array([np.bincount(place, x, minlength=len(ids)) for x in n], np.int64)


def _settle_last(deal: _Deal):
    """Answers to buckets: how many words all texts have before each of their last words, and before the pairs of a frequent word.

    And frequencies of both and sums; and sums of the pairs of each frequent word.
    """

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_word: dict[int | None, list[tuple]] = {}
        for r in rows:
            by_word.setdefault(deal.word(r[2]), []).append(r)
        found = {word: _added_up(own) for word, own in by_word.items()}
        ids = np.unique(np.concatenate([x[0] for x in found.values()]))
        n, often, told = np.zeros((HELD_OUT + 1, len(ids)), np.int64), np.zeros((HELD_OUT + 1, 4), np.int64), []
        for word, (own, _, pairs) in found.items():
            n[:, np.searchsorted(ids, own)] += pairs if word is None else pairs > 0
            if word is not None:
                often += _frequencies(pairs)
                told.append((word, 5, None, _packed(_sums(pairs).ravel())))
        told.append((rows[0][0], 4, None, _packed(np.concatenate([_frequencies(n), _sums(n), often]).ravel())))
        for word, (own, place, pairs) in found.items():
            at = 0
            for r in by_word[word]:
                mine = place[at : at + len(_unsteps(r[3]))]
                at += len(mine)
                told.append((r[2], 1, None, r[3], _several(*n[:, np.searchsorted(ids, own[mine])]), None if word is None else _several(*pairs[:, mine])))
        yield _batch(_SENT, told)

    return lambda batches: _by_key(batches, 0, settle)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums for each bucket."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield _batch(_SENT, [(rows[0][0], rows[0][1], None, _packed(sum(_unpacked(r[3]) for r in rows)))])

    return _by_key(batches, 0, settle)


def _score_trigrams(deal: _Deal, most: int, d: np.ndarray, sums: np.ndarray, follow: np.ndarray, size: int, rare: int):
    """Losses of the words of a bucket, added up by text, under all trusted texts and under those outside its fold."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked, answers = ([r for r in rows if r[1] == k] for k in (0, 1))
        three, two, _ = _counted(asked, deal, most)
        ids, n = np.concatenate([_unsteps(r[3]) for r in answers]), np.concatenate([_unseveral(r[4], HELD_OUT + 1) for r in answers], axis=1)
        order, word = np.argsort(ids), deal.word(rows[0][0])
        if word is not None:
            one = np.full(len(ids), deal.frequent[word])
            pairs, before = _joined(one, ids), np.concatenate([_unseveral(r[5], HELD_OUT + 1) for r in answers], axis=1)
            at = np.argsort(pairs)
            two = _Order(pairs[at], one, before[:, at], follow[word][:, :, None])
        ids, n = ids[order], n[:, order]
        total = np.maximum(sums[:, 0], 1)
        floor = np.where(sums[:, 0] > 0, (d[0, :, 1:] * sums[:, 1:]).sum(axis=1) / total, 1.0) / (size + 1)
        single = (n - np.take_along_axis(d[0], np.minimum(n, 3), axis=1)) / total[:, None] + floor[:, None]
        for r in asked:
            *grams, doc, fold = deal.trigrams(r)
            own = np.flatnonzero(fold)
            model = np.concatenate([np.zeros(len(doc), np.int64), fold[own] % (HELD_OUT + 1)])
            u, v, w = (np.concatenate([x, x[own]]) for x in grams)
            pair = _joined(v, w)
            p = single[model, np.searchsorted(ids, w)]
            p = two.probabilities(d[1], model, pair, v, p)
            p = three.probabilities(d[2], model, _joined(u, pair), _joined(u, v), p)
            loss = np.where(w == NO_WORD, np.log(max(1, rare)), 0.0) - np.log(p)
            docs, place = np.unique(doc, return_inverse=True)
            both = (np.bincount(i, x, minlength=len(docs)) for i, x in ((place, loss[: len(doc)]), (place[own], loss[len(doc) :])))
            yield _batch(_SENT, [(r[0], 2, r[2], _steps(docs), _several(*(np.rint(np.maximum(x, 0) * PARTS) for x in both)))])

    return lambda batches: _by_key(batches, 0, settle)


def _perplexities(schema):
    """Mean losses of a block's texts from the sums of all buckets."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, lens = to_arrow_schema(schema), _unpacked(rows[0][5]).astype(np.int64)
        lens, fold = lens >> _FOLD_BITS, lens & ((1 << _FOLD_BITS) - 1)
        sums = np.zeros((2, len(lens)), np.int64)
        for r in rows[1:]:
            sums[:, _unsteps(r[3]).astype(np.int64)] += _unseveral(r[4], 2)
        means = sums / PARTS / np.maximum(lens, 1)
        with pa.ipc.open_stream(rows[0][6]) as stream:
            kept = stream.read_next_batch()
        columns = [*kept.columns, pa.array(lens), pa.array(means[0], mask=lens == 0), pa.array(means[1], mask=(lens == 0) | (fold == 0))]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return lambda batches: _by_key(batches, 2, settle)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    keep: list[str] | None = None,
    max_train_docs: int | None = None,
    max_train_chars: int | None = None,
    quantile: float = QUANTILE,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Columns keep of docs (default: all), n_words, log_perplexity, threshold and kept.

    The model is fitted on all trusted labelled texts (quality 1, not toxic).  The threshold
    of a language is the quantile of the log perplexities of all its trusted texts, each under
    the counts of those whose ids are in other folds (HELD_OUT folds, one vocabulary); different texts of an id count once
    each.  A text is kept if it has words and does not exceed its threshold.  A caller may bound the texts
    that are counted (max_train_docs, max_train_chars; no bounds by default); trusted texts outside count for thresholds.

    The counts stay in buckets by the middle word of a trigram, where all texts send their
    words with the two before each; these buckets count, ask buckets of words how many words
    each last word follows, and send back sums of losses for each text.  A word that occurs more
    than bucket_words times has more buckets, by the word before it, and the buckets of words add up its pairs.

    Defined cases: null, empty and wordless texts have null log_perplexity and are not
    kept; a language (or null) without trusted text takes the threshold of all; with no
    trusted text at all every text with words is kept; ids may be null or repeat; no rows give
    no rows; own columns with the names of results give way to these.
    """
    spark, parts = docs.sparkSession, n_buckets(docs)
    rest = without(docs, ["n_words", "log_perplexity", "threshold", "kept"])
    names = [c for c in rest.columns if keep is None or c in keep]
    key, flag, fold, own, tongue = (fresh(docs, c) for c in ("_id", "_trusted", "_fold", "_own", "_lang"))
    rows = docs.select(*dict.fromkeys([*names, text]), F.col(lang).alias(tongue), F.col(doc_id).cast("long").alias(key))
    rows = rows.withColumn(fold, F.pmod(F.xxhash64(key), F.lit(HELD_OUT)).cast("int") + 1)
    if max_train_docs is not None or max_train_chars is not None:
        most = (2**31 - 1 if max_train_docs is None else max_train_docs, 2**62 if max_train_chars is None else max_train_chars)
        picked = [(x,) for x in trusted_sample(docs, labels, *most, doc_id, text)]
        picked = F.broadcast(spark.createDataFrame(picked, f"{key} long").withColumn(flag, F.lit(True)))
        rows = rows.join(picked, key, "left").withColumn(fold, F.when(F.col(flag), F.col(fold)).otherwise(HELD_OUT + 1)).drop(flag)
    marked = _with_target(rows, labels, key, text, flag).withColumn(fold, F.when(F.col(flag), F.col(fold)).otherwise(0))

    sent, kept = schema_of(_SENT), [*names, tongue]
    path = {k: scratch(spark, f"quality-{k}") for k in ("blocks", "words", "trigrams", "last", "told", "scored")}
    stored = lambda frame, k: (frame.write.parquet(path[k]), spark.read.parquet(path[k]))[1]
    dealt = lambda frame, column: frame.repartition(parts, column).sortWithinPartitions(column, "kind")
    blocks = schema_of("block long, kind int, bucket int, a binary, b binary, c binary, d binary, size long, n long, t long")
    blocks = stored(marked.mapInArrow(_encode(text, kept, fold, _FOLD_BITS), blocks), "blocks")
    asked = blocks.select("block", "a", "b", "c").mapInArrow(_ask_words(parts), sent)
    told = stored(dealt(asked, "bucket").mapInArrow(_number_words(parts, bucket_words), sent), "words")
    sizes = told.where("kind = 4").select("a", "b", "c").collect()  # one for each bucket of words
    size, rare, others = sum((_unpacked(r["a"]).astype(np.int64) for r in sizes), np.zeros(3, np.int64)).tolist()
    often = {int(w): int(n) for r in sizes for w, n in zip(_unpacked(r["b"]), _unpacked(r["c"]), strict=True)}
    often = dict(sorted((often | ({int(NO_WORD): others} if others > bucket_words else {})).items()))
    buckets = max(parts, (blocks.agg(F.sum("size")).first()[0] or 0) // bucket_words)
    deal = _Deal(buckets, np.array(list(often), np.uint64), np.array([1 + n // bucket_words for n in often.values()], np.int64))

    nothing, models = F.lit(None).cast("binary"), HELD_OUT + 1
    whole = blocks.select("bucket", "kind", "block", "a", "b", "c", nothing.alias("d"), nothing.alias("e")).union(told.where("kind = 1"))
    trigrams = stored(dealt(whole, "block").mapInArrow(_deal_trigrams(parts, deal), sent), "trigrams")
    last = stored(dealt(trigrams, "bucket").mapInArrow(_ask_last(parts, deal, bucket_words), sent), "last")
    told = stored(dealt(last.where("kind = 0"), "bucket").mapInArrow(_settle_last(deal), sent), "told")
    total = lambda frame, n: sum((_unpacked(r["a"]).astype(np.int64).reshape(n, models, 4) for r in frame.where("kind = 4").select("a").collect()), np.zeros((n, models, 4), np.int64))
    (often3, often2), (often1, sums, shared) = total(last, 2), total(told, 3)
    d = np.array([[[0.0, *discounts(n.tolist())] for n in of] for of in (often1, often2 + shared, often3)])
    follow = np.zeros((len(often), models, 4), np.int64)
    for r in dealt(told.where("kind = 5"), "bucket").mapInArrow(_add, sent).select("bucket", "a").collect():  # one for each frequent word
        follow[r["bucket"]] = _unpacked(r["a"]).astype(np.int64).reshape(models, 4)
    asked = trigrams.union(told.where("kind = 1"))
    whole = dealt(asked, "bucket").mapInArrow(_score_trigrams(deal, bucket_words, d, sums, follow, size, rare), sent)

    schema = type(sent)([*(rest.schema[c] for c in names), *schema_of(f"{tongue} string, n_words long, log_perplexity double, {own} double")])
    whole = blocks.select("bucket", "kind", "block", nothing.alias("a"), nothing.alias("b"), "c", "d", nothing.alias("e")).union(whole)
    scored = stored(dealt(whole, "block").mapInArrow(_perplexities(schema), schema), "scored")
    tuning = scored.where(F.col(own).isNotNull()).groupBy(F.col(tongue).alias("lang"), F.round(own, DECIMALS).alias("loss"))
    threshold = _threshold(cut(tuning.agg(F.count(F.lit(1)).alias("n"))), tongue, quantile)
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.col("threshold").isNull())
    return scored.withColumn("threshold", threshold).withColumn("kept", kept).select(*names, "n_words", "log_perplexity", "threshold", "kept")
