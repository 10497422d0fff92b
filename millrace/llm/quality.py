"""Quality rules by repetition coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import with_text_columns
from .hashing import Chunk, Words, chunks, covered, mix, repeats, windows, words

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict.

    A text fails the base rules with fewer than min_words words or more than
    max_repeat_percent of its words inside repeated 3-word windows.  It fails the
    method's if, for any n-gram length, repeats (all but the first occurrence)
    cover more than that share of its characters, or repeated lines more than
    max_line_share.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_coverage: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.26, 10: 0.22})
    max_line_share: float = 0.30


DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, ngram_shares map<int,double>"
)


def _line_repeats(chunk: Chunk, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word that equal an earlier line, and code points of words on them."""
    buf, offsets = chunk.buf, chunk.offsets
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        return np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
    ends = np.append(starts[1:], len(buf))
    ends -= buf[ends - 1] == 10  # a line ends before its break, or where its text ends
    line_of_word = np.searchsorted(starts, w.starts, side="right") - 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    has_word = np.zeros(len(starts), bool)
    has_word[line_of_word] = True
    at = np.flatnonzero(has_word)
    _, before = repeats(mix(w.stretch_hashes(starts[at], ends[at]) + doc[at].astype(np.uint64)))
    repeated = np.zeros(len(starts), bool)
    repeated[at[before]] = True
    n = np.bincount(doc[at[before]], minlength=chunk.n)
    chars = np.bincount(w.doc, weights=np.where(repeated[line_of_word], _chars(chunk, w), 0), minlength=chunk.n)
    return n, chars


def _chars(chunk: Chunk, w: Words) -> np.ndarray:
    """Code points of each word."""
    points = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
    return points[w.ends] - points[w.starts]


def measure(chunk: Chunk, rules: QualityRules) -> dict[str, np.ndarray]:
    w = words(chunk)
    total, n_words = len(w.starts), w.counts
    chars = _chars(chunk, w)
    word_chars = np.bincount(w.doc, weights=chars, minlength=chunk.n).astype(np.int64)
    hashes = w.hashes()

    def occurrences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, keys = windows(hashes, w.doc, n)
        return starts, *repeats(mix(keys + w.doc[starts].astype(np.uint64)))

    starts, again, _ = occurrences(3)
    n_repeat = np.bincount(w.doc[covered(starts[again], 3, total)], minlength=chunk.n)
    lines, line_chars = _line_repeats(chunk, w)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    known = np.maximum(word_chars, 1)
    shares, bad = {}, line_chars / known > rules.max_line_share
    for n, most in rules.max_coverage.items():
        starts, _, before = occurrences(n)
        inside = np.where(covered(starts[before], n, total), chars, 0)
        shares[n] = np.bincount(w.doc, weights=inside, minlength=chunk.n) / known
        bad |= shares[n] > most
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": chunk.per_text(SYMBOLS[chunk.buf]),
        "n_dup_lines": lines, "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~(base_failed | bad),
        "dup_line_share": line_chars / known, **{f"share{n}": x for n, x in shares.items()},
    }


def quality_rules(
    docs: DataFrame, text: str = "text", rules: QualityRules | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Columns keep of docs (default: all), the counts of each whole text and the verdict on it.

    Rolling hashes of every n-gram length in rules find repeated n-grams and lines;
    the shares are of the characters (code points) in words.  One pass, no shuffle.

    Defined cases: null and empty texts have no words, so they fail the base rules;
    texts of any length are measured whole; rows are judged alone, so repeated rows
    and null ids change nothing; no rows give no rows; own columns with the names of
    results give way to these.
    """
    rules = rules or QualityRules()
    lengths = list(rules.max_coverage)

    def run(column: pa.Array) -> dict[str, object]:
        parts = [measure(c, rules) for c in chunks(column)]
        out = {k: np.concatenate([p[k] for p in parts]) if parts else [] for k in parts[0]} if parts else {}
        if not out:
            return {f.split()[0]: [] for f in DDL.replace("map<int,double>", "map").split(", ")}
        table = np.stack([out[f"share{n}"] for n in lengths], axis=1) if lengths else np.zeros((len(column), 0))
        out["ngram_shares"] = pa.MapArray.from_arrays(
            pa.array(np.arange(len(column) + 1) * len(lengths), pa.int32()),
            pa.array(np.tile(lengths, len(column)), pa.int32()),
            pa.array(table.ravel()),
        )
        return out

    return with_text_columns(docs, text, DDL, run, keep)
