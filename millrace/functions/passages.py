"""Per-text work that no expression does: chunks and hashed embeddings."""

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from .text import STOP_WORDS

SIZE, OVERLAP, SMALLEST, DIMS = 900, 150, 80, 512
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")
_TOKEN = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_STOPS = frozenset(STOP_WORDS)


def lines_of(text: str) -> str:
    """Lines with single blanks; one empty line at most between two."""
    lines = (" ".join(line.split()) for line in (text or "").splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def chunks_of(text: str) -> list[str]:
    """Sentences and paragraphs packed to SIZE characters; each chunk starts with the last OVERLAP characters of the one before it.

    A chunk under SMALLEST characters (mostly a heading) takes what follows, whatever its length; what is
    longer than SIZE is cut there.
    """
    out: list[str] = []
    held = ""
    for piece in filter(str.strip, _SENTENCE.split(lines_of(text))):
        joined = f"{held} {piece}".strip()
        if len(held) >= SMALLEST and len(joined) > SIZE:
            out.append(held)
            joined = f"{held[-OVERLAP:]} {piece}".strip()
        at = 0
        while len(joined) - at > SIZE:
            out.append(joined[at : at + SIZE])
            at += SIZE - OVERLAP
        held = joined[at:]
    return out + [held] if held else out


@pandas_udf(T.ArrayType(T.StringType()))
def chunked(texts: pd.Series) -> pd.Series:
    return texts.map(chunks_of)


def _digest(gram: str) -> bytes:
    return hashlib.blake2b(gram.encode(), digest_size=8).digest()


#: Words come again and again, pairs hardly.
_word_digest = lru_cache(1 << 17)(_digest)


def words_of(text: str | None) -> list[str]:
    """As functions.text.tokens, of one text."""
    return [w for w in _TOKEN.findall((text or "").lower()) if len(w) > 1 and w not in _STOPS]


def all_words_of(text: str | None) -> list[str]:
    """Runs of letters and numbers (Unicode's L and N) in lower case."""
    return _WORD.findall((text or "").lower())


def token_counts_of(text: str | None) -> dict[str, int]:
    """How often a text has each of its words_of, in their order."""
    found = Counter(_TOKEN.findall((text or "").lower()))
    return {w: n for w, n in found.items() if len(w) > 1 and w not in _STOPS}


def embedding_of(words: list[str]) -> np.ndarray:
    """Words and half-weighted pairs hashed into DIMS signed cells, of length one."""
    if not words:
        return np.zeros(DIMS)
    digests = [*map(_word_digest, words), *map(_digest, map("_".join, zip(words, words[1:])))]
    bits = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    weights = np.where(bits[:, 5] % 2, 1.0, -1.0)
    weights[len(words) :] *= 0.5
    out = np.bincount(np.ascontiguousarray(bits[:, :4]).view(">u4").ravel() % DIMS, weights, minlength=DIMS)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def embedding(text: str | None) -> list[float]:
    return embedding_of(words_of(text)).tolist()


@arrow_udf(T.ArrayType(T.DoubleType()))
def embedded(texts: pa.Array) -> pa.Array:
    values = np.zeros((len(texts), DIMS))
    for i, text in enumerate(texts):
        values[i] = embedding_of(words_of(text.as_py()))
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * DIMS, values.ravel())
