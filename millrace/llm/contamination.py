"""Benchmark decontamination with an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, schema_of, without

#: ASCII other than digits and letters separates words; all other bytes belong to words, A-Z in lower case.
_NORMAL = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {b: b + 32 for b in range(0x41, 0x5B)}
#: Characters of windows in one automaton; a larger benchmark is scanned for in several.
MAX_PATTERN_CHARS = 2_000_000
_built: dict[str, ahocorasick.Automaton] = {}

SPANS = "array<struct<start:long,end:long>>"


def normal_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_NORMAL).split()


def item_windows(raw: bytes | None, n_words: int) -> list[bytes]:
    """An item's windows, each with a space at either end."""
    w = normal_words(raw)
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + n_words]) + b" " for i in range(max(1, len(w) - n_words + 1))]


def _automaton(patterns: list[tuple[bytes, list[str]]], key: str) -> ahocorasick.Automaton:
    """Of one shard; a Python worker builds it once."""
    if key not in _built:
        made = ahocorasick.Automaton()
        for window, items in patterns:
            made.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, items))
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def _shards(benchmark: DataFrame, item_id: str, text: str, n_words: int, limit: int) -> Iterator[list]:
    """The windows with their items, in shards of bounded size, one at a time on the driver."""
    windows: dict[bytes, set[str]] = {}
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).where(F.col(text).isNotNull())
    for item, raw in rows.toLocalIterator():
        for window in item_windows(bytes(raw), n_words):
            if window not in windows:
                size += len(window)
            windows.setdefault(window, set()).add("" if item is None else item)
        if size >= limit:
            yield [(w, sorted(i)) for w, i in windows.items()]
            windows, size = {}, 0
    if windows:
        yield [(w, sorted(i)) for w, i in windows.items()]


def _scan(held, key: str, text: str, first: bool, own: tuple[str, str]):
    """Adds what one automaton finds: hit word stretches and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(held.value, key)
        for batch in batches:
            hits, items = [], []
            for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()):
                line = b" " + b" ".join(normal_words(raw.as_py())) + b" "
                spans, found = [], set()
                gaps = None
                for end, (length, n, ids) in machine.iter(line.decode("latin-1")):
                    if gaps is None:
                        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    at = int(np.searchsorted(gaps, end - length + 1))
                    spans.append({"start": at, "end": at + n})
                    found.update(ids)
                hits.append(spans)
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = {own[0]: pa.array(hits, kind), own[1]: pa.array(items, pa.list_(pa.string()))}
            if not first:
                for name in made:
                    old = batch.column(batch.schema.get_field_index(name))
                    made[name] = pa.array(
                        [[*(a.as_py() or []), *(b.as_py() or [])] for a, b in zip(old, made[name], strict=True)], made[name].type
                    )
            names = [n for n in batch.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), *made.values()], names=[*names, *made]
            )

    return run


def _digest(names: list[str], text: str, schema, min_percent: int, own: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            made: dict[str, list] = {f.name: [] for f in out if f.name not in names}
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            for value, hits, items in zip(column(text), column(own[0]), column(own[1]), strict=True):
                raw = value.as_py() or ""
                n_words = len(normal_words(raw.encode()))
                spans = sorted((s["start"], s["end"]) for s in hits.as_py())
                merged: list[list[int]] = []
                for a, b in spans:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                n_hit = sum(b - a for a, b in merged)
                at = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))] if merged else []
                ids = sorted(set(items.as_py()))
                made["n_words"].append(n_words)
                made["n_hit"].append(n_hit)
                made["n_items"].append(len(ids))
                made["items"].append(ids)
                made["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                made["spans"].append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged])
                made["contaminated"].append(n_hit > 0 and 100 * n_hit >= min_percent * n_words)
            arrays = [column(n) for n in names] + [pa.array(made[f.name], f.type) for f in out if f.name in made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(arrays, out, strict=True)], schema=out)

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n_words: int = 13,
    min_percent: int = 5,
    keep: list[str] | None = None,
    max_pattern_chars: int = MAX_PATTERN_CHARS,
) -> DataFrame:
    """Columns keep of docs (default: all) and what each shares with the benchmark.

    n_words, n_hit (words in occurrences of item windows), n_items, items (sorted ids),
    items_sha256, spans (hit stretches as code points of the original text) and
    contaminated (min_percent of the words or more are hit).

    One automaton holds all normalised windows and reads each text once.  The benchmark
    is read by the driver in shards of at most max_pattern_chars characters (and one
    item); each shard is broadcast alone, and a benchmark of several shards means as
    many scans.  No shuffle.

    Defined cases: null, empty and wordless texts have no words and no hits; items
    without words match nothing, with fewer than n_words they are one window; equal
    windows of several items count for each; null item ids are written as the empty
    string; repeated rows are judged alike; an empty benchmark finds nothing; own
    columns with the names of results give way to these.
    """
    ddl = f"n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans {SPANS}, contaminated boolean"
    extra = schema_of(ddl)
    rest = without(docs, extra.names)
    own = fresh(docs, "hits_found"), fresh(docs, "items_found")
    names = [c for c in rest.columns if keep is None or c in keep]
    scanned = rest.select(*dict.fromkeys([*names, text]))
    base = list(scanned.schema.fields)
    wide = type(extra)([*base, *schema_of(f"{own[0]} {SPANS}, {own[1]} array<string>").fields])
    first = True
    for shard in _shards(benchmark, item_id, item_text, n_words, max_pattern_chars):
        key = hashlib.sha256(repr(shard).encode()).hexdigest()
        scanned = scanned.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(shard), key, text, first, own), wide)
        first = False
    if first:
        scanned = scanned.withColumns({own[0]: F.expr(f"cast(array() as {SPANS})"), own[1]: F.expr("cast(array() as array<string>)")})
    schema = type(extra)([*(rest.schema[c] for c in names), *extra.fields])
    return scanned.mapInArrow(_digest(names, text, schema, min_percent, own), schema)
