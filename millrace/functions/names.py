"""Names of persons in text, found by what stands beside them.

A line is read as tokens.  Capitalised words in a row are a candidate; it is a name if an honorific or a relation (S/O ...) touches
it, or, for two words or more, if it is a party (... vs ...), or a role stands before or behind it.  Words that belong to
organisations, festivals and places speak against it.  The lists of words are this module's own choice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

HONORIFICS = frozenset("dr prof mr mrs ms smt shri sri kum".split())
ROLES = frozenset("principal hod lecturer professor faculty student alumnus alumna petitioner respondent applicant accused".split())
#: Words that name institutions, events or works, and so no person.
THINGS = frozenset(
    "academy association award bank board bridge bureau campus centre center church club college committee company conference corporation council court department federation festival film foundation "
    "group hall hospital industries institute institution laboratory league library limited ltd mandir mission museum office party polytechnic press prize road school series society state street studio "
    "temple trust union university vidyalaya ashtami chaturthi ekadashi jayanti navami puja pooja utsav habba ministry authority government".split()
)
#: Words that may stand at the edge of a name and are no part of it.
EDGES = frozenset(
    "a an and at by contact dear for from her his in late my of on our the their this to was with who another others former new hon justice judge chairman chairperson chief dean director head manager member "
    "minister officer president registrar secretary team trustee vice january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday india karnataka lanka bengaluru mysuru delhi mumbai chennai".split()
) | ROLES
_TOKENS = re.compile(
    r"(?P<other>\S*(?:://|@)\S*|www\.\S+)|(?P<relation>[SDWsdw]/[Oo](?!\w)\.?)|(?P<versus>(?:[Vv][Ss]|[Vv]ersus|[Vv]/[Ss])(?!\w)\.?|v\.(?!\w))"
    r"|(?P<word>[^\W\d_]+(?:(?:['’](?!s\b)|-)[^\W\d_]+)*)|(?P<mark>[^\w\s]|[\w]+)"
)
_BEHIND = re.compile(r"[ \t]*(?:,|:|\(|[-–—|](?=[ \t]))[ \t]*(?:(?:an?|the|our)[ \t]+)?(?:\d+(?:st|nd|rd|th)[ \t]+year\b|(?:(?:assistant|associate)[ \t]+)?([a-z]+))", re.I)
MOST_WORDS = 6


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def _tokens(line: str, offset: int) -> list[Token]:
    """Tokens of a line; a capitalised word is a name, or title if it is an honorific; a full stop belongs to short forms."""
    out: list[Token] = []
    for m in _TOKENS.finditer(line):
        kind, text = m.lastgroup, m.group()
        if kind == "word" and text[0].isupper() and (len(text) == 1 or not text.isupper()):
            kind = "title" if text.lower() in HONORIFICS else "name"
        if text == "." and out and out[-1].end == offset + m.start() and (out[-1].kind == "title" or (out[-1].kind == "name" and len(out[-1].text) == 1)):
            out[-1].end += 1
            continue
        out.append(Token(kind, text, offset + m.start(), offset + m.end()))
    return out


def _candidates(tokens: list[Token]) -> Iterator[tuple[int, int]]:
    """(first, one past the last) of names in a row."""
    at = 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end].kind == "name" and end - at < MOST_WORDS:
            end += 1
        if end > at:
            yield at, end
        at = max(end, at + 1)


def _trimmed(tokens: list[Token], low: int, high: int) -> tuple[int, int]:
    """Without edge words in front; up to the first of them behind."""
    while low < high and tokens[low].text.lower() in EDGES:
        low += 1
    stop = next((i for i in range(low, high) if tokens[i].text.lower() in EDGES), high)
    return low, stop


def _of_a_thing(tokens: list[Token], low: int, high: int) -> bool:
    """Whether the words, or those that 'of', 'and' or '&' join to them, name a thing."""
    end = high
    while end + 1 < len(tokens) and tokens[end].text in ("of", "and", "&") and tokens[end + 1].kind in ("name", "title"):
        end += 2
    later = [t.text.lower() for t in tokens[high : end + 1] if t.kind in ("name", "word")]
    return any(w in THINGS for w in (*(t.text.lower() for t in tokens[low:high]), *later))


def name_spans(text: str, keep: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Stretches that are a person's name with its honorifics, in order, none touching another; words of keep are no names."""
    found, offset = [], 0
    for line in text.splitlines(keepends=True):
        tokens = _tokens(line, offset)
        offset += len(line)
        for low, high in _candidates(tokens):
            first, last = _trimmed(tokens, low, high)
            own = [t.text.lower() for t in tokens[first:last]]
            real = [w for w in own if len(w) > 1]
            if not real or all(w in keep for w in real) or _of_a_thing(tokens, low, high):
                continue
            before = tokens[low - 1] if low else None
            behind = tokens[last] if last < len(tokens) else None
            touched = before and first == low and before.kind == "title" or before and before.kind == "relation" or behind and behind.kind == "relation"
            if behind and behind.text == "," and last + 1 < len(tokens):
                touched = touched or tokens[last + 1].kind == "relation"
            if not touched and len(own) > 1:
                party = any(t is not None and t.kind == "versus" for t in (before, behind))
                led = [t.text.lower() for t in tokens[max(0, low - 2) : low] if t.text not in (":", ",", "-")] + [t.text.lower() for t in tokens[low:first]]
                role = bool(led) and (led[-1] in ROLES or (led[-1] == "by" and len(led) > 1 and led[-2].startswith(("review", "post", "writ"))))
                said = _BEHIND.match(text, tokens[last - 1].end)
                touched = party or role or (said is not None and (said.group(1) is None or said.group(1).lower().removesuffix("s") in ROLES))
            if touched:
                start = first
                while start == low and low and tokens[low - 1].kind == "title":
                    start = low = low - 1
                found.append((tokens[start].start, tokens[last - 1].end))
    return found


def redacted(text: str, keep: frozenset[str] = frozenset()) -> str:
    """The text with [name] for each name of a person."""
    parts, at = [], 0
    for a, b in name_spans(text, keep):
        parts += [text[at:a], "[name]"]
        at = b
    return "".join([*parts, text[at:]])


@arrow_udf(T.StringType())
def without_names(texts: pa.Array) -> pa.Array:
    """One text at a time is in hand besides the batch and its result."""
    return pa.array((redacted(t) if (t := x.as_py()) else t for x in texts), pa.string())
