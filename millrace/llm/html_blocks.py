"""Leaf blocks of a page: what stands between block-level tags, with its tag path."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements whose contents are not text of the page.
RAW = frozenset("script style noscript template textarea title svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that one of these starts inside of ends first.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
PATH_DIMS, WORD_DIMS, OTHER_DIMS = 256, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + OTHER_DIMS
#: Elements of a tag path that are looked at, from the block outwards; the weight of the next would be under 0.06.
PATH_DEPTH = 64
_paths: dict[tuple, np.ndarray] = {}
_elements: dict[str, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> str:
    """The tag, and the words of its class, id and role."""
    if not attributes:
        return tag
    found = " ".join("".join(m) for m in _NAMES.findall(attributes)).lower()
    return " ".join([tag, *_TOKEN.findall(found)])


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, in page order, white space collapsed and references decoded.

    Time and memory grow as the page does, whatever stands in it: blocks share the
    PATH_DEPTH nearest elements of their paths, and what follows the last > holds no tag.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    shared: dict[tuple[str, ...], tuple[str, ...]] = {}
    parts: list[str] = []
    linked = in_link = 0
    lower: str | None = None

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            path = tuple(names for _, names in stack[-PATH_DEPTH:])
            out.append(Block(shared.setdefault(path, path), text, linked))
        parts.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at, past_tags = 0, page.rfind(">") + 1
    while at < len(page):
        m = _TAG.search(page, at, past_tags) if at < past_tags else None
        comment = -1 if m else page.find("<!--", at)  # one without an end hides the rest
        piece = page[at : m.start()] if m else page[at : comment if comment >= 0 else len(page)]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            linked += len(piece) if in_link else 0
        if not m:
            break
        at = len(page) if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if tag in RAW and not closing:
            if (m[3] or m[6] or "").endswith("/") and tag in ("svg", "math", "object", "iframe"):
                continue
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == len(page) else None
            found = lower.find(f"</{tag}", at) if lower is not None else _find_end(page, tag, at)
            at = len(page) if found < 0 else found
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK:
            end_block()
            if closing:
                if opened[tag]:
                    while close() != tag:
                        pass
            else:
                if tag not in CLOSES:
                    if stack and stack[-1][0] == "p":
                        close()
                else:
                    while stack and stack[-1][0] in CLOSES[tag]:
                        close()
                if tag not in VOID:
                    stack.append((tag, _names(tag, m[3] or m[6] or "")))
                    opened[tag] += 1
    end_block()
    return out


def _find_end(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(page, at)
    return m.start() if m else -1


def _element(names: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells that the tag and the names of an element hash to, and how many to each."""
    known = _elements.get(names)
    if known is None:
        hashed = [zlib.crc32(f"{'n' if i else 't'}{name}".encode()) % PATH_DIMS for i, name in enumerate(names.split())]
        cells, n = np.unique(hashed, return_counts=True)
        if len(_elements) > 20_000:
            _elements.clear()
        _elements[names] = known = cells, n.astype(np.float32)
    return known


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags and names of the path; what is nearer to the block weighs more."""
    known = _paths.get(path)
    if known is None:
        known = np.zeros(PATH_DIMS, np.float32)
        for depth, names in enumerate(reversed(path)):
            cells, n = _element(names)
            known[cells] += n / np.float32(1 + 0.25 * depth)
        np.minimum(known, 2.0, out=known)
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = known
    return known


def vectors(page_blocks: list[Block]) -> np.ndarray:
    """A row for each block: tag path, hashed words, and shape."""
    out = np.zeros((len(page_blocks), DIMS), np.float32)
    for i, b in enumerate(page_blocks):
        row = out[i]
        row[:PATH_DIMS] = _path_vector(b.path)
        w = b.text.lower().split()
        n = len(w)
        sample = np.fromiter((zlib.crc32(x.encode()) % WORD_DIMS for x in w), np.int64, n)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0.5 * np.bincount(sample, minlength=WORD_DIMS) / n
        chars = len(b.text)
        row[PATH_DIMS + WORD_DIMS :] = (
            np.log1p(n) / 5, np.log1p(chars) / 7, min(1.0, b.linked / chars), b.text[-1] in ".!?", "©" in b.text,
            i == 0, i / len(page_blocks), 1.0,
        )
    return out
