"""Main text of pages by a bidirectional LSTM over their blocks."""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import with_text_columns
from .html_blocks import DIMS, blocks, vectors

HIDDEN, SEED_PAGES, STEPS, BATCH = 16, 1600, 640, 32
#: Padded block vectors that are labelled at a time.
BATCH_BLOCKS = 16_384
_fitted: dict[str, Labeller] = {}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Labeller:
    """Weights of both directions (input, hidden, bias: four gates each) and of the output."""

    weights: dict[str, np.ndarray]

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN) of one direction; padding leaves the state as it was."""
        w, u, b = (self.weights[f"{d}{k}"] for k in "wub")
        pre = x @ w + b
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ u
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = np.where(m, o * tanh_c, h), np.where(m, c_new, c)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of each block (time, page), that it is main text."""
        both = np.concatenate([self._direction(x, mask, "f"), self._direction(x, mask, "b")], axis=2)
        return _sigmoid(both @ self.weights["v"] + self.weights["a"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients, back through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self._direction(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(hidden @ self.weights["v"] + self.weights["a"])
        n = mask.sum()
        loss = -(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n
        err = (p - y) * mask / n
        grads = {"v": np.einsum("tbh,tb->h", hidden, err), "a": err.sum()}
        back = err[:, :, None] * self.weights["v"]
        for k, d in enumerate("fb"):
            w, u = self.weights[f"{d}w"], self.weights[f"{d}u"]
            dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(kept[d]):
                dh = dh + back[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                ds = dc + dh * o * (1 - tanh_c**2)
                dz = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), dh * tanh_c * o * (1 - o), ds * i * (1 - g**2)], axis=1) * m
                dw += x[t].T @ dz
                du += h.T @ dz
                db += dz.sum(axis=0)
                dh, dc = np.where(m, dz @ u.T, dh), np.where(m, ds * f, dc)
            grads |= {f"{d}w": dw, f"{d}u": du, f"{d}b": db}
        return float(loss), grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Block vectors of some pages as (time, page, DIMS), and which of them are there."""
    longest = max(map(len, pages))
    if len(pages) == 1:  # as it lies
        return pages[0][:, None, :], np.ones((longest, 1), bool)
    x, mask = np.zeros((longest, len(pages), DIMS), np.float32), np.zeros((longest, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, True
    return x, mask


def seed_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A made page and the labels of its blocks (1: main text), in the layouts that sites use."""
    letters = list("abcdefghilmnoprstuvéüñ")
    vocabulary = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(60)]
    page: list[str] = []
    labels: list[int] = []
    pick = lambda *options: options[rng.integers(len(options))]
    some = lambda p: rng.random() < p

    def prose(low: int, high: int) -> str:
        words = list(rng.choice(vocabulary[: 2 if some(0.06) else 60], int(rng.integers(low, high))))
        if some(0.08):
            words = [w + pick("***", "!!", "%%%") for w in words] if some(0.5) else [w.upper() for w in words]
        for i in range(int(rng.integers(4, 12)), len(words), 12):
            words[i] += pick(".", ",", ".", "!")
        if some(0.15):
            at = int(rng.integers(len(words)))
            words[at] = f"<{(t := pick('b', 'i', 'em', 'a', 'span', 'code'))}{pick(' href=/x', '') if t == 'a' else ''}>{words[at]}</{t}>"
        return " ".join(words).capitalize() + pick(".", ".", ".", "", "?")

    def add(tag: str, text: str, label: int, attributes: str = "") -> None:
        page.append(f"<{tag}{attributes}>{text}" + ("" if tag in ("p", "li") and some(0.15) else f"</{tag}>"))
        labels.append(label)

    def box(tag: str, names: tuple[str, ...], fill, always: bool = False) -> None:
        attributes = f' {pick("class", "class", "id")}="{pick(*names)}"' if names and (always or tag in ("div", "section", "ul", "ol") or some(0.4)) else ""
        page.append(f"<{tag}{attributes}>")
        fill()
        page.append(f"</{tag}>")

    def menu() -> None:
        page.append("<ul>")
        for _ in range(rng.integers(2, 9)):
            add("li", f'<a href="/x">{prose(1, 4).rstrip(".?")}</a>', 0)
        page.append("</ul>")

    def lines(low: int, high: int, tags=("p", "div", "p")):
        def fill() -> None:
            for _ in range(rng.integers(1, 4)):
                add(pick(*tags), prose(low, high), 0)
        return fill

    def bare(low: int, high: int, words=("",)):
        def fill() -> None:
            page.append(f"{pick(*words)} {prose(low, high)}")
            labels.append(0)
        return fill

    def form() -> None:
        add("label", prose(1, 5), 0)
        page.append('<input name="q">')
        if some(0.5):
            page.append("<select>" + "".join("<option>" + prose(1, 3) for _ in range(2)) + "</select>")
            labels.extend([0, 0])
        add("button", pick("Send", "Search", "Subscribe", prose(1, 3)), 0)

    def comments() -> None:
        add(pick("h2", "h3"), pick("Comments", prose(1, 4)), 0)
        for _ in range(rng.integers(1, 6)):
            box(pick("div", "li", "article"), ("comment", "comment-body", "reply", "response", "comment depth"), lines(5, 90), True)

    def advert() -> None:
        box("div", ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsor", "promo", "sponsored banner", "adbox"), pick(bare(2, 40), lines(2, 30)))

    def notice() -> None:
        box(pick("div", "section", "aside"), ("cookie", "cookie-notice", "notice", "consent", "alert", "newsletter", "banner", "popup", "gdpr modal"), pick(bare(3, 50, ("We use cookies", "")), lines(3, 40)), True)

    def side() -> None:
        box(pick("aside", "aside", "div", "section"), ("sidebar", "widget", "related", "side", "share social", "recommended", "popular"), pick(menu, lines(2, 60), bare(2, 20)))

    def top() -> None:
        box(pick("header", "header", "div"), ("header", "masthead", "site-header", "top", "branding"), pick(menu, lines(1, 12, ("p", "h1", "div", "h2")), bare(1, 8)))

    def bottom() -> None:
        box(pick("footer", "footer", "div"), ("footer", "copyright", "site-footer", "foot", "bottom legal"), pick(bare(3, 40, ("&copy;", "© site ·", "")), lines(2, 30), menu))

    def navigation() -> None:
        box(pick("nav", "nav", "div", "ul"), ("nav", "menu", "navigation", "navbar", "breadcrumb", "main-menu"), menu)

    def story() -> None:
        if some(0.8):
            add(pick("h1", "h1", "h2"), prose(2, 12).rstrip("."), 1)
        for _ in range(rng.integers(1, 14)):
            r = rng.random()
            if r < 0.72:
                add("p", pick("", "", "<b>") + prose(2, 120) + pick("", "", "<br>"), 1)
            elif r < 0.78:
                add(pick("h2", "h3"), prose(1, 8), 1)
            elif r < 0.84:
                page.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    add("li", prose(2, 25), 1)
                page.append("</ul>")
            elif r < 0.88:
                add(pick("blockquote", "pre", "figcaption", "td", "div"), prose(3, 50), 1)
            elif r < 0.92:
                advert()
            elif r < 0.94:
                side()
            elif r < 0.96:
                box("form", ("signup", "newsletter"), form)

    parts = [(f, p) for f, p in ((top, 0.5), (navigation, 0.8), (notice, 0.25), (advert, 0.5), (side, 0.3), (lambda: box("form", ("search",), form), 0.15))]
    rng.shuffle(parts)
    page.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    for f, p in parts:
        if some(p):
            f()
    container, names = pick(
        ("article", ("post", "story", "entry")), ("article", ()), ("main", ("content", "main")), ("div", ("content", "article", "post-content", "entry-content", "story body", "article-body", "text main")),
        ("section", ("content", "article", "post")),
    )
    outer = some(0.3)
    if outer:
        page.append(f'<{(o := pick("div", "main", "section"))} {pick("class", "id")}="{pick("wrapper", "container", "page", "main", "content")}">')
    box(container, names, story)
    if some(0.25):
        box(pick("section", "div", "ol"), ("comments", "comment-list", "responses", "discussion comments", "replies"), comments, True)
    for f, p in ((side, 0.35), (advert, 0.2), (notice, 0.15), (lambda: box("form", ("contact",), form), 0.1)):
        if some(p):
            f()
    if outer:
        page.append(f"</{o}>")
    if some(0.9):
        bottom()
    if some(0.85):
        page.append("</body></html>")
    return "".join(page), labels


def seed_set(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made pages; those that the parser cuts otherwise than they were made are left out."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        page, labels = seed_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            out.append((vectors(found), np.array(labels, np.float32)))
    return out


def train(n_pages: int = SEED_PAGES, steps: int = STEPS, seed: int = 5) -> Labeller:
    """Fit on made pages (their number bounds it) with Adam; the same weights every time."""
    data = seed_set(n_pages, seed)
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    weights = {}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        weights |= {f"{d}w": normal(DIMS, 4 * HIDDEN), f"{d}u": normal(HIDDEN, 4 * HIDDEN), f"{d}b": bias}
    weights |= {"v": normal(2 * HIDDEN), "a": np.float32(0)}
    model = Labeller(weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    data.sort(key=lambda p: len(p[0]))
    for step in range(1, steps + 1):
        at = int(rng.integers(0, max(1, len(data) - BATCH)))
        batch = data[at : at + BATCH]
        x, mask = padded([p[0] for p in batch])
        y = np.zeros(mask.shape, np.float32)
        for i, (_, labels) in enumerate(batch):
            y[: len(labels), i] = labels
        _, grads = model.gradients(x, mask, y)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = (weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fitted() -> Labeller:
    """The labeller, trained once a process."""
    if "model" not in _fitted:
        _fitted["model"] = train()
    return _fitted["model"]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Of each page, the blocks that are main text, joined by an empty line."""
    out = [""] * len(pages)
    waiting: list[tuple[int, list, np.ndarray]] = []
    held = 0

    def label() -> None:
        waiting.sort(key=lambda w: len(w[1]))
        at = 0
        while at < len(waiting):  # pages of like length share a padded batch
            to = at + 1
            while to < len(waiting) and len(waiting[to][1]) <= 1.25 * len(waiting[at][1]) + 2 and (to - at) < 512:
                to += 1
            x, mask = padded([w[2] for w in waiting[at:to]])
            p = model.probabilities(x, mask)
            for i, (row, found, _) in enumerate(waiting[at:to]):
                out[row] = "\n\n".join(b.text for b, q in zip(found, p[: len(found), i], strict=True) if q >= 0.5)
            at = to
        waiting.clear()

    for row, page in enumerate(pages):
        if found := blocks(page):
            waiting.append((row, found, vectors(found)))
            held += len(found)
            if held >= BATCH_BLOCKS:
                label()
                held = 0
    if waiting:
        label()
    return out


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, model: Labeller | None = None) -> DataFrame:
    """Columns keep of pages (default: all), text (main-text blocks joined by an empty line) and n_chars.

    A page's leaf blocks, each as its tag path, hashed words and shape, are read in both
    directions and every one is labelled from the whole page.  The weights (some tens of
    kilobytes) are trained on made pages of many layouts, whose number is the bound of
    the sample.  One pass, no shuffle.

    Defined cases: a null or empty page, and one without main text, has an empty text; a
    page of any length is read whole, in time and memory that grow as it does (about 2 KB
    for each block); broken and unclosed markup is read as far as it goes; no rows give no
    rows; rows are judged alone; own columns named text or n_chars give way to these.
    """
    frozen = pickle.dumps((model or fitted()).weights)
    key = hashlib.sha256(frozen).hexdigest()

    def run(column: pa.Array) -> dict[str, object]:
        if key not in _fitted:
            _fitted[key] = Labeller(pickle.loads(frozen))  # noqa: S301
        texts: list[str] = []
        for at in range(0, len(column), 500):
            texts += main_texts(column.slice(at, 500).to_pylist(), _fitted[key])
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return with_text_columns(pages, html, "text string, n_chars long", run, keep)
