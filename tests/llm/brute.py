"""Plain, slow versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
from html.parser import HTMLParser

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def _covered(w, n, again):
    seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    before, inside = set(), [False] * len(w)
    for i in range(len(w) - n + 1):
        gram = tuple(w[i : i + n])
        if (seen[gram] > 1) if again else (gram in before):
            inside[i : i + n] = [True] * n
        before.add(gram)
    return inside


def quality(text, rules):
    w = words(text)
    lines = [x for x in (text or "").split("\n")]
    seen, repeated, repeated_chars = set(), 0, 0
    for line in lines:
        own = words(line)
        if not own:
            continue
        if line in seen:
            repeated += 1
            repeated_chars += sum(len(x.decode()) for x in own)
        seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    n_repeat = sum(_covered(w, 3, True))
    failed = len(w) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(w)
    bad = repeated_chars / max(chars, 1) > rules.max_line_share
    for n, most in rules.max_coverage.items():
        inside = _covered(w, n, False)
        bad |= sum(len(x.decode()) for x, y in zip(w, inside) if y) / max(chars, 1) > most
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), chars, symbols, repeated, n_repeat, failed, not (failed or bad)


def repeats(rows, n=20):
    """rows: (id, text) with distinct ids, null ids counted as one document at the end."""
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - n + 1):
            key, at = tuple(w[s : s + n]), (order((i,)), s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (order((i,)), s):
                gone[s : s + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, y in zip(w, gone) if not y))))
    return out


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate({b: b + 32 for b in range(65, 91)}))


def contaminated(docs, items, n=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - n + 1)):
            if w:
                windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (key := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[key]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(rows):
    """rows: (id, text); the smallest id reachable over at most two bits."""
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    smallest = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(doc, f"{fps[i]:016x}", smallest(least[find(i)])) for i, (doc, _) in enumerate(rows)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, match):
    d = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d[::-1]))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def pii(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if _passes(k, m.group())]


def bigram_losses(rows, target):
    """Of each (id, text): mean loss under the background and the target model."""
    w = [(i, words(t)) for i, t in rows]
    count = [collections.Counter(x for _, ws in w for x in ws), collections.Counter(x for i, ws in w if i in target for x in ws)]
    total = [sum(c.values()) for c in count]
    known, coded = set(count[0]), w
    pairs = [collections.Counter(p for _, q in coded for p in zip(q, q[1:])), collections.Counter(p for i, q in coded if i in target for p in zip(q, q[1:]))]
    kept = set(pairs[0])
    out = {i: [] for i, _ in rows}
    for k in (0, 1):
        c = {x: count[k][x] for x in known}
        one = {x: (n + 0.5) / (total[k] + 0.5 * (len(known) + 1)) for x, n in c.items()}
        share = {p: max(pairs[k][p] - 0.75, 0) / max(c[p[0]], 1) for p in kept}
        back = collections.defaultdict(lambda: 1.0)
        for p, v in share.items():
            back[p[0]] -= v
        for i, q in coded:
            p = [one[x] if j == 0 else share.get((q[j - 1], x), 0) + max(back[q[j - 1]], 1e-9) * one[x] for j, x in enumerate(q)]
            out[i].append(sum(-math.log(x) for x in p) / len(q) if q else None)
    return out


def kneser_ney(train, whole=None):
    """The trigram model of some texts as a function from a text to its log perplexity; its vocabulary may be that of other texts."""
    w = [words(t) for t in train]
    count = collections.Counter(x for t in whole or train for x in words(t))
    known = {x for x in count if count[x] > 1}
    rare = max(1, sum(1 for x in count if count[x] == 1))
    code = lambda ws: ["<", "<", *(x if x in known else "?" for x in ws)]
    c3 = collections.Counter(t for ws in w for q in [code(ws)] for t in zip(q, q[1:], q[2:]))
    c2 = collections.Counter(t[1:] for t in c3)
    c1 = collections.Counter(t[1:] for t in c2)

    def discounts(c):
        n = [sum(1 for v in c.values() if v == k) for k in range(1, 5)]
        if 0 in n[:2]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        made = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k for k in (1, 2, 3)]
        return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(made, 1)]

    orders = []
    for c in (c1, c2, c3):
        d = discounts(c)
        taken = {g: d[min(n, 3) - 1] for g, n in c.items()}
        total, held = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            held[g[:-1]] += taken[g]
        orders.append((c, taken, total, held))

    def p(gram):
        c, taken, total, held = orders[len(gram) - 1]
        low = p(gram[1:]) if len(gram) > 1 else 1 / (len(known) + 1)
        if not total[gram[:-1]]:
            return low
        return (c[gram] - taken[gram] if gram in c else 0) / total[gram[:-1]] + held[gram[:-1]] / total[gram[:-1]] * low

    def loss(text):
        q = code(words(text))
        parts = [-math.log(p(g) / (rare if g[2] == "?" else 1)) for g in zip(q, q[1:], q[2:])]
        return sum(parts) / len(parts) if parts else None

    return loss


def shingles(text, n=5):
    w = [bytes(x).lower() for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(rows, least):
    """Components of texts whose shingle sets have a Jaccard similarity of least or more: a label for each row."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and len(a & sets[j]) >= least * len(a | sets[j])):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


class _Plain(HTMLParser):
    """Blocks of well-formed pages, one event at a time."""

    def __init__(self, block, raw, void, closes):
        super().__init__(convert_charrefs=True)
        self.block, self.raw, self.void, self.closes = block, raw, void, closes
        self.found, self.stack, self.text, self.hidden = [], [], "", 0

    def flush(self):
        if words := self.text.split():
            self.found.append((tuple(self.stack), " ".join(words)))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.raw:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "br":
            self.text += " "
        if tag in self.block:
            self.flush()
            while self.stack and self.stack[-1].split()[0] in self.closes.get(tag, {"p"}):
                self.stack.pop()
                if tag not in self.closes:
                    break
            if tag not in self.void:
                names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
                self.stack.append(" ".join([tag, *re.findall("[a-z]+", names)]))

    def handle_endtag(self, tag):
        if tag in self.raw:
            self.hidden -= 1
        elif not self.hidden and tag in self.block:
            self.flush()
            if any(s.split()[0] == tag for s in self.stack):
                while self.stack.pop().split()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def blocks(page, *sets):
    """(path, text) of each block of a well-formed page."""
    reader = _Plain(*sets)
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.found


def labels(weights, vectors, hidden):
    """Probability of each block of one page by a bidirectional LSTM, number by number."""
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def direction(d, order):
        w, u, b = (weights[f"{d}{k}"].tolist() for k in "wub")
        h, c, out = [0.0] * hidden, [0.0] * hidden, {}
        for t in order:
            x = [(i, v) for i, v in enumerate(vectors[t].tolist()) if v]
            z = [b[j] + sum(v * w[i][j] for i, v in x) + sum(h[i] * u[i][j] for i in range(hidden)) for j in range(4 * hidden)]
            gate = lambda k: z[k * hidden : (k + 1) * hidden]  # noqa: E731, B023
            c = [sigmoid(f) * old + sigmoid(i) * math.tanh(g) for i, f, g, old in zip(gate(0), gate(1), gate(3), c, strict=True)]
            h = [sigmoid(o) * math.tanh(v) for o, v in zip(gate(2), c, strict=True)]
            out[t] = h
        return out

    n, v = len(vectors), weights["v"].tolist()
    one, two = direction("f", range(n)), direction("b", range(n - 1, -1, -1))
    return [sigmoid(sum(a * b for a, b in zip([*one[t], *two[t]], v, strict=True)) + float(weights["a"])) for t in range(n)]


def pack(lengths, capacities, cost):
    """Bin of each length, one open bin after another looked at; and each bin's use and final capacity."""
    rest = list(lengths)
    bins, out, clock = [], [], 0  # a bin: capacity, use, when it last changed
    for n in lengths:
        rest.remove(n)
        clock += 1
        fits = [(b[0] - b[1], -b[2], i) for i, b in enumerate(bins) if b[0] - b[1] >= n]
        if fits:
            i = min(fits)[2]
        else:
            def price(c, n=n):
                return cost(c) / (n + min(c - n, sum(x for x in rest if x <= c - n)))

            best = min((c for c in sorted(capacities) if c >= n), key=price)
            bins.append([best, 0, 0])
            i = len(bins) - 1
        bins[i][1] += n
        bins[i][2] = clock
        out.append(i)
    return out, [b[1] for b in bins], [min(c for c in capacities if c >= b[1]) for b in bins]


def merkle(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text) with distinct ids; what the manifest says of each."""
    import zlib

    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + fanout])) for i in range(0, len(found[-1]), fanout)])
        return found

    def way(levels, at):
        steps = []
        for nodes in levels[:-1]:
            low = at // fanout * fanout
            steps.append((nodes[low:at], nodes[at + 1 : low + fanout]))
            at //= fanout
        return steps

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], sha("".join(map(value, r))), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for _, d, _ in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, leaf, row) in enumerate(sorted(groups[s])):
            steps = way(trees[s], i) + way(top, k)
            own = leaf
            if zlib.crc32(str(doc).encode()) % 5 == 0 and row[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                own = sha("".join(map(value, (*row[:4], lower))))
            for left, right in steps:
                own = sha("".join([*left, own, *right]))
            proof = sha("".join("".join(left + right) for left, right in steps))
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, own, own == top[-1][0]))
    return out


def alignment(rows, first, second):
    """rows: (doc_id, text); both tokenizations by their libraries, links by comparing ranges of bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    one.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    names = {i: t for t, i in one.get_vocab().items()}

    def raw(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at := at + len(of(i))))
        return out

    found = []
    for doc, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        of_a = lambda i: bytes(byte[c] for c in names[i])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(of_a, a)) != whole or b"".join(map(raw, b)) != whole:
            found.append((doc, 0, 0, [], []))
            continue
        a, b = spans(a, of_a), spans(b, raw)
        links, j0 = [], 0
        for i, low, high in a:
            while b[j0][2] <= low:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < high:
                links.append((i, b[j][0]))
                j += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        ia = ib = 0
        for e in ends:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= e:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= e:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        found.append((doc, len(a), len(b), groups, links))
    counts = collections.Counter(p for *_, links in found for p in set(links))
    top = collections.defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [
        (doc, n_a, n_b, len(g), len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), sha(";".join(g)) if n_a else "")
        for doc, n_a, n_b, g, ls in found
    ]
