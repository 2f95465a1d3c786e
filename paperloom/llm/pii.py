"""Personal data: base rules, and a skip-chain conditional random field over candidate tokens.

Candidates are stretches with digits or an at sign. Neighbours form a chain; equal or similar candidates anywhere in the
document are joined by skip edges, each open one also to the nearest observed one, so that loopy message passing carries a
label from a clear occurrence to unclear ones at any distance. The base rules' spans are observed labels; unary and edge weights are learnt from them (distant supervision)."""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import least_hashes, read
from paperloom.llm.spans import Span, digest, scan

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
TRAIN_ROWS = 3000  # documents with candidates that training takes, about; the bound of the sample
TRAIN_CHARS = 50_000  # longer texts are not drawn into the sample (they are scanned whole like all others)
LEAST_MARGINAL = 0.9  # of an added span
SETTLED = 1e-4  # the largest change of a message, in log space, at which message passing ends
MOST_ROUNDS = 500  # of message passing where messages don't settle
NEAR = 80  # characters between neighbours of the chain: a label tells of the next candidate within a line or two only
# What the rules of a kind already decide needs a mention elsewhere: an address or card number by itself is a base span, or
# it breaks a rule. Open candidates of these kinds are added only if an equal or similar one is observed in the document.
NEEDS_MENTION = frozenset({"ip", "card"})

# Fixed patterns, as the scan defines them (lookbehinds and possessive runs only save time).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20-]*[0-9]")
PIECE = re.compile(r"[0-9][0-9-]*")
MOST_DIGITS = 19  # of a number of any kind
CONTEXT = {
    1: ("mail", "email", "e-mail", "contact"), 2: ("ip", "host", "server", "addr", "address"),
    3: ("card", "visa", "credit", "mastercard", "carte", "tarjeta", "karte"),
    4: ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    out = [("email", a, b, True, 1.0) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span(), True, 1.0))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span(), True, 1.0))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span(), True, 1.0))
    return out


@dataclass
class Node:
    start: int
    end: int
    text: str
    label: int | None  # observed, or None
    key: str
    clear: bool = False  # observed in a stretch that the base rules refuse as a whole


def cards_in(text: str) -> list[tuple[int, int]]:
    """Card numbers side by side in a stretch of more digits than one has: pieces between blanks that are one by themselves,
    and four pieces of four digits that are one together."""
    pieces = [(m.start(), m.end(), _digits(m[0])) for m in PIECE.finditer(text)]
    out, i = [], 0
    while i < len(pieces):
        four = pieces[i : i + 4]
        if 13 <= len(pieces[i][2]) <= 19 and luhn(pieces[i][2]):
            out.append(pieces[i][:2])
        elif [len(p[2]) for p in four] == [4, 4, 4, 4] and luhn("".join(p[2] for p in four)):
            out.append((four[0][0], four[3][1]))
            i += 3
        i += 1
    return out


def candidates(text: str, base: list[Span]) -> list[Node]:
    """Base spans, and card numbers side by side, as observed nodes, and other stretches of numbers or around an at sign as
    open ones, in order."""
    held = sorted(base, key=lambda s: (s[1], -s[2]))
    nodes, end = [], -1
    for kind, a, b, _, _ in held:
        if a >= end:
            nodes.append(Node(a, b, text[a:b], LABELS.index(kind), ""))
            end = b
    taken = sorted((s[1], s[2]) for s in base)
    free, at = [], 0
    for a, b in taken:
        if a > at:
            free.append((at, a))
        at = max(at, b)
    free.append((at, len(text)))
    for a, b in free:
        numbers = [m for m in NUMBER.finditer(text, a, b) if sum("0" <= c <= "9" for c in m[0]) >= 4]
        for m in numbers:
            parts = cards_in(m[0]) if len(_digits(m[0])) > MOST_DIGITS else []
            nodes += [Node(m.start() + s, m.start() + e, m[0][s:e], LABELS.index("card"), "", True) for s, e in parts]
            if not parts:
                nodes.append(Node(*m.span(), m[0], None, ""))
        starts, ends, last = [m.start() for m in numbers], [m.end() for m in numbers], a
        x = text.find("@", a, b)
        while x >= 0:
            s, e = x, x + 1
            while s > a and text[s - 1] in LOCAL:
                s -= 1
            while e < b and (text[e] in LOCAL):
                e += 1
            if s < x and e > x + 1 and s >= last and bisect_left(starts, e) == bisect(ends, s):  # apart from all others
                nodes.append(Node(s, e, text[s:e], None, ""))
                last = e
            x = text.find("@", e, b)
    for n in nodes:
        n.key = n.text.lower().rstrip(".") if "@" in n.text else _digits(n.text)
    nodes.sort(key=lambda n: n.start)
    return nodes


def features(text: str, n: Node) -> np.ndarray:
    """Shape and context of a candidate, between 0 and 1; the sign that tells the base rules apart is left out."""
    t, d = n.text, _digits(n.text)
    before = text[max(0, n.start - 24) : n.start].lower()
    parts = t.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
    return np.array(
        [1.0, "@" in t, "." in t.rpartition("@")[2], quad, 12 <= len(d) <= 19, 12 <= len(d) <= 19 and luhn(d),
         9 <= len(d) <= 11, len(d) < 7, "(" in t and ")" in t, " " in t, "-" in t, len(d) in (10, 11) and len(t) > len(d),
         *(any(w in before for w in CONTEXT[k]) for k in (1, 2, 3, 4))],
        np.float64,
    )


FEATURES = 16


def similar(a: str, b: str) -> bool:
    """Equal; one number with a prefix of at most three digits more; an address without its last domain part."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if "@" in a or "@" in b:
        return "@" in a and "@" in b and b.startswith(a + ".")
    return len(a) >= 9 and len(b) - len(a) <= 3 and b.endswith(a)


def skip_edges(nodes: list[Node]) -> list[tuple[int, int]]:
    """Each candidate with the last equal and the last similar one before it: edges grow with the number of candidates."""
    last: dict[str, int] = {}
    tails: dict[str, int] = {}
    out = []
    for i, n in enumerate(nodes):
        tail = n.key[-9:] if "@" not in n.key else n.key.split("@")[0]
        for j in {last.get(n.key), tails.get(tail)} - {None}:
            if similar(nodes[j].key, n.key):
                out.append((j, i))
        last[n.key] = tails[tail] = i
    return out


def forms(key: str) -> list[str]:
    """The shorter keys that are similar to ``key``: without its first one to three digits, or its last domain parts."""
    if "@" in key:
        return [key[:i] for i, c in enumerate(key) if c == "." and "@" in key[:i]]
    return [key[i:] for i in (1, 2, 3) if len(key) - i >= 9]


def observed_edges(nodes: list[Node]) -> list[tuple[int, int]]:
    """Each open candidate with the nearest observed one, before or after it, of an equal or similar key: a label crosses
    a document of any length in one step, and edges grow with the number of candidates."""
    exact: dict[str, list[int]] = {}
    longer: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        if n.label is not None:
            exact.setdefault(n.key, []).append(i)
            for f in forms(n.key):
                longer.setdefault(f, []).append(i)
    out = []
    for i, n in enumerate(nodes):
        if n.label is None:
            near = [exact.get(n.key), longer.get(n.key), *(exact.get(f) for f in forms(n.key))]
            found = [at[j] for at in near if at for j in (bisect(at, i) - 1, bisect(at, i)) if 0 <= j < len(at)]
            if found:
                j = min(found, key=lambda x: (abs(x - i), x))
                out.append((min(i, j), max(i, j)))
    return out


@dataclass
class Crf:
    unary: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels): log potentials of neighbours
    skip: float  # log potential of equal labels on a skip edge

    def marginals(self, text: str, nodes: list[Node]) -> np.ndarray:
        """Label beliefs of each node by loopy message passing, damped, in log space, until messages settle."""
        k = len(LABELS)
        own = np.array([features(text, n) for n in nodes]) @ self.unary
        for i, n in enumerate(nodes):
            if n.label is not None:
                own[i] = -50.0
                own[i, n.label] = 0.0
        edges = [
            (i, i + 1, self.chain) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= NEAR
        ] + [(i, j, self.skip * np.eye(k)) for i, j in sorted({*skip_edges(nodes), *observed_edges(nodes)})]
        if not edges:
            return _norm(own)
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        pot = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(src), k))
        for _ in range(MOST_ROUNDS):
            total = own.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change < SETTLED:
                break
        total = own.copy()
        np.add.at(total, dst, msg)
        return _norm(total)


def _norm(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], seed: int = 0) -> Crf:
    """Unary weights by stochastic gradient descent on observed candidates and on numbers too short for any kind; edge
    weights from how often neighbours, and similar candidates, bear equal labels."""
    xs, ys, chain = [np.eye(FEATURES)[0]], [0], np.full((len(LABELS), len(LABELS)), 50.0)
    same = joined = 20.0  # the prior: twenty similar pairs that agree
    for t in texts:
        nodes = candidates(t, base_spans(t))
        for n in nodes:
            if n.label is not None or len(n.key) < 7 and "@" not in n.text:
                xs.append(features(t, n))
                ys.append(n.label or 0)
        for a, b in zip(nodes, nodes[1:], strict=False):
            if b.start - a.end <= NEAR:
                chain[a.label or 0, b.label or 0] += 1
        for i, j in skip_edges(nodes):
            if nodes[i].label is not None and nodes[j].label is not None:
                joined += 1
                same += nodes[i].label == nodes[j].label
    x, y = np.array(xs), np.array(ys)
    rng, w = np.random.default_rng(seed), np.zeros((FEATURES, len(LABELS)))
    for epoch in range(20):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            g = _norm(x[part] @ w)
            g[np.arange(len(part)), y[part]] -= 1
            w -= 0.5 / (1 + epoch / 5) * (x[part].T @ g / max(1, len(part)) + 1e-4 * w)
    p = chain / chain.sum()
    pmi = np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))
    odds = (same + 1) / (joined - same + 1)
    return Crf(w, np.clip(pmi, -1, 1), float(np.clip(np.log(odds * (len(LABELS) - 1)), 1.0, 6.0)))


def fits(kind: str, n: Node, linked: bool) -> bool:
    """Whether a candidate's shape allows the kind: the lengths and signs that the base rules ask for, but for the one sign
    that tells it apart (a phone's plus or, in its place, brackets; an address's full domain). ``linked``: an equal or
    similar candidate is observed as this kind in the document."""
    if kind in NEEDS_MENTION and not linked:
        return False
    d = len(_digits(n.text))
    if kind == "email":
        return "@" in n.text and (linked or "." in n.text.rpartition("@")[2])
    if kind == "phone":
        return "@" not in n.text and 9 <= d <= 15 and (linked or "(" in n.text and ")" in n.text)
    return "@" not in n.text and (kind == "ip" or 12 <= d <= 19)


def finder(crf: Crf):
    """A function from a text to its spans: base ones, and candidates that the field labels with enough belief."""

    def find(text: str) -> list[Span]:
        base = base_spans(text)
        if "@" not in text and not DIGIT.search(text):
            return base
        nodes = candidates(text, base)
        out = base + [(LABELS[n.label], n.start, n.end, False, 1.0) for n in nodes if n.clear]
        if all(n.label is not None for n in nodes):
            return out
        belief = crf.marginals(text, nodes)
        seen = {(n.label, n.key) for n in nodes if n.label is not None}
        seen |= {(n.label, f) for n in nodes if n.label is not None for f in forms(n.key)}
        for n, p in zip(nodes, belief, strict=True):
            k = int(p.argmax())
            if n.label is None and k and p[k] >= LEAST_MARGINAL:
                linked = (k, n.key) in seen or any((k, f) in seen for f in forms(n.key))
                if fits(LABELS[k], n, linked):
                    out.append((LABELS[k], n.start, n.end, False, round(float(p[k]), 6)))
        return out

    return find


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Crf:
    """A field from the ``train_rows`` documents with the least hashes of doc_id (and text) among those with an address or
    a longer number and at most TRAIN_CHARS characters: the same rows however the table is partitioned."""
    fit = (F.char_length("text") <= TRAIN_CHARS) & F.col("text").rlike("@|[0-9]{4}|[0-9]\\.[0-9]")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    rows = least_hashes(own, fit, [F.col("doc_id"), F.lit(6)], train_rows, ["t"]).collect()
    return train([r["text"] for r in rows])


def scan_pii(docs: DataFrame, crf: Crf, name: str = "spans") -> DataFrame:
    """Add ``name``: the personal data in each whole text, an array of (kind, start, end, base, score) by start, then kind.

    Base spans follow the fixed rules; others are card numbers side by side, and those that the field adds. A null or empty text has no
    spans; repeated rows get equal results; an empty table stays empty; a column called ``name`` is replaced, others
    stay. The field (a few hundred numbers) goes with the tasks; texts stay where they are, without a shuffle; work and
    memory follow a text's length and its number of candidates, since each candidate has three skip edges at most."""
    return scan(docs, finder(crf), KINDS, name)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``; cases as scan_pii() says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan_pii(docs, fit(docs)), KINDS)
