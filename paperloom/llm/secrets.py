"""Secret scans: base patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax as pairs of names and literals, propagates constants (a name that stands
for an earlier literal, joined literals) and scores literals by how sensitive their target names are."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from paperloom.llm.common import read
from paperloom.llm.spans import Span, digest, scan

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "lexed"]
LEAST_SCORE = 0.5  # of an added span

# Fixed patterns and names, as the scan defines them.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5,
}
SENSITIVE_PAIRS = {
    ("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("encryption", "key"), ("signing", "key"),
    ("auth", "key"), ("account", "key"), ("master", "key"),
}
ENDINGS = ("password", "passwd", "pass", "pwd", "secret", "token")  # of a word that runs names together
NO_ENDINGS = {"compass", "bypass", "trespass", "surpass", "overpass", "underpass", "encompass"}
PLACEHOLDERS = {"password", "changeme", "example", "placeholder", "undefined", "redacted", "your_password", "secret"}

OPERATOR = re.compile(r":=|=>|[=!<>]=|[=:]")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
QUOTED = {q: re.compile(rf"{q}(?P<body>(?:[^{q}\\\n]|\\[^\n])*+){q}") for q in "\"'`"}
LONG_QUOTED = re.compile(r"""(\"\"\"|'''|```)(?P<body>(?:(?!\1)[^\\]|\\.)*+)\1""", re.DOTALL)
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</\1>")
TAG = re.compile(r"<[A-Za-z][^<>]*+>")
ATTRIBUTE = re.compile(r"""(?<![A-Za-z0-9_.:-])([A-Za-z_][A-Za-z0-9_.:-]*+)\s*+=\s*+(?:"([^"<>\n]++)"|'([^'<>\n]++)')""")
LITERAL = r"""(["'])((?:(?!\2)[^\\\n]|\\[^\n])++)\2"""
DEFINE = re.compile(rf"^[ \t]*+#[ \t]*+define[ \t]++([A-Za-z_][A-Za-z0-9_]*+)[ \t]++{LITERAL}", re.MULTILINE)
SETTER = re.compile(rf"(?<![A-Za-z0-9_])(?:set|with|use)_?([A-Z_a-z][A-Za-z0-9_]*+)\([ \t]*+{LITERAL}[ \t]*+\)")
FLAG = re.compile(r"""(?<![A-Za-z0-9_-])--([A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?:(["'])([^"'\n]++)\2|([^\s"'-]\S*+))""")
NEXT_LINE = re.compile(r"[(\[]?[ \t]*+\\?\n[ \t]*+(?=[fFrRbBuU]{0,2}[\"'`])|[(\[][ \t]*+(?=[fFrRbBuU]{0,2}[\"'`])")
AGAIN = re.compile(r"[ \t]*+\n[ \t]*+(?=[fFrRbBuU]{0,2}[\"'`])")  # in brackets: the next of literals that are one
PREFIX = re.compile(r"[fFrRbBuU]{1,2}(?=[\"'`])")
FIELD = re.compile(r"\{\s*+([A-Za-z_][A-Za-z0-9_.]*+)\s*+\}")
NO_LITERAL = re.compile(r"[<>{}\n]|\$\(")
LONGEST_PLACEHOLDER = 16
MOST_COUNTED = 1 << 60
BARE = re.compile(r"[A-Za-z0-9_+/.=@$%^&*!~#?-]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
JOINER = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_])")
CALL = re.compile(r"\.[A-Za-z_]")  # after a literal: a method, with which the value ends
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span(), True, 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), True, 1.0) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span(), True, 1.0) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words (of snake, kebab, dotted or camel case), the last counting most."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not parts:
        return 0.0
    best = 0.0
    for i, p in enumerate(parts):
        joined = 0.8 if p.endswith(ENDINGS) and p not in NO_ENDINGS else 0.0
        score = max(SENSITIVE.get(p, joined), 1.0 if i and (parts[i - 1], p) in SENSITIVE_PAIRS else 0.0)
        best = max(best, score if i == len(parts) - 1 else 0.7 * score)
    return best


class Value:
    """What a name stands for: one literal, or others joined. Values are shared, not copied: joining costs the same however
    much the parts hold, and the same part twice adds nothing."""

    __slots__ = ("bad", "counts", "parts", "quoted", "size", "span", "text", "told")

    def __init__(self, text: str, start: int, end: int, quoted: bool) -> None:
        self.span, self.quoted, self.size, self.parts = (start, end), quoted, len(text), ()
        self.text = text if len(text) <= LONGEST_PLACEHOLDER else None
        self.counts = Counter(text)
        self.bad = bool(NO_LITERAL.search(text))
        self.told = False  # whether its spans have been given

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        parts = list({id(p): p for p in parts}.values())
        if len(parts) == 1:
            return parts[0]
        texts = [p.text for p in parts]
        out = cls("".join(texts) if None not in texts else "x" * (LONGEST_PLACEHOLDER + 1), 0, 0, all(p.quoted for p in parts))
        out.parts, out.size, out.bad = tuple(parts), sum(p.size for p in parts), any(p.bad for p in parts)
        out.counts = Counter()
        for p in parts:
            out.counts.update(p.counts)
        if out.size > MOST_COUNTED:  # only shares matter
            out.counts = Counter({c: n // 2 or 1 for c, n in out.counts.items()})
            out.size = out.counts.total()
        return out

    def spans(self) -> Iterator[tuple[int, int]]:
        """The literals that it is made of and that haven't been given yet."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                if v.parts:
                    todo += reversed(v.parts)
                else:
                    yield v.span

    def score(self) -> float:
        """How much it looks like a credential: length, kinds of characters, entropy."""
        n = self.size
        if n < 6 or (self.text or "").lower() in PLACEHOLDERS or len(self.counts) < 4 or self.bad:
            return 0.0
        kinds = {_kind_of(c) for c in self.counts} - {""}
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        score = 0.25 * min(len(kinds), 3) / 3 + 0.45 * min(bits / 3.5, 1) + 0.3 * min(n / 12, 1)
        return score if self.quoted or len(kinds) >= 2 and "digit" in kinds else 0.3 * score


def _kind_of(c: str) -> str:
    if c.isascii() and c.isalnum():
        return "digit" if c.isdigit() else "lower" if c.islower() else "upper"
    return "" if c.isspace() else "other"


def stated(text: str) -> Iterator[tuple[int, str, Value]]:
    """(position, name, literal) of what is assigned without a sign between: elements with plain content, attributes called
    name or key with one called value in the same tag, definitions, calls of setters, and flags of a command line."""

    def found(m: re.Match, name: int, *values: int) -> tuple[int, str, Value]:
        v = next(x for x in values if m[x] is not None)
        return m.start(v), m[name], Value(m[v], *m.span(v), v != values[-1] or len(values) == 1)

    if "<" in text:
        for m in ELEMENT.finditer(text):
            yield found(m, 1, 2)
        for tag in TAG.finditer(text):
            held: dict[str, tuple[str, int, int]] = {}
            for m in ATTRIBUTE.finditer(text, *tag.span()):
                v = 2 if m[2] is not None else 3
                held.setdefault(m[1].lower(), (m[v], *m.span(v)))
            name = held.get("name") or held.get("key")
            if name and "value" in held:
                v, start, end = held["value"]
                yield start, name[0], Value(v, start, end, True)
    if "define" in text:
        for m in DEFINE.finditer(text):
            yield found(m, 1, 3)
    if "(" in text:
        for m in SETTER.finditer(text):
            yield found(m, 1, 3)
    if "--" in text:
        for m in FLAG.finditer(text):
            yield found(m, 1, 3, 4)


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each assignment, in order; a name in a value stands for its literals.

    Of a value with quoted and unknown parts the quoted ones count."""
    known: dict[str, Value] = {}
    from_ = 0
    for op in OPERATOR.finditer(text):
        if op[0] in ("==", "!=", "<=", ">=") or op.start() < from_:
            continue
        end = op.start()
        while end > from_ and text[end - 1] in " \t\"'`])":
            end -= 1
        start = end
        while start > from_ and text[start - 1] in NAME_CHARS:
            start -= 1
        name = text[start:end].strip(".-")
        from_ = op.end()
        if not name or name[0].isdigit():
            continue
        at, parts, whole = op.end(), [], True
        while at < len(text) and text[at] in " \t":
            at += 1
        over = NEXT_LINE.match(text, at)
        if over:
            at = over.end()
        while at < len(text):
            prefix = PREFIX.match(text, at)
            at = prefix.end() if prefix else at
            q = QUOTED.get(text[at])
            m = (LONG_QUOTED.match(text, at) or q.match(text, at)) if q else BARE.match(text, at)
            if not m:
                break
            if q and (text[at] == "`" or prefix and "f" in prefix[0].lower()) and FIELD.search(m["body"]):
                parts += [known[f] for f in FIELD.findall(m["body"]) if f in known]  # what it is put together of
                whole = False
                at = m.end()
                break
            if q:
                parts.append(Value(m["body"], *m.span("body"), True))
            elif IDENTIFIER.match(m[0]) and m[0] in known:
                parts.append(known[m[0]])
            else:
                parts.append(Value(m[0], m.start(), m.end(), False))
            at = m.end()
            if q and CALL.match(text, at):
                whole = False
                break
            if not q and m[0][-1] in "+." and text[at : at + 1] in QUOTED:  # a name joined to a literal without a blank
                continue
            more = JOINER.match(text, at) or (AGAIN.match(text, at) if q and over and over[0][0] in "([" else None)
            if not more:
                break
            at = more.end()
        if parts:
            literals = [p for p in parts if p.quoted]
            whole = whole and parts[-1].quoted
            known[name] = value = Value.joined(literals or parts)
            if literals or not value.parts:
                yield name, value
            from_ = max(from_, at) if whole else from_


def find_secrets(text: str) -> list[Span]:
    """Base spans, and the literals that the lexer finds under sensitive names outside them.

    Time and memory follow the text's length: values are shared, each literal is given once, and what is covered is
    marked by position."""
    out = base_spans(text)
    if not any(sign in text for sign in ("=", ":", "<", "(", "--", "define")):
        return out
    covered = bytearray(len(text))
    for _, a, b, _, _ in out:
        covered[a:b] = b"\1" * (b - a)
    for name, value in chain(assignments(text), ((n, v) for _, n, v in stated(text))):
        target = name_score(name)
        if target and (score := target * value.score()) >= LEAST_SCORE:
            for a, b in value.spans():
                if b > a and covered.find(1, a, b) < 0:
                    out.append(("lexed", a, b, False, round(score, 6)))
                    covered[a:b] = b"\1" * (b - a)
    return out


def scan_secrets(docs: DataFrame, name: str = "spans") -> DataFrame:
    """Add ``name``: the secrets in each whole text, an array of (kind, start, end, base, score) by start, then kind.

    Kinds assign, access and hex are base patterns; ``lexed`` spans are literals that the lexer adds outside them. A null
    or empty text has no spans; repeated rows get equal results; an empty table stays empty; a column called ``name`` is
    replaced, others stay. Texts are read where they are, without a shuffle; memory follows the longest text."""
    return scan(docs, find_secrets, KINDS, name)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``; cases as scan_secrets() says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan_secrets(docs), BASE_KINDS)
