import random
import re
import time

import numpy as np

from paperloom.llm import pii, secrets
from paperloom.llm.spans import digest

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_secrets(x):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def plain_pii(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) < 256 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15])


def noise(alphabet, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(n)]


def test_base_rules():
    for x in [*noise(["token", "pass", "word", "=", ":", '"', " ", "abc", "AKIA", "0f", "9", "é"], 2000, 1), "ſecret=abcdefgh", "password=token:abcdefg"]:
        assert plain_secrets(x) == sorted(s[:3] for s in secrets.find_secrets(x) if s[3]), x
    for x in [*noise("ab@.-+0123456789() %_é\n", 3000, 2), "a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8"]:
        assert plain_pii(x) == sorted(s[:3] for s in pii.base_spans(x)), x


def test_lexer_adds_literals():
    added = lambda t: [t[s[1] : s[2]] for s in secrets.find_secrets(t) if not s[3]]
    assert added('const key = "aB3$dE5fG7hI";\nclientSecret = key') == ["aB3$dE5fG7hI"]
    assert added('a = "abcd"\nprivate_key = a + "EF12zz"') == ["abcd", "EF12zz"]
    assert added('{"api-key": "9f8a7b6c5d4e"}') == ["9f8a7b6c5d4e"]
    assert added("The secret: the end. Token: one") == []
    assert added('password == "abcdefgh1"') == []


def test_lexer_keeps_literals_beside_unknown_parts():
    added = lambda t: [t[s[1] : s[2]] for s in secrets.find_secrets(t) if not s[3]]
    assert added('signing_key = "aB3$dE5fG7hI9x".encode()') == ["aB3$dE5fG7hI9x"]
    assert added('private_key = "aB3$dE5fG7hI9x" + suffix') == ["aB3$dE5fG7hI9x"]
    assert added('private_key = prefix + "aB3$dE5fG7hI9x"') == ["aB3$dE5fG7hI9x"]
    assert added("private_key = prefix+'aB3$dE5fG7hI9x'+suffix") == ["aB3$dE5fG7hI9x"]
    assert added('credentials: "abc123XYZ789". Next one') == ["abc123XYZ789"]
    assert added('k = "aB3$dE5fG7hI9x" + suffix\nsigning_key = k') == ["aB3$dE5fG7hI9x"]
    assert added('note = "private_key=abc123XYZ789".strip()') == ["abc123XYZ789"]
    assert added("signing_key = prefix + suffix") == []


def test_field_carries_labels():
    seen = ["call +1 (743) 555-3824 now", "mail a.b@mail.example.com", "host 10.2.3.4 and 10.2.3.4", "card 4465758382889437", "in 2024 of 1234"] * 20
    find = pii.finder(pii.train(seen))
    t = "call +1 (743) 555-3824 or 743-555-3824, order 12345"
    assert [t[s[1] : s[2]] for s in find(t) if not s[3]] == ["743-555-3824"]
    assert find("nothing at all") == [] and find("page 12 of 345, 2021") == []


def test_a_label_reaches_all_mentions_of_a_long_document():
    find = pii.finder(pii.Crf(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 4.0))  # mentions have no belief of their own
    gap = " and some more words that say nothing about it at all, as long texts have many of them, "
    later = [gap + "743-555-3824" for _ in range(29)]
    for t in ["call +1 (743) 555-3824" + "".join(later), "".join(later) + gap + "call +1 (743) 555-3824"]:
        got = [s for s in find(t) if not s[3]]
        assert [t[s[1] : s[2]] for s in got] == ["743-555-3824"] * 29
        nodes = pii.candidates(t, pii.base_spans(t))
        assert len(pii.observed_edges(nodes)) == 29
    r = random.Random(4)
    keys = ["".join(r.choice("12") for _ in range(r.randint(8, 13))) for _ in range(200)] + ["a@b", "a@b.c", "a@b.c.d", "a.b@c", "a@bc.d"]
    for a in keys:
        for b in keys:
            assert pii.similar(a, b) == (a == b or a in pii.forms(b) or b in pii.forms(a)), (a, b)


def test_rows(odd_docs, no_docs):
    out = secrets.scan_secrets(odd_docs, "found")
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "found"]
    rows = digest(secrets.scan_secrets(odd_docs), secrets.BASE_KINDS).collect()
    assert {r.spans for r in rows} == {""}
    crf = pii.fit(odd_docs)
    assert pii.scan_pii(odd_docs, crf).count() == odd_docs.count()
    assert pii.scan_pii(no_docs, pii.fit(no_docs)).count() == 0
    d = odd_docs.sparkSession.createDataFrame([(1, 'é token = "abc123def"')], "doc_id long, text string")
    r = digest(secrets.scan_secrets(d), secrets.BASE_KINDS).first()
    assert (r.n_assign, r.spans) == (1, "assign:2:20")


def test_values_that_grow_are_shared():
    """Doubled, crossed, cyclic and growing constants take neither memory nor time beyond the text's own."""
    began = time.time()
    texts = [
        'a = "aB3$dE5fG7hI"\n' + "a = a + a\n" * 100 + "secret_key = a", "a = b\nb = a\n" * 5000,
        'a = "aB3$dE5fG7hI"\nb = "q"\n' + "a = a + b\nb = b + a\n" * 5000 + "secret_key = a",
        "".join(f'private_key_{i} = "aB3$dE5f{i}"\n' for i in range(10_000)),
    ]
    assert [sum(not s[3] for s in secrets.find_secrets(t)) for t in texts] == [1, 0, 2, 10_000]
    assert time.time() - began < 20


def test_lexer_reads_markup_and_long_quotes():
    added = lambda t: [t[s[1] : s[2]] for s in secrets.find_secrets(t) if not s[3]]
    assert added("<password>aB3$dE5fG7hI</password> <title>aB3$dE5fG7hI</title>") == ["aB3$dE5fG7hI"]
    assert added('<add key="db.pwd" value="aB3dE5fG7hI9"/>') == ["aB3dE5fG7hI9"]
    assert added('private_key = """aB3$dE5"fG7hI9x"""') == ['aB3$dE5"fG7hI9x']


def test_planted_documents():
    """Texts with one kind each, in base and in unclear form; clean ones get no span."""
    seen = ["call +1 (743) 555-3824 now", "mail a.b@mail.example.com", "host 10.2.3.4", "card 4465758382889437", "in 2024 of 1234"] * 30
    find = pii.finder(pii.train(seen))
    fill = "plain words of no weight stand here, as in most texts. " * 4
    planted = {
        "email": ["x.y@mail.example.org", "write to x.y@mail.example.org or x.y@mail.example"], "ip": ["from 192.168.77.1 today"],
        "card": ["paid with 4465 7583 8288 9437"], "phone": ["ring +49 (30) 555-22801", "ring (743) 555-3824 or +1 (743) 555-3824"],
    }
    for kind, texts in planted.items():
        for t in texts:
            got = find(fill + t + " " + fill)
            assert {s[0] for s in got} == {kind} and len(got) == (2 if " or " in t else 1), (t, got)
    for t in ["on 2024-01-31 at 10:30", "pages 100-120 of 3", "version 1.22.333 build 20240131", "isbn 9780306406157 at @home", fill]:
        assert not find(fill + t + " " + fill), t


def test_pii_work_follows_length():
    find = pii.finder(pii.Crf(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 4.0))
    began = time.time()
    for t in ["a@b " * 8000, "".join(f"u{i}@b.com u{i}@b " for i in range(4000)), "".join(f"(743) 555-{i:04} x " for i in range(4000))]:
        find(t)
    assert time.time() - began < 30
