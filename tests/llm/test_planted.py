"""Planted secrets and personal data in unclear forms, clean texts beside them, and repeated ids and rows."""

import random

import pytest

from paperloom.llm import language_id, pii, secrets, setsketch

FILL = "Plain words of no weight stand here, as most texts have them; nothing in them (or beside them) is secret. "


def literal(dice):
    return "".join(dice.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNP23456789!$#%") for _ in range(dice.randint(12, 24))) + "7Kx"


FORMS = [
    'private_key = "{}"', "signing_key:\n    '{}'", 'db_pwd = (\n  "{}"\n)', '#define API_PWD "{}"', 'client.setPassphrase("{}")',
    "deploy --pwd {} --now", "export PGPASS='{}'", "<pwd>{}</pwd>", '<add key="db.pwd" value="{}"/>', "<add name='x.credential' other='1' value='{}'/>",
    'base = "{}"\naccess_key = f"{{base}}"', "credentials = `{}`", 'my_passphrase = unknown + "{}"', 'accountKey := "{}"', '"privateKey": "{}",',
]
CLEAN = [
    "print('Hello9World7abc')", 'title = "Chapter12Section9x"', "--output report2024final.txt", '#define VERSION "2.31.0-beta4"', 'setTitle("Draft9of12Pages")',
    "<add key='theme' value='Dark9Mode12x'/>", "compass = North42xyzAB", "<name>Zx9kLm2Qp7r</name>", 'f"{a}{b}"', "see (https://x.org/a?b=c9D8e7F6)",
    "key words: alpha9beta8gamma7", 'url = "https://x.org/Zx9kLm2Qp7r"',
]


def test_secrets_are_found_in_their_forms_and_not_elsewhere():
    dice = random.Random(11)
    found = total = 0
    for form in FORMS:
        hit = 0
        for _ in range(20):
            value = literal(dice)
            text = FILL + "\n" + form.format(value) + "\n" + FILL
            added = [text[s[1] : s[2]] for s in secrets.find_secrets(text) if not s[3]]
            hit += added == [value]
        assert hit >= 16, (form, hit)
        found, total = found + hit, total + 20
    assert found >= 0.95 * total
    for text in CLEAN:
        assert secrets.find_secrets(FILL + "\n" + text + "\n" + FILL) == [], text


def test_tags_of_any_length():
    far = " ".join(f'a{i}="{i}"' for i in range(3000))
    for text in (f'<add key="ApiPassword" {far} value="Zx9!kLm2Qp7r"/>', f'<add value="Zx9!kLm2Qp7r" {far} key="ApiPassword"/>'):
        assert [text[s[1] : s[2]] for s in secrets.find_secrets(text)] == ["Zx9!kLm2Qp7r"]


@pytest.mark.parametrize("text", ["<" * 200_000, "<a " + "b" * 200_000, "--a" * 100_000, "set(" * 60_000, 'a = ("b"\n' * 30_000, "#define " * 40_000, "x=`{" * 40_000])
def test_work_follows_length(text):
    secrets.find_secrets(text)


def card(dice):
    digits = [4] + [dice.randint(0, 9) for _ in range(14)]
    return next(n for n in ("".join(map(str, [*digits, c])) for c in range(10)) if pii.luhn(n))


def test_personal_data_side_by_side():
    dice = random.Random(3)
    find = pii.finder(pii.train([f"card {card(dice)} and 10.2.3.4", "call +1 (743) 555-3824", "in 2024 of 1234"] * 20))
    for _ in range(50):
        a, b = card(dice), card(dice)
        four = " ".join(b[i : i + 4] for i in range(0, 16, 4))
        for text, want in ((f"{a} {b}", [a, b]), (f"{a} {a}", [a, a]), (f"{a} {four}", [a, b]), (f"{four} {four}", [b, b])):
            got = [(FILL + text)[s[1] : s[2]].replace(" ", "") for s in find(FILL + text) if s[0] == "card"]
            assert got == want, text
    assert {s[0] for s in find(FILL + f"{card(dice)} 2024 77")} <= {"card"}
    for clean in ("1 22 333 4444 55555 666666 7777777 88888888", "1234 5678 1234 5679 1234 5678 1234 5679 11", "20240101 20240102 20240103 20240104"):
        assert find(FILL + clean) == [], clean


def test_unlike_texts_of_one_id_all_stay(spark):
    long = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [
        (1, long("a")), (1, long("b")), (1, long("a")), (2, long("b") + " more"), (3, long("c")), (3, long("a") + " x"), (None, long("c")), (4, None), (4, None),
        (5, ""), (6, long("d")),
    ]
    docs = spark.createDataFrame([(*r, n, "z") for n, r in enumerate(rows)], "doc_id long, text string, n int, size string")
    got = setsketch.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or -1, r.text or "") for r in got.collect())
    assert kept == sorted([(1, long("a")), (1, long("b")), (3, long("c")), (-1, long("c")), (4, ""), (4, ""), (5, ""), (6, long("d"))])


def test_a_language_of_copies_is_learnt_from_its_other_texts(spark):
    dice = random.Random(1)
    words = {"en": "the of and to in is that was for it".split(), "de": "der die und in den von zu das mit sich".split()}
    text = lambda k: " ".join(dice.choice(words[k]) for _ in range(30))
    rows = [(-1, text("en"), "en")] * 4000 + [(i, text("en"), "en") for i in range(200)] + [(1000 + i, text("de"), "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    held = []
    real, language_id.train = language_id.train, lambda texts, langs: held.extend(langs) or real(texts, langs)
    try:
        language_id.fit(docs, 200)
    finally:
        language_id.train = real
    assert held.count("en") == held.count("de") == 100


def test_many_languages_are_all_learnt(spark):
    rows = [(i * 4 + j, f"word{i} " * 5, f"l{i}") for i in range(250) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, 300).langs) > 200
