import random
import re

from paperloom.llm.decontaminate import decontaminate, find_leaks

W = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in W.findall(t or "")]


def brute(text, items, n):
    ws, hit, met = fold(text), set(), set()
    for i, t in items:
        own = fold(t)
        m = min(n, len(own))
        wins = {tuple(own[j : j + m]) for j in range(len(own) - m + 1)} if own else set()
        for j in range(len(ws) - m + 1 if m else 0):
            if tuple(ws[j : j + m]) in wins:
                hit.update(range(j, j + m))
                met.add(i)
    return len(ws), len(hit), sorted(met)


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["a", "b", "Cé", "d"]
    items = [(str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(12)]
    docs = [(i, "".join(r.choice(words) + r.choice(" ,\n") for _ in range(r.randint(0, 60)))) for i in range(60)]
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for part_words in (500_000, 10):
        got = {x.doc_id: (x.n_words, x.n_hit, x.item_ids) for x in find_leaks(d, b, 5, part_words).collect()}
        assert got == {i: brute(t, items, 5) for i, t in docs}


def test_removal_and_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (None, "ñandú 😀")], "item_id long, text string")
    got = decontaminate(odd_docs, b)
    assert got.columns == odd_docs.columns
    assert sorted(str(x.doc_id) for x in got.collect()) == ["1", "2", "4", "5", "6", "None"]  # 3 is nothing but the item
    text = {x.doc_id: x.text for x in got.collect()}
    assert text[6] == "日本語  Ünïcode" and text[1] is None
    assert decontaminate(no_docs, b).count() == 0
    assert find_leaks(odd_docs, b.limit(0)).where("n_hit > 0").count() == 0
