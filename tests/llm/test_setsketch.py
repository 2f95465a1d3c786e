import random
import re

import numpy as np

from paperloom.llm import setsketch as s


def plain_set(text, k):
    """The shingles of a text as tuples of words, without the operator's code."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows, k):
    sets = {i: plain_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and alike(sets[i], sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for _ in range(r.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    hot = [word() for _ in range(100)]
    for _ in range(90):  # one large group of near copies, chained
        own = list(hot)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = word()
        out.append(" ".join(own))
    out += [None, "", "one two", "one two", "ONE two", "one two three four"]
    r.shuffle(out)
    return list(enumerate(out))


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "SMALL_BUCKET", 8)  # both ways of exact comparison take part
    monkeypatch.setattr(s, "BLOCK_ROWS", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.near_duplicates(docs, k=4).collect()
    want = brute(rows, 4)
    monkeypatch.setattr(s, "SMALL_BUCKET", 1_000)  # one way alone, and fewer turns, find the same
    assert {r.doc_id: r.component_id for r in s.near_duplicates(docs, k=4, turns=1).collect()} == want
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(plain_set(t, 4)) for i, t in rows}


def test_estimate_and_merge():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64))])
    x, y = s.registers(a), s.registers(b)
    j = s.estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(j - 2 / 3) < 0.15
    assert (np.maximum(s.registers(a[:500]), s.registers(a[500:])) == x).all()


def test_odd_rows(odd_docs, no_docs):
    got = s.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[1].kept and by[None].component_id is None and by[None].kept
    kept = s.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1  # one repeated row goes
    assert s.near_duplicates(no_docs).count() == 0
