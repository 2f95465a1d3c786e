"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from paperloom.llm.prefix_trie import prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=20, shared=4):
    convs = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % shared
        seq = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, sums = defaultdict(int), {}
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        a, b = sums.get(p, (0, 0))
        sums[p] = (a + (not children[p]), b + (len(members[p]) - 1) * words)
        if p:
            a, b = sums.get(p[:-1], (0, 0))
            sums[p[:-1]] = (a + sums[p][0], b + sums[p][1])
    out = []
    for p, ms in members.items():
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), children[p], *sums[p], sha))
    return sorted(out, key=repr)


def check(spark, rows, **how):
    got = prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def chats(seed):
    dice = random.Random(seed)
    texts = ["hello there", "a b  c", "", None, "yes", "no no"]
    rows = []
    for c in [*range(0, 90), 100, 2001, 5000, 5003]:
        head = [("system", "be kind")] * dice.randint(0, 2)
        rows += [(c, n, r, x) for n, (r, x) in enumerate(head + [(dice.choice(["user", "bot", None]), dice.choice(texts)) for _ in range(dice.randint(0, 4))])]
    return rows


@pytest.mark.parametrize(("stretch", "heavy"), [(512, 1024), (2, 2)])
def test_nodes_equal_brute_force(spark, stretch, heavy):
    check(spark, chats(3), stretch=stretch, heavy_keys=heavy)


def test_odd_turns(spark):
    rows = [
        (None, 0, "user", "of nobody"), (20, None, None, None), (20, None, "a", "b"), (20, 0, "a", "b"), (20, 0, "a", "b"), (20, 0, "a", "a"),
        (21, 5, "u", "x" * 200_000), (22, -1, "ab", ""), (23, 1, "a", "b"), (25, 1, "", "ab"), (-7, 1, "u", "below zero"), (-20, 1, "u", "ten"),
    ]
    check(spark, rows)


def test_long_and_hot_conversations(spark):
    deep = [(40, n, "user", f"line {n}") for n in range(150)]
    copies = [(41 + k, n, "user", f"line {n}") for k in range(6) for n in range(60)]
    hot = [(81, None, "user", "again")] * 70
    check(spark, deep + copies + hot, stretch=16, heavy_keys=3)


def test_no_turns(spark):
    assert prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 1, "u", "x", 3, 4, "q")], f"{SCHEMA}, depth long, a long, place string")
    assert [tuple(r)[:7] for r in prefix_nodes(clash).collect()] == [r[:7] for r in brute([(1, 1, "u", "x")])]
