"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from paperloom.llm.resample import column_sums, count_blocks, importance_ranks, resample

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, run):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(A_Z))
    return words, [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, buckets, run, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in grams(t, run)[1])
    t = Counter(bucket(f) for x in target for f in grams(x, run)[1])
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for i, x in rows:
        words, own = grams(x, run)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


ROWS = [(i, " ".join(f"w{(i * j) % 53}" for j in range(5 + i % 40))) for i in range(300)]
ROWS += [(500, ROWS[7][1])] * 40 + [(None, ROWS[9][1] + " tail" * 30)] * 3 + [(501, None), (502, ""), (503, "ÀB çé Zz 日本 x_y!"), (504, "w1 w2 " * 60_000)]
TARGET = ["w1 W2 w3, w4 w5", "w7-w8 w1", None, "", "çé 日本"]


@pytest.mark.parametrize(("buckets", "run", "min_words", "percent"), [(10_000, 1, 20, 10), (97, 3, 8, 55)])
def test_ranks_equal_brute_force(spark, buckets, run, min_words, percent):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance_ranks(docs, target, buckets, run, min_words, percent).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(ROWS, TARGET, buckets, run, min_words, percent)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(*r, n, -1) for n, r in enumerate(ROWS)], "doc_id long, text string, score long, rank int")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample(docs, target, percent=20).collect()
    want = sorted((r[4], r[0]) for r in brute(ROWS, TARGET, 10_000, 1, 20, 20) if r[4])
    assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert all(ROWS[r["score"]] == (r["doc_id"], r["text"]) for r in got)
    assert len({r["score"] for r in got}) == len(got)


def test_blocks_hold_all_counts(spark):
    docs = spark.createDataFrame(ROWS, "id long, text string").repartition(3)
    blocks = count_blocks(docs, 31)
    held = Counter()
    for r in blocks.collect():
        assert len(r["starts"]) == len(r["ids"]) + 1 and r["starts"][-1] == len(r["buckets"]) == len(r["counts"])
        held.update(r["ids"])
    assert held == Counter(i for i, _ in ROWS)
    assert column_sums(blocks, 31).sum() == sum(len(grams(t, 1)[1]) for _, t in ROWS)


def test_blocks_stay_small_whatever_the_documents_are(spark):
    wide = [(i, " ".join(f"w{i * 7 + j}" for j in range(900))) for i in range(200)]
    for r in count_blocks(spark.createDataFrame(wide, "id long, text string").coalesce(1)).collect():
        assert r["starts"][-2] < 1024  # a block ends with the document that reaches so many entries


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = importance_ranks(odd_docs, no_docs, min_words=1, percent=50).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, [], 10_000, 1, 1, 50)
    assert importance_ranks(no_docs, odd_docs).count() == resample(no_docs, no_docs).count() == 0
