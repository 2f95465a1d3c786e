"""Exact dedup against a plain dictionary of texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm.exact_dedup import drop_exact_duplicates, exact_groups


def by_length(text):
    """A digest that many texts share."""
    return F.hex(F.char_length(text)).cast("binary")


def brute(rows, normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    out = []
    for i, t in rows:
        t = normal(t or "")
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    hot = [(i, "the same words again") for i in range(1000, 1150)]
    near = [(i, f"text {i % 40} ") for i in range(200)]
    odd = [(None, "lost"), (None, "lost"), (None, "text 3 "), (7001, None), (7002, ""), (7003, "x" * 300_000), (7004, "x" * 300_000), (7005, "X" * 300_000)]
    again = [(7010, "one id")] * 5 + [(7010, "another text"), (None, None)]
    return hot + near + odd + again


@pytest.mark.parametrize("heavy", [2, 1024])
@pytest.mark.parametrize("digest", [None, by_length])
def test_groups_equal_brute_force(spark, digest, heavy):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    more = {"digest": digest} if digest else {}
    got = exact_groups(docs, heavy_keys=heavy, salts=3, **more).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_normalised_texts(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "ab"), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_groups(docs, normal=lambda t: F.trim(F.lower(t))).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, lambda t: t.lower().strip())


@pytest.mark.parametrize("more", [{}, {"digest": by_length}])
def test_one_row_of_each_text_stays(spark, more):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, n, n % 3) for n, r in enumerate(rows)], "doc_id long, text string, n long, kept int")
    got = drop_exact_duplicates(docs, salts=3, **more)
    assert got.columns == docs.columns
    got = got.collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(-1 if i is None else i)
    assert sorted((r["text"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == sorted((t, max(i)) for t, i in ids.items())
    assert all(rows[r["n"]][0] == r["doc_id"] and (rows[r["n"]][1] or "") == r["text"] for r in got)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted([tuple(r) for r in exact_groups(odd_docs).collect()], key=repr) == brute(rows)
    assert drop_exact_duplicates(odd_docs).count() == len({t or "" for _, t in rows})
    assert exact_groups(no_docs).count() == drop_exact_duplicates(no_docs).count() == 0
    nothing = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [tuple(r)[:4] for r in exact_groups(nothing).collect()] == [(None, None, 3, True)] * 3
