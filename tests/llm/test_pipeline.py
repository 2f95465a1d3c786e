import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from paperloom.llm import bpe

LINE_ENDS = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def deduped(was):
    """Texts without the lines that ten documents or more share."""
    key = lambda x: lower(x.strip(LINE_ENDS))
    n = Counter(k for t in was.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or n[key(x)] < 10) for i, t in was.items()}


def first_of_groups(was):
    """Ids of the smallest of each group of texts whose sets of five-word shingles are linked."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for i, t in was.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    held: dict = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    root = {i: i for i in was}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i for i in was if top(i) == i}


def cleaned(was, items):
    """Texts without the passages of ten words of a test item; None where they are most of the text."""
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    windows = {}
    for t in items:
        ws = [lower(w) for w in word.findall(t or "")]
        m = min(10, len(ws))
        windows.setdefault(m, set()).update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1) if m)
    out = {}
    for i, t in was.items():
        at = [m.span() for m in word.finditer(t or "")]
        ws = [lower(t[a:b]) for a, b in at]
        hit = {k for m, own in windows.items() if m for j in range(len(ws) - m + 1) if tuple(ws[j : j + m]) in own for k in range(j, j + m)}
        runs = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
        rest, last = "", 0
        for a, b in zip(*runs, strict=True):
            rest, last = rest + t[last : at[a][0]], at[b][1]
        out[i] = None if len(hit) > 0.5 * len(ws) else (t if not hit else rest + t[last:])
    return out


def test_stages(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    lib = Tokenizer.from_file(bpe.default_path())
    before = docs
    for name, stage in p.STAGES:
        after = p.cut(stage(spark, before, sf_dir), name)
        was = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        got = {r.doc_id: r for r in after.collect()}
        assert got.keys() <= was.keys() and len(got) == after.count()
        if name != "bpe":
            assert after.columns == docs.columns
            assert after.where("n_chars <> char_length(text)").count() == 0 or name in ("language_id", "near_dedup")
        texts = {i: r.text for i, r in got.items()} if name != "bpe" else {}
        if name == "language_id":
            assert len(got) > 0.95 * len(was) and all(texts[i] == was[i] for i in texts)
            assert all(any(c.isalpha() for c in t) for t in texts.values())
        elif name == "line_dedup":
            assert texts == deduped(was)
        elif name == "near_dedup":
            assert texts.keys() == first_of_groups(was) and all(texts[i] == was[i] for i in texts)
        elif name == "decontaminate":
            want = cleaned(was, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
            assert texts == {i: t for i, t in want.items() if t is not None}
        else:
            for i, r in got.items():
                ids = lib.encode(was[i] or "", add_special_tokens=False).ids
                assert (bytes(r.ids), r.decoded) == (np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False))
        before = after


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in p.STAGES:
        after = p.cut(stage(spark, docs, sf_dir), name)
        if name != "bpe":
            assert after.columns == odd_docs.columns
        docs = after
    ids = sorted(str(r.doc_id) for r in docs.collect())
    assert ids == ["3", "4", "6", "None"]  # 1, 2 and 5 have no letter; one of the repeated rows of 3 stays
    docs = no_docs
    for name, stage in p.STAGES:
        docs = p.cut(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_cuts_are_removed(spark):
    from paperloom.llm import common

    df = p.cut(spark.range(3))
    assert df.agg(F.sum("id")).first()[0] == 3
    path = common._CUTS[-1]
    common.clear_cuts(spark)
    assert not common._CUTS
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
