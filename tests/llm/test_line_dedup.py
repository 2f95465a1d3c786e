from collections import Counter

from paperloom.llm.line_dedup import BLANKS, dedup_lines


def brute(rows, min_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    n = Counter(k for d, t in set(rows) for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(d, "\n".join(x for x in (t or "").split("\n") if n[key(x)] < min_docs or not key(x))) for d, t in rows]


def test_against_brute_force(spark):
    rows = [(i, f"Shared LINE \nown {i}\n\n  shared line\nÉtat {i % 2}") for i in range(6)] + [(9, None), (10, "")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows, 3))
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got}[0] == (5, 3)
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got}[9] == (1, 0)


def test_odd_rows_and_columns(odd_docs, no_docs):
    out = dedup_lines(odd_docs, min_docs=2)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert out.count() == odd_docs.count()
    assert dedup_lines(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = dedup_lines(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
