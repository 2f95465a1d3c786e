"""Small cases of the review-domain operators, with results worked out by hand."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import pii, text
from paperloom.operators import audit, context, evaluate, latest, layout, listing, search, stats, tree, vectors


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_latest_takes_the_last_row_of_each_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d")], "k int, o int, v string")
    assert rows(latest.latest(df, ["k"], ["o"]), "k", "v") == sorted([(1, "b"), (2, "c"), (None, "d")], key=str)


def test_last_n_come_in_ascending_order(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "k int, o int")
    assert rows(latest.last_n_in_order(df, ["k"], ["o"], 2), "o", "rn") == [(3, 1), (4, 2)]


def test_versions_are_bumped_by_part(spark):
    df = spark.createDataFrame(
        [(1, "1.2.3", "major"), (2, "1.2.3", "minor"), (3, "1.2", "patch"), (4, None, "patch")], "i int, v string, p string"
    )
    out = df.select("i", latest.bumped(F.col("v"), F.col("p")).alias("n"))
    assert rows(out, "i", "n") == [(1, "2.0.0"), (2, "1.3.0"), (3, "1.2.1"), (4, "1.0.0")]


def test_islands_merge_at_the_gap(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 9.0, 9.5)], "k int, a double, b double")
    assert rows(latest.islands(df, ["k"], "a", "b", 1.0), "a", "b", "n") == [(0.0, 3.0, 2), (9.0, 9.5, 1)]


def test_paging_and_empty_lists(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, v int")
    assert [r.id for r in listing.page(listing.ordered(df, "v", "desc"), 1, 2).collect()] == [3, 5]
    assert listing.in_list(df, "id", []).count() == 0
    assert listing.optional(df, v=0).count() == 6
    assert listing.both_bounds(df, "id", 1, None).count() == 6


def test_conflicts_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, k string")
    assert rows(listing.conflicts(df, df, ["k"]), "id") == [(1,), (2,)]


def test_soft_delete_leaves_deleted_rows_as_they_are(spark):
    df = spark.createDataFrame([(1, None, None), (2, "old", "x"), (3, None, None)], "id int, deleted_at string, deleted_by string")
    out = listing.soft_delete(df, spark.createDataFrame([(1,), (2,)], "id int"), "id", F.lit("now"), F.lit("me"))
    assert rows(out, "id", "deleted_at", "deleted_by") == [(1, "now", "me"), (2, "old", "x"), (3, None, None)]


def test_prefix_search_needs_every_term(spark):
    df = spark.createDataFrame([(1, "Graph theory"), (2, "graphs"), (3, None)], "id int, t string")
    assert rows(search.search(df, ["t"], "gra & the"), "id") == [(1,)]
    assert rows(search.search(df, ["t"], " | "), "id") == [(1,), (2,), (3,)]
    assert rows(search.search_postings(search.postings(df, "id", ["t"]), "id", "graph"), "id") == [(1,), (2,)]


def test_nested_trees_keep_parents_without_children(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    c = spark.createDataFrame([(9, 1, "y"), (8, 1, "x")], "cid int, pid int, title string")
    out = tree.nest(p, c, "id", "pid", "title", "kids")
    assert {r.id: [k.title for k in r.kids] for r in out.collect()} == {1: ["x", "y"], 2: []}


def test_knn_is_exact_within_its_source(spark):
    c = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [1.0, 1.0]), (3, "t", [1.0, 0.0]), (4, "s", [0.0, 0.0])], "chunk_id int, source string, embedding array<double>")
    q = spark.createDataFrame([(7, "s", [1.0, 0.1])], "query_id int, source string, vector array<double>")
    assert rows(vectors.knn(q, c, 5), "chunk_id", "rank") == [(1, 1), (2, 2)]


def test_knn_leaves_unsound_vectors_out_and_keeps_columns(spark):
    nan, far = float("nan"), float("inf")
    held = [("b", "s", [1.0, 0.0], "x"), ("a", "s", [2.0, 0.0], "y"), (None, "s", [3.0, 0.0], "n"), ("c", "s", None, "z"), ("d", "s", [1.0, None], "z"),
            ("e", "s", [nan, 1.0], "z"), ("f", "s", [1.0, far], "z"), ("g", "s", [1.0], "z"), ("h", "s", [], "z"), ("i", None, [1.0, 0.0], "z"), ("j", "only", [1.0, 0.0], "z")]
    c = spark.createDataFrame(held, "chunk_id string, source string, embedding array<double>, note string")
    asked = [(1, "s", [5.0, 0.0]), (2, "s", None), (3, "s", [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, "none", [1.0, 0.0]), (6, "s", [nan, 0.0]), (7, "s", [2.0])]
    q = spark.createDataFrame(asked, "query_id int, source string, vector array<double>")
    out = vectors.knn(q, c, 9)
    assert out.columns == ["source", "query_id", "chunk_id", "embedding", "note", "distance", "rank"]
    # nulls come first among equal distances, as in any ascending order of the engine
    assert rows(out, "query_id", "chunk_id", "note", "rank") == sorted([(1, None, "n", 1), (1, "a", "y", 2), (1, "b", "x", 3), (7, "g", "z", 1)], key=str)
    assert vectors.knn(q.limit(0), c, 3).count() == 0 and vectors.knn(q, c.limit(0), 3).count() == 0


def test_knn_equals_pairs_scored_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SLICE", 3)
    draw = np.random.default_rng(5)
    held = draw.normal(size=(12, 33))
    # a third of the rows are copies of one vector: their ties are settled by key in every block
    points = [(i, "hot" if i % 4 else "cold", (held[0] if i % 3 == 0 else held[draw.integers(12)] + draw.integers(3)).tolist()) for i in range(150)]
    c = spark.createDataFrame(points, "chunk_id int, source string, embedding array<float>")
    q = c.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), "source", F.col("embedding").alias("vector"))
    both = q.join(c, "source").withColumn("distance", 1 - vectors.cosine(F.col("vector"), F.col("embedding")))
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    want = both.withColumn("rank", F.row_number().over(w)).where("rank <= 7")
    names = ["query_id", "chunk_id", "rank", "distance"]
    assert rows(vectors.knn(q, c, 7), *names) == rows(want, *names)
    monkeypatch.setattr(vectors, "MOST_HOT", 0)
    assert rows(vectors.knn(q, c, 7), *names) == rows(want, *names)


def test_knn_deals_a_frequent_source_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    points = [(i, "hot" if i % 3 else f"s{i % 5}", [float(i * 7 % 11), float(i * 5 % 13) + 0.5]) for i in range(90)]
    c = spark.createDataFrame(points, "chunk_id int, source string, embedding array<double>")
    q = c.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("query_id"), "source", F.col("embedding").alias("vector"))
    out = vectors.knn(q, c, 4)
    size = lambda v: sum(x * x for x in v) ** 0.5
    far = lambda a, b: 1 - (a[0] * b[0] + a[1] * b[1]) / (size(a) * size(b))
    want = []
    for i, s, v in points[::2]:
        near = sorted((far(v, w), j) for j, o, w in points if o == s)[:4]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
    assert rows(out, "query_id", "chunk_id", "rank") == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" in plan and "__g" in plan


def test_neighbours_clamp_at_zero_and_dont_repeat(spark):
    c = spark.createDataFrame([("s", i) for i in range(6)], "source string, chunk_index int")
    h = spark.createDataFrame([("s", 0), ("s", 1), (None, 3)], "source string, chunk_index int")
    assert [r.chunk_index for r in vectors.neighbours(h, c).collect()] == [0, 1, 2, 3]


def test_asof_takes_the_last_section_before_the_middle(spark):
    s = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 100, "B")], "doc_id int, ord int, start int, section string")
    c = spark.createDataFrame([(1, 10, 20), (1, 95, 20), (1, 80, 20)], "doc_id int, start int, length int")
    assert rows(vectors.asof_sections(c, s), "start", "section") == [(10, "A"), (80, "A"), (95, "B")]


def test_context_shows_a_header_where_the_section_changes(spark):
    c = spark.createDataFrame(
        [(1, 0, "I", "a", "SECTION: I\n\nx"), (1, 1, "I", "b", "y"), (1, 2, None, "c", "z"), (1, 3, "M", None, " w ")],
        "k int, chunk_index int, section_title string, chunk_id string, text string",
    )
    assert context.context(c, ["k"]).first().context == (
        "## CONTEXTO DA SESSÃO: I\n[FONTE] chunk_id: a\nx[FONTE] chunk_id: b\ny\n\n---\n\n[FONTE] chunk_id: c\nz"
        "\n\n---\n\n## CONTEXTO DA SESSÃO: M\n[FONTE] chunk_id: unknown_id\n w"
    )


def test_audit_words(spark):
    df = spark.createDataFrame(
        [(1, "UPDATE", '{"status":"A","n":1}', '{"status":"B","n":1}'), (2, "CREATE", None, "{}"), (3, "UPDATE", '{"n":1}', '{"n":1}'),
         (4, "UPDATE", '{"l":[{"id":"1","name":"x"}]}', '{"l":[{"id":"2","name":"y"}]}')],
        "id int, action string, old_data string, new_data string",
    )
    assert rows(audit.audit_diff(df), "id", "description") == [
        (1, "Alterou Status de 'A' para 'B'"), (2, "Registro criado."), (3, "Salvo sem alterações."),
        (4, "Adicionou 'y' em L; Removeu 'x' de L"),
    ]
    more = spark.createDataFrame(
        [(1, "UPDATE", None, '{"a":1}'), (2, "UPDATE", '{"a":1}', "{}"),
         (3, "UPDATE", '{"history":[{"status":"PENDING"}],"is_active":true,"meta_info":{"x":1}}',
          '{"meta_info":{"x":2},"history":[{"status":"COMPLETED"}],"is_active":false,"z":null,"updated_at":3}'),
         (4, "UPDATE", '{"history":[],"name":"q"}', '{"history":[{"status":"ODD"}],"name":"true"}'), (5, "DELETE", "{}", None)],
        "id int, action string, old_data string, new_data string",
    )
    assert rows(audit.audit_diff(more), "id", "description") == [
        (1, "Registro alterado."), (2, "Registro alterado."),
        (3, "Meta info modificado; Moveu o documento da etapa 'Pendente' para 'Concluído'; Alterou Ativo de 'Sim' para 'Não'"),
        (4, "Moveu o documento da etapa 'Sem status' para 'ODD'; Alterou Nome de 'q' para 'true'"), (5, "Registro removido."),
    ]
    logs = audit.audit_rows(more.where("id = 5").withColumns({"record_id": F.lit(7), "user_id": F.lit(1)}), "documents", F.lit("now"))
    assert rows(logs, "table_name", "record_id", "description") == [("documents", "7", "Registro removido.")]


def test_evaluation_retries_then_says_so(spark):
    def fails(batch):
        raise ValueError("down")

    df = spark.createDataFrame([("1", "need terms", "these terms")], "branch_id string, requirement string, context string")
    bad = evaluate.evaluate(df, fails).first()
    assert (bad.fulfilled, bad.attempts, bad.feedback) == (None, 3, "not evaluated: down")
    assert evaluate.evaluate(df).first().attempts == 1


def test_layout_modes_and_tolerances(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (1, 3.0, 1), (1, 3.0, 2), (1, 2.0, 3)], "k int, v double, p int")
    assert rows(layout.first_mode(df, ["k"], "v", "p"), "k", "mode") == [(1, 2.0)]
    t = spark.createDataFrame([(1, 12.0, None)], "k int, font_size double, leading double")
    a = spark.createDataFrame([(1, 12.7, None)], "k int, font_size double, leading double")
    assert rows(layout.tolerance_checks(t, a, ["k"]), "criterion", "passed") == [("font_size", True), ("leading", True)]


def test_top_and_bottom_overlap_in_small_groups(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 4, 1), (1, 3, 2)], "k int, s int, o int")
    assert rows(stats.top_and_bottom(df, ["k"], "s", "o"), "s", "side", "place") == [
        (3, "bottom", 2), (4, "bottom", 1), (4, "top", 2), (5, "top", 1),
    ]


def test_recursive_chunks_keep_to_their_size():
    words = " ".join(f"word{i}" for i in range(400))
    parts = text.split_recursive(words, 100, 20)
    assert all(0 < len(p) <= 100 for p in parts)
    seen = [w for p in parts for w in p.split()]
    assert list(dict.fromkeys(seen)) == words.split()


def plain_pieces(whole: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """The published rule with lists of strings: parts keep the separator before them; short ones are merged, long ones cut."""
    at = next(i for i, s in enumerate(separators) if s in whole)
    first, *rest = whole.split(separators[at]) if separators[at] else whole
    parts = [p for p in [first, *[separators[at] + r for r in rest]] if p]
    groups: list[list[str]] = [[]]
    for p in parts:
        groups += [[p], []] if len(p) >= size and separators[at] else []
        groups[-1] += [] if len(p) >= size and separators[at] else [p]
    out = []
    for g in groups:
        if len(g) == 1 and len(g[0]) >= size and separators[at]:
            out += plain_pieces(g[0], size, overlap, separators[at + 1 :])
            continue
        held: list[str] = []
        for p in g:
            if held and len("".join(held)) + len(p) > size:
                out.append("".join(held))
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                    held = held[1:]
            held.append(p)
        out += ["".join(held)]
    return [x.strip() for x in out if x.strip()]


@given(st.lists(st.sampled_from(["a", "bc", "def", " ", " ", "\n", "\n\n", "long" * 5, "\u00e9"]), max_size=60).map("".join), st.integers(2, 30), st.data())
def test_recursive_chunks_follow_the_published_rule(whole, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    want = plain_pieces(whole, size, overlap, list(text.SEPARATORS)) if whole else []
    assert text.split_recursive(whole, size, overlap) == want


def test_recursive_chunks_of_small_texts(spark):
    assert text.split_recursive("word0 word1 word2", 11, 5) == ["word0 word1", "word2"]
    assert text.split_recursive("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert text.split_recursive("one\n\ntwo three", 9, 0) == ["one", "two", "three"]  # a separator counts with its part
    docs = spark.createDataFrame([(1, "x" * 700), (2, None), (3, " \n "), (4, "a\x00b")], "doc_id int, text string")
    got = rows(text.recursive_chunks(docs, "doc_id"), "doc_id", "chunk_index", "text")
    assert got == sorted([(1, 0, "x" * 500), (1, 1, "x" * 250), (4, 0, "ab")], key=str)


def test_pseudonyms_are_stable_and_reversible(spark):
    own = "a@b.org then a@b.org and c@d.net"
    out = pii.anonymise(spark.createDataFrame([(1, 0, own), (2, 0, None)], "doc_id int, chunk_index int, text string"), "doc_id")
    got = {r.doc_id: r for r in out.withColumn("back", pii.restore(F.col("text"), F.col("pii_map"))).collect()}
    assert got[1].text == "<EMAIL_ADDRESS_0> then <EMAIL_ADDRESS_0> and <EMAIL_ADDRESS_1>"
    assert got[1].back == own and got[2].text is None


def test_entities_that_are_parts_of_longer_ones_are_found(spark):
    texts = ["a.b@x.com then b@x.com", "21:30 ... 01:30", "21:300 11:30 01:30", "em 01/02/2024 e 02/2024", "x912345-678 or 12345-678", None]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_id int, chunk_index int, text string")
    found = [(0, "a.b@x.com", 1), (0, "b@x.com", 16), (1, "01:30", 11), (1, "21:30", 1), (2, "11:30", 8), (2, "01:30", 14),
             (3, "01/02/2024", 4), (3, "02/2024", 17), (4, "12345-678", 16)]
    assert rows(pii.entities(df, "doc_id"), "doc_id", "entity", "start") == sorted(found, key=str)
    out = {r.doc_id: r.text for r in pii.anonymise(df, "doc_id").collect()}
    assert out[0] == "<EMAIL_ADDRESS_0> then <EMAIL_ADDRESS_1>" and out[1] == "<TIME_0> ... <TIME_1>" and out[5] is None
    assert out[4] == "x912345-678 or <ZIP_CODE_0>"


def test_sections_are_found_without_accents(spark):
    got = text.split_sections("Título\nIntrodução aqui. Método ali.", [
        {"section": "I", "start_text": "introducao", "end_text": None}, {"section": "M", "start_text": "METODO", "end_text": None},
    ])
    assert [(s["section"], s["text"].strip()) for s in got] == [("I", "Introdução aqui."), ("M", "Método ali.")]
