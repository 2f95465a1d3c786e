"""Checks of reference sections, shown values, quoted messages, lists and sections: small cases worked out by hand."""

from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import audit, layout, listing, tree


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


SIDE = "k int, font_family string, font_size double, text_alignment string, numbering_style string"


def test_references_of_two_files(spark):
    files = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    template = spark.createDataFrame([(1, "Times-Roman", 10.0, "justificado", "numerica"), (2, "Arial", 10.0, None, "numerica")], SIDE)
    article = spark.createDataFrame(
        [(1, "TimesNewRomanPS", 10.7, "esquerda", "numerica"), (2, "Courier", 10.75, None, None), (3, "Arial", 9.0, "esquerda", "numerica")], SIDE
    )
    got = rows(layout.reference_checks(files, template, article, ["k"]), "k", "criterion", "expected", "found", "passed")
    assert got == sorted(
        [(1, "familia_fonte", "Times-Roman", "TimesNewRomanPS", True), (1, "tamanho_fonte", "10.0 pt", "10.7 pt", True),
         (1, "alinhamento", "justificado", "esquerda", False), (1, "estilo_numeracao", "numerica", "numerica", True),
         (2, "familia_fonte", "Arial", "Courier", False), (2, "tamanho_fonte", "10.0 pt", "10.8 pt", False),
         (2, "alinhamento", None, None, False), (2, "estilo_numeracao", "numerica", None, False),
         (3, "secao_localizada", "não", "sim", False), (4, "secao_localizada", "não", "não", True)], key=str,
    )


def test_values_of_reports(spark):
    df = spark.createDataFrame([(True, 1.25), (False, 0.0), (None, None)], "b boolean, x double")
    shown = df.select(text.truth_shown(F.col("b")).alias("b"), text.measure_shown(F.col("x") + 0.5, "mm").alias("m"), text.ratio_shown(F.col("x")).alias("r"))
    got = [tuple(r) for r in shown.collect()]
    assert [(b, r) for b, _, r in got] == [("sim", "1.25"), ("não", "0.00"), (None, "indeterminado")]
    assert got[1][1] == "0.5 mm"
    halves = spark.createDataFrame([(10.25, 0.125), (10.75, 0.375), (-0.25, 1.005)], "x double, r double")
    got = halves.select(text.measure_shown(F.col("x"), "pt").alias("x"), text.number_shown(F.col("x")).alias("n"), text.ratio_shown(F.col("r")).alias("r"))
    assert [tuple(r) for r in got.collect()][:2] == [("10.2 pt", "10.2", "0.12"), ("10.8 pt", "10.8", "0.38")]


def test_messages_that_quote_none_or_a_lost_one(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 9, "c"), (4, 1, None)], "id int, quotes int, text string")
    got = tree.with_quoted(df, ["id"], ["quotes"], quoted="text", quoted_id="id")
    assert got.columns == ["id", "quotes", "text", "quoted", "quoted_id"]
    assert rows(got, "id", "quoted", "quoted_id") == [(1, None, None), (2, "a", 1), (3, None, None), (4, "a", 1)]


def test_changes_of_lists(spark):
    df = spark.createDataFrame([(1, [3, 1, 1], [2, 1]), (2, None, [5, 4]), (3, [7], None), (4, [], [])], "id int, a array<int>, b array<int>")
    added, removed = audit.list_changes(F.col("a"), F.col("b"))
    got = rows(df.select("id", added.alias("x"), removed.alias("y")), "id", "x", "y")
    assert got == [(1, [2], [3]), (2, [4, 5], []), (3, [], [7]), (4, [], [])]


def test_results_side_by_side(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a")], "id int, v string")
    two = spark.createDataFrame([("a", 1)], "v string, id int")
    assert rows(listing.concatenated(one, two), "id", "v") == [(1, "a")] * 3
    assert rows(listing.concatenated(one, two, one, part="n"), "n", "id") == [(0, 1), (0, 1), (1, 1), (2, 1), (2, 1)]


def test_values_in_json(spark):
    texts = ['{"k": 1}', '{"k": "b"}', '{"k": null}', "{}", "no json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    assert rows(df.where(listing.json_is("j", "k", 1, "b")), "id") == [(0,), (1,)]
    assert df.where(listing.json_is("j", "k")).count() == 0
    assert rows(df.select("id", listing.json_text("j", "k").alias("k")), "id", "k")[2:] == [(2, None), (3, None), (4, None), (5, None)]


def test_medians_of_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, None), (1, 4.0, 7), (1, 8.0, None), (2, None, None)], "k int, a double, b int")
    assert rows(layout.medians(df, ["k"], x="a", y="b"), "k", "x", "y") == [(1, 3.0, 6.0), (2, None, None)]


def test_sections_of_texts_by_their_anchors(spark):
    docs = spark.createDataFrame([("d1", "Título\nIntrodução aqui. Método ali."), ("d2", None), ("d3", ""), ("d4", "nada")], "doc_id string, text string")
    kind = "doc_id string, ord int, section string, start_text string, end_text string"
    marks = spark.createDataFrame([("d1", 1, "Method", "METODO", None), ("d1", 0, "Intro", "introducao  AQUI", None), ("d4", 0, "x", "absent", None)], kind)
    got = rows(text.section_split(docs.repartition(4), marks), "doc_id", "ord", "section", "start", "text")
    assert got == [
        ("d1", 0, "Intro", 7, "Introdução aqui. "), ("d1", 1, "Method", 24, "Método ali."), ("d2", 0, None, 0, ""),
        ("d3", 0, None, 0, ""), ("d4", 0, None, 0, "nada"),
    ]
