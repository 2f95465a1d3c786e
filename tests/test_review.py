"""Cases worked out by hand from the review domain's own rules, not from the library's constants."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import pii, text
from paperloom.operators import context, criteria, embed, evaluate, latest, layout, search, tree
from paperloom.sources.store import FileStore
from paperloom.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_patterns_match_with_and_without_separators(spark):
    own = [
        "12345678", "12345-678", "123.456.789-09", "12345678909", "12.345.678/0001-95", "12.345.678-9", "(21) 98765-4321", "987654321",
        "R$ 1.234,56", "r$1,00", "7.5/2024-10", "01/02/2024", "123/2024", "23:59", "3:59", "a.b@x.com", "ver a Fiocruz, hoje", "Fiocruzes",
    ]
    df = spark.createDataFrame(list(enumerate(own)), "i int, text string")
    got = {r.i: {k for k, v in r.asDict().items() if k != "i" and v} for r in df.select("i", *pii.counts(F.col("text"))).collect()}
    want = [
        {"zip_code", "phone_number_br"}, {"zip_code"}, {"cpf"}, {"cpf", "phone_number_br"}, {"cnpj", "process_number", "edital_number"}, {"rg"}, {"phone_number_br"},
        {"rg", "phone_number_br"}, {"money"}, {"money"}, {"process_number"}, {"date", "edital_number"}, {"edital_number"}, {"time"}, set(),
        {"email_address"}, {"institution"}, set(),
    ]
    assert got == dict(enumerate(want))


def test_stems_are_those_of_the_published_vocabulary():
    words = {
        "boa": "boa", "boataria": "boat", "bobagem": "bobag", "bobagens": "bobagens", "bobalhões": "bobalhõ", "bobeira": "bobeir",
        "bocadas": "boc", "bocaiúva": "bocaiúv", "boçal": "boçal", "boêmios": "boêmi", "quilométricas": "quilométr", "química": "químic",
        "quinzena": "quinzen", "felizmente": "feliz", "possivelmente": "possivel", "atividade": "ativ", "informações": "inform",
    }
    assert {w: search.stem(w) for w in words} == words


def test_accents_and_loose_modifiers_go(spark):
    got = spark.range(1).select(text.accents_stripped(F.lit("Referˆencias ÇÃÉ ﬁm e\u0301")).alias("x")).first().x
    assert got == "Referencias CAE fim e"


def test_reference_sections(spark):
    page = lambda p, y, t, x=50.0, w=400.0: (1, p, y, y + 10, x, x + w, t)
    lines = [
        page(1, 10.0, "Sumário"), page(2, 10.0, "5. REFERÊNCIAS"), page(2, 30.0, "[1] A. Book."), page(2, 42.0, "continued", 60.0, 380.0),
        page(2, 54.0, "169"), page(3, 10.0, "[2] B. Paper."), page(3, 40.0, "Apêndices"), page(3, 60.0, "after"),
    ]
    df = spark.createDataFrame(lines, "doc int, page int, y0 double, y1 double, x0 double, x1 double, text string")
    bounds = layout.reference_bounds(df, "doc")
    assert rows(bounds, "start_page", "start_y", "end_page", "end_y") == [(2, 20.0, 3, 40.0)]
    assert [r[0] for r in rows(layout.lines_within(df, bounds, "doc"), "text")] == ["[1] A. Book.", "[2] B. Paper.", "continued"]
    assert rows(layout.first_page_bounds(bounds), "end_page", "end_y") == [(2, None)]
    toc = spark.createDataFrame([(1, "Referências", 3)], "doc int, title string, page int")
    assert rows(layout.reference_bounds(df, "doc", toc), "start_page") == [(2,)]  # no heading from there on: all is searched
    assert layout.reference_bounds(df.where("page = 1"), "doc").count() == 0
    for heading in ("Works Cited", "literature cited.", "Referências Bibliográficas"):
        assert layout.reference_bounds(df.withColumn("text", F.when(F.col("page") == 2, heading).otherwise(F.col("text"))), "doc").count() == 1
    own = layout.lines_within(df, bounds, "doc").withColumn("ord", F.col("page") * 1000 + F.col("y0"))
    spans = own.select("doc", "ord", "text", F.lit(12.0).alias("size"), F.lit("ABCDEF+Times-Bold").alias("font"), F.lit(0).alias("flags"), F.lit(0).alias("color"))
    r = layout.reference_metrics(own, spans, ["doc"]).first()
    assert (r.font_family, r.font_size, r.font_bold, r.numbering_style, r.text_alignment) == ("Times-Bold", 12.0, True, "colchetes", "justificado")
    assert abs(r.hanging_indent - 10 * 25.4 / 72) < 1e-9 and r.spacing_mode == "1.5"  # tops 10, 30, 42: the first of two gaps
    tpl, art = layout.both_bounds(df, df, "doc")
    assert tpl.first().end_page == 2 and art.first().end_page == 3


def test_page_metrics_of_a_small_page(spark):
    spans, lines, i = [], [], 0
    for line in range(6):
        for x in (50.0, 320.0):
            y, left = 100.0 + 18 * line, x + (20 if line == 0 else 0)
            spans.append((1, 1, line * 2 + int(x > 100), 0, 0, f"text of line {i}", 12.0, "AAAAAA+Times", 0, 0xAB, i, left, y, x + 230.0, y + 12, 595.0, 842.0))
            lines.append((1, 1, f"text of line {i}", left, y, x + 230.0, y + 12, 595.0, 842.0))
            i += 1
    spans.append((1, 1, 99, 0, 0, "iv", 8.0, "Arial", 0, 0, i, 290.0, 810.0, 300.0, 820.0, 595.0, 842.0))
    lines.append((1, 1, "iv", 290.0, 810.0, 300.0, 820.0, 595.0, 842.0))
    names = "doc int, page int, block int, line int, span int, text string, size double, font string, flags int, color int, ord int, line_x0 double, line_y0 double, line_x1 double, line_y1 double, page_w double, page_h double"
    s = spark.createDataFrame(spans, names).withColumns({k: F.col(f"line_{k}") for k in ("x0", "y0", "x1", "y1")})
    table = spark.createDataFrame(lines, "doc int, page int, text string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    r = layout.page_metrics(s, table, ["doc", "page"]).first()
    mm = 25.4 / 72
    assert (r.page_format, r.column_count, r.font_family, r.font_size, r.font_color) == ("A4", 2, "Times", 12.0, "#0000AB")
    assert abs(r.gutter - 40 * mm) < 1e-9 and abs(r.first_line_indent - 20 * mm) < 1e-9 and r.spacing_mode == "1.5"
    assert (r.exists, r.position, r.format, r.text_alignment) == (True, "rodapé-centro", "romano", "justificado")
    pages = layout.page_metrics(s, table, ["doc", "page"])
    two = pages.unionByName(pages.withColumn("page", F.lit(2))).unionByName(pages.withColumns({"page": F.lit(3), "column_count": F.lit(1), "gutter": F.lit(0.0)}))
    all_ = layout.aggregated_pages(two, ["doc"]).first()
    assert all_.column_count == 2 and len(all_.column_widths) == 2 and abs(all_.gutter - 40 * mm) < 1e-9 and all_.position == "rodapé-centro"
    bounds = spark.createDataFrame([(1, 3, 0.0, 3, None)], "doc int, start_page int, start_y double, end_page int, end_y double")
    assert layout.body_profile(two, bounds, "doc").first().column_count == 2
    assert rows(layout.page_criteria(pages, pages, ["doc"]), "criterion", "passed") == [
        ("columns", True), ("line_spacing", True), ("main_font", True), ("margins", True), ("page_size", True),
    ]


def test_labels_of_undetermined_values(spark):
    r = spark.range(1).select(
        layout.alignment(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("a"), layout.spacing_label(F.lit(None).cast("double")).alias("s"),
        layout.spacing_ratio(F.lit(0.0), F.lit(12.0)).alias("r"), layout.page_format(F.lit(100.0), F.lit(100.0)).alias("p"),
        layout.same_family(F.lit("Times-RomanPSMT"), F.lit("times_new")).alias("f"), layout.same_family(F.lit("MT"), F.lit("Arial")).alias("g"),
    ).first()
    assert tuple(r) == ("indeterminado", "indeterminado", None, "Desconhecido", True, False)


def test_modal_arrays_leave_empty_ones_out(spark):
    df = spark.createDataFrame([(1, 0, []), (1, 1, []), (1, 2, [1.0, 5.0]), (1, 3, [3.0]), (1, 4, [4.0, 6.0]), (1, 5, [9.0]), (2, 0, [])], "k int, o int, xs array<double>")
    assert rows(layout.modal_arrays(df, ["k"], "xs", "o"), "k", "xs") == [(1, [2.5, 5.5]), (2, [])]


def test_who_is_told(spark):
    changes = spark.createDataFrame([(1, "PENDING"), (2, "UNDER_CONSTRUCTION"), (3, "WAITING_FOR_REVIEW"), (4, "COMPLETED")], "document_id int, status string")
    parties = spark.createDataFrame([(d, r, u) for d in (1, 2, 3, 4) for r, u in (("editor", "e"), ("creator", "c"))], "document_id int, role string, user_id string")
    auditors = spark.createDataFrame([("a",), ("c",)], "user_id string")
    assert rows(context.notifications(changes, parties, auditors), "document_id", "user_id") == [(2, "e"), (3, "a"), (3, "c"), (4, "e")]


def test_criteria_are_forty_and_counted(spark):
    assert len(criteria.CRITERIA) == 40
    some = [(1, g, f, "n", "j", True) for g, f, _ in criteria.CRITERIA] + [(2, *criteria.CRITERIA[0][:2], "n", "j", False), (2, "x", "y", "n", "j", True)]
    flat = criteria.flattened(spark.createDataFrame(some, "k int, group string, field string, norma string, justificativa string, match boolean"), "k")
    assert flat.count() == 80 and rows(criteria.incomplete(flat, "k"), "k", "n") == [(2, 1)]
    assert flat.where("k = 2 and passed is not null").first().criteria_item == "Capa"


def test_a_store_saves_lists_and_deletes(spark, tmp_path):
    store = FileStore(spark, f"file://{tmp_path}/up", "/files/")
    assert store.names() == [] and not store.exists("a.pdf") and not store.delete("a.pdf")
    assert store.save("a.pdf", b"one") == "/files/a.pdf" and store.save("a.pdf", b"two") == "/files/a.pdf"
    assert (tmp_path / "up" / "a.pdf").read_bytes() == b"two" and store.names() == ["a.pdf"]
    assert store.delete("a.pdf") and not store.exists("a.pdf")
    with pytest.raises(ValueError):
        store.save("../a", b"")


def test_the_stand_in_cites_chunks():
    p = {"requirement": "graph theory", "context": "[FONTE] chunk_id: c1\nGraph of x[FONTE] chunk_id: c2\nnothing"}
    assert evaluate.keyword_evaluator([p])[0] == {"feedback": "50% of terms found", "fulfilled": False, "score": 5, "cited": ["c1"]}


def test_report_and_argument_trees(spark):
    nested = spark.createDataFrame([("R", [("M", [("B",), ("C",)]), ("N", [])])], "name string, taxonomies array<struct<title:string,branches:array<struct<title:string>>>>")
    got = [r.line for r in tree.report_lines(nested).orderBy("root", "j", "k").collect()]
    assert got == ["R", "  M", "    B", "    C", "  N"]
    args = spark.createDataFrame([([("t", [("x", [(1, ["s1", "s2"]), (2, None)]), ("y", None)])],)], "typifications array<struct<name:string,taxonomies:array<struct<title:string,branches:array<struct<id:int,sessions:array<string>>>>>>>")
    assert rows(context.flatten_args(args), "branch_id", "session") == [(1, "s1"), (1, "s2")]


def test_sections_found_in_windows_are_merged(spark):
    found = [(1, 0, 0, "Intro", "a", None), (1, 1, 0, "INTRO", "b", "c"), (1, 1, 1, "Method", "d", None)]
    df = spark.createDataFrame(found, "doc int, win int, ord int, section string, start_text string, end_text string")
    assert rows(text.merge_sections(df, "doc"), "section", "start_text", "end_text") == [("Intro", "a", "c"), ("Method", "d", None)]


def test_whole_texts_keep_their_end(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, page int, text string")
    assert text.whole_text(pages, "k", cap=3).first().text == "\n\nb"


def test_entities_are_searched_in_their_own_configuration(spark):
    for entity, (_, columns) in search.CONFIGS.items():
        assert set(columns) <= set(schemas.schema_of(entity).names)
    names = [(1, "Informações dos livros", None), (2, "informante", "livro novo"), (3, None, "de livraria")]
    df = spark.createDataFrame(names, "id int, name string, description string")
    found = lambda q, *config: [r[0] for r in rows(search.search_entity(df, "sources", q, *config), "id")]
    assert found("informação") == [1, 2] and found("livros & novos") == [2] and found("livros", "simple") == [1]
    assert found("os") == [] and found("os", "simple") == [] and found("  ") == [1, 2, 3] and found("de", "simple") == [3]
    users = spark.createDataFrame([(1, "Livros"), (2, "livro")], "id int, username string")
    assert rows(search.search_entity(users, "users", "livros"), "id") == [(1,)]


def test_stored_postings_are_read_by_range(spark, tmp_path):
    df = spark.createDataFrame([(1, "graph theory"), (2, "graphs"), (3, "other words"), (4, None)], "id int, t string")
    search.write_postings(search.postings(df, "id", ["t"]), "id", str(tmp_path / "p"))
    out = search.search_postings(spark.read.parquet(str(tmp_path / "p")), "id", "gra & the")
    assert rows(out, "id") == [(1,)] and "StringStartsWith(term,gra)" in out._jdf.queryExecution().executedPlan().toString()
    stems = search.postings(df, "id", ["t"], "portuguese")
    assert search.search_postings(stems, "id", "de os", "portuguese").count() == 0


def test_tokens_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, "graph theory of graphs")], "id int, t string")
    out = search.search(df, ["t"], "gra the")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1 and out.first()["rank"] == 0.75


def test_embedders_are_pluggable(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, "words two")], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed.embed(df).collect()}
    assert got[2] is None and got[3] == [0.0] * embed.SIZE and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    sizes = embed.vectors_of(F.col("text"), lambda texts: [[len(texts), len(x)] for x in texts], batch=2)
    assert rows(df.select("id", sizes.alias("v")), "id", "v") == [(1, [2.0, 9.0]), (2, None), (3, [2.0, 0.0]), (4, [1.0, 9.0])]
    with pytest.raises(Exception, match="3 texts, 1 vectors"):
        df.select(embed.vectors_of(F.col("text"), lambda texts: [[1.0]])).collect()


def test_names_of_entities_are_replaceable(spark):
    df = spark.createDataFrame([(1, 0, "a@b.org, c@d.net 21:30")], "doc_id int, chunk_index int, text string")
    assert pii.anonymise(df, "doc_id", naming=pii.redacted).first().text == "<EMAIL_ADDRESS>, <EMAIL_ADDRESS> <TIME>"
    own = pii.anonymise(df, "doc_id", naming=lambda kind, n, entity: F.concat(F.lit("["), F.sha2(entity, 256), F.lit("]")))
    r = own.withColumn("back", pii.restore(F.col("text"), F.col("pii_map"))).first()
    assert "@" not in r.text and r.back == "a@b.org, c@d.net 21:30"


def test_states_are_kept_between_triggers(spark, tmp_path):
    kind = "doc string, state string, at int"
    first = [("a", "QUEUED", 2), ("a", "IDLE", 1), ("b", "IDLE", 1)]
    second = [("a", "PROCESSING", 3), ("b", "PROCESSING", 2), ("a", "IDLE", 4), ("c", "FAILED", 1)]
    for i, batch in enumerate((first, second)):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):  # files are read in the order of their times
            if not f.with_suffix(".seen").exists():
                os.utime(f, (1_700_000_000 + i * 100,) * 2)
                f.with_suffix(".seen").touch()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    steps = [("IDLE", "QUEUED"), ("QUEUED", "PROCESSING"), ("PROCESSING", "IDLE"), ("PROCESSING", "FAILED")]
    got = []
    out = jobs.state_machine(stream, "doc", "state", "at", steps)
    q = jobs.publish(out, lambda df, n: got.extend((n, *r) for r in df.collect()), str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(120)
    assert sorted(got) == [
        (0, "a", "IDLE", True), (0, "a", "QUEUED", True), (0, "b", "IDLE", True), (1, "a", "IDLE", True), (1, "a", "PROCESSING", True),
        (1, "b", "PROCESSING", False), (1, "c", "FAILED", True),
    ]


def test_invalid_changes_are_named(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["IDLE", "QUEUED", "IDLE", "QUEUED", "PROCESSING"])], "k int, o int, s string")
    assert rows(latest.invalid_transitions(df, ["k"], ["o"], "s"), "from_state", "to_state", "n") == [("QUEUED", "IDLE", 1)]


def test_other_queries_stay_without_the_corpus_operators(tmp_path):
    """The entry imports where the subpackage is gone, and where a package that it needs is not installed."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == {name!r} or name.startswith({name!r} + '.'): raise ModuleNotFoundError(name, name={name!r})\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); e.oracle_sql()\n"
        "assert len(q) > 90 and 'op3_line_dedup' not in q and 'pipeline' not in q"
    )
    for name in ("paperloom.llm", "xxhash"):
        done = subprocess.run([sys.executable, "-c", code.format(name=name)], capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-800:]
