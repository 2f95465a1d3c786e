"""Ranks, segmented indexes, evaluation in parts, SQL over live rows, the document source."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.catalog import Catalog
from paperloom.operators import context, evaluate, layout, listing, search, vectors
from paperloom.sources import documents, files
from paperloom.sources.segments import SegmentedIndex


def test_weight_a_outranks_d(spark):
    rows = [(1, "contrato", "texto sem mais"), (2, "outro", "contrato " * 50), (3, "nada", "nada"), (4, None, None), (5, "contrato novo", "contrato")]
    df = spark.createDataFrame(rows, "id int, name string, body string")
    got = {r.id: r.rank for r in search.ranked(df, {"name": "A", "body": "D"}, "contr").collect()}
    assert set(got) == {1, 2, 5} and got[5] > got[1] > got[2]
    limit = 3.141592653589793**2 / 6
    assert got[1] == pytest.approx(1 / limit) and got[2] == pytest.approx(sum(0.1 / j**2 for j in range(1, 51)) / limit)
    both = {r.id: r.rank for r in search.ranked(df, {"name": "A", "body": "D"}, "contr nov").collect()}
    assert set(both) == {5} and both[5] == pytest.approx((1 + 0.1 / 4 + 1) / 2 / limit)
    assert search.ranked(df, {"name": "A"}, " & ").count() == 5


def test_entities_have_their_weights(spark):
    users = spark.createDataFrame([(1, "ana silva")], "id int, username string")
    assert search.ranked_entity(users, "users", "an").first().rank == pytest.approx(6 / 3.141592653589793**2)
    sources = spark.createDataFrame([(1, "Leis", "as leis de contratos")], "id int, name string, description string")
    assert search.ranked_entity(sources, "sources", "contratos").count() == 1
    assert search.ranked_entity(sources, "sources", "de").count() == 0  # stop words alone


def built(rows):
    return sorted((w, k) for k, text in rows.items() for w in set(text.split()))


def postings(spark, rows):
    return search.postings(spark.createDataFrame(list(rows.items()) or [], "k long, text string"), "k", ["text"])


def test_an_updated_index_equals_one_built_anew(spark, tmp_path):
    dice = random.Random(4)
    words = ["alfa", "alto", "beta", "bela", "gama"]
    index, rows = SegmentedIndex(spark, str(tmp_path / "index"), "k"), {}
    assert index.postings().count() == index.search("al").count() == 0
    for n in range(5):
        new = {dice.randint(0, 30): " ".join(dice.sample(words, dice.randint(0, 3))) for _ in range(8)}
        gone = dice.sample(sorted(rows), min(3, len(rows)))
        old = {p.name for p in (tmp_path / "index").glob("*")}
        for k in gone:
            rows.pop(k)
        rows |= new
        changed = spark.createDataFrame([(k,) for k in [*gone, *new]], "k long")
        index.update(postings(spark, new), changed)
        assert {p.name for p in (tmp_path / "index").glob("*")} > old
        if n == 3:
            assert index.merge(fan=2) > 0
    assert sorted((r.term, r.k) for r in index.postings().collect()) == built(rows)
    want = sorted(k for k, t in rows.items() if any(w.startswith("al") for w in t.split()) and any(w.startswith("be") for w in t.split()))
    assert sorted(r.k for r in index.search("al be").collect()) == want
    assert len(index.segments()) < 5 and index.vacuum() > 0
    assert sorted((r.term, r.k) for r in index.postings().collect()) == built(rows)
    plan = index._live(index.segments(), ["al"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,al)" in plan


def test_an_update_works_its_postings_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def word(k):
        seen.add(1)
        return f"w{k % 10}"

    index = SegmentedIndex(spark, str(tmp_path / "index"), "k")
    index.update(spark.range(100).selectExpr("id % 50 as k").select(F.udf(word)("k").alias("term"), "k"))
    assert seen.value == 100
    assert index.postings().count() == 50 and index.segments()[0]["keys"] == 50
    assert not list((tmp_path / "index").glob("*/unsorted"))


def test_one_bad_payload_costs_one_verdict(spark):
    def model(part):
        assert len(part) <= 32 and [p["ordinal"] for p in part] == list(range(part[0]["ordinal"], part[0]["ordinal"] + len(part)))
        if any(p["branch_id"] == "613" for p in part):
            raise ValueError("down")
        return [{"feedback": p["branch_id"], "fulfilled": True, "score": 7, "cited": [], "ordinal": p["ordinal"]} for p in part]

    df = spark.range(1000).coalesce(1).selectExpr("cast(id as string) branch_id", "'r' requirement", "'c' context")
    got = {r.branch_id: r for r in evaluate.evaluate(df, model).collect()}
    assert len(got) == 1000 and [k for k, r in got.items() if r.fulfilled is None] == ["613"]
    assert all(r.feedback == k for k, r in got.items() if k != "613") and got["613"].feedback == "not evaluated: down"
    assert got["0"].attempts == 1 and got["613"].attempts > got["640"].attempts == 1


@pytest.mark.parametrize("reply", [lambda p: [], lambda p: None, lambda p: [{"feedback": "x", "ordinal": 99}] * len(p), lambda p: [{}] * (len(p) + 1)])
def test_unsound_replies_are_failures(reply):
    got = evaluate.judged([{"branch_id": "1"}, {"branch_id": "2"}], reply, attempts=2)
    assert [(g["fulfilled"], g["attempts"]) for g in got] == [(None, 4), (None, 4)] and all("not evaluated" in g["feedback"] for g in got)


def test_a_part_that_recovers_is_judged_whole():
    calls = []

    def model(part):
        calls.append(len(part))
        if len(calls) < 3:
            raise OSError("busy")
        return [{"feedback": "ok", "fulfilled": True, "score": 1, "cited": []}] * len(part)

    got = evaluate.judged([{"branch_id": str(i)} for i in range(40)], model)
    assert sorted(calls) == [8, 8, 8, 32] and {g["attempts"] for g in got} == {1, 3}


def test_sql_sees_live_rows_alone(spark, tmp_path):
    rows = [(1, 7, None), (2, 7, None), (3, 7, "2024"), (4, 8, "2024")]
    spark.createDataFrame(rows, "id int, owner int, deleted_at string").write.parquet(str(tmp_path / "notes.parquet"))
    spark.createDataFrame([(7,), (8,)], "owner int").write.parquet(str(tmp_path / "owners.parquet"))
    own = Catalog(spark, str(tmp_path))
    text = "select a.id, b.id as other from {notes} a join {notes} b using (owner) where a.owner in (select owner from {notes} union select owner from {owners})"
    pairs = sorted(map(tuple, own.sql(text, "notes", "owners").collect()))
    assert pairs == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert own.sql(text, "notes", "owners", include_deleted=True).count() == 10
    own.register("notes", prefix="t_")
    assert spark.sql("select count(*) from t_notes x where exists (select 1 from t_notes y where y.owner = x.owner and y.id <> x.id)").first()[0] == 2
    assert spark.sql("select count(*) from t_notes_all").first()[0] == 4


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("olá\nmundo", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>um</w:t></w:r></w:p><w:p><w:t>dois</w:t></w:p>")
    (tmp_path / "b.docx").write_bytes(held.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    words = [{"page": 2, "line": 1, "text": "fim"}, {"page": 1, "line": 0, "text": "o"}, {"page": 1, "line": 0, "text": "começo"}, {"page": 1, "line": 1, "text": "dele"}]
    (tmp_path / "c.words").write_text("\n".join(map(json.dumps, words)))
    (tmp_path / "broken.words").write_text("{]")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_a_folder_is_read_with_its_dead_letters(spark, folder):
    documents.register(spark)
    df = spark.read.format(documents.FORMAT).option("files", 3).load(f"file://{folder}")
    got = {(r.source, r.page): (r.text, r.error) for r in df.collect()}
    assert got == {
        ("a.txt", None): ("olá\nmundo", None), ("empty.txt", None): ("", None), ("bad.txt", None): (None, "UnicodeDecodeError"),
        ("b.docx", None): ("um\ndois", None), ("broken.docx", None): (None, "BadZipFile"), ("c.words", 1): ("o começo\ndele", None),
        ("c.words", 2): ("fim", None), ("broken.words", None): (None, "JSONDecodeError"), ("d.pdf", None): (None, "unsupported extension: pdf"),
    }
    assert df.rdd.getNumPartitions() == 3
    one = spark.read.format(documents.FORMAT).load(f"file://{folder}").where("source = 'b.docx' and text like 'um%'")
    assert [r.text for r in one.collect()] == ["um\ndois"]


def test_files_are_not_opened_for_their_names(spark, folder, tmp_path):
    documents.register(spark)
    few = spark.read.format(documents.FORMAT).schema("kind string, bytes long").load(f"file://{folder}")
    got = {r.kind: r.n for r in few.groupBy("kind").agg(F.sum("bytes").alias("n")).collect()}
    assert got["pdf"] == 4 and set(got) == {"txt", "docx", "words", "pdf"}
    (tmp_path / "none").mkdir()
    assert spark.read.format(documents.FORMAT).load(f"file://{tmp_path}/none").count() == 0


def test_a_published_version_is_what_readers_find(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(str(tmp_path / "notes.parquet"))
    own = Catalog(spark, str(tmp_path))
    new = listing.update_where(own.table("notes"), F.col("id") == 2, name=F.lit("c"))
    own.snapshot("notes", new, "v2")
    assert own.by_id("notes", 2).first().name == "b"
    own.publish("notes", "v2")
    assert own.by_id("notes", 2).first().name == "c" and own.by_id("notes", 1).first().name == "a"
    own.append("notes", spark.createDataFrame([(3, "d")], "id int, name string"))
    assert own.table("notes").count() == 3


def test_updates_by_ids_of_other_tables(spark):
    docs = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, None, "c"), (4, 9, None)], "id int, p int, name string")
    ids = spark.createDataFrame([(8,), (8,), (None,)], "x int")
    got = listing.update_matching(docs, {"p": ids}, F.col("name") == "a", name=F.lit("new"))
    assert got.columns == docs.columns and sorted(r.name or "" for r in got.collect()) == ["", "c", "new", "new"]


def test_keys_of_a_result_store(spark):
    store = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), (None, 3)], "doc_id string, saved_at int")
    assert [r.doc_id for r in files.result_keys(store).collect()] == ["a", "b"]


def test_visual_verdicts_count(spark):
    checks = spark.createDataFrame([(1, "m", True), (2, "m", True)], "k int, section string, passed boolean")
    visuals = spark.createDataFrame([(1, False, None, False, True), (2, False, True, False, None)], "k int, skipped boolean, rendered boolean, failed boolean, verdict boolean")
    got = layout.summary(layout.with_visual(checks, visuals, ["k"]), ["k"])
    assert sorted((r.k, r.total, r.passed, r.compliant) for r in got.collect()) == [(1, 2, 2, True), (2, 2, 1, False)]


def test_all_auditors_are_told_of_all_documents(spark):
    changes = spark.createDataFrame([(i, "WAITING_FOR_REVIEW") for i in range(300)], "document_id int, status string")
    parties = spark.createDataFrame([], "document_id int, role string, user_id int")
    auditors = spark.createDataFrame([(1,), (2,), (2,), (None,)], "user_id int")
    got = context.notifications(changes, parties, auditors)
    assert got.count() == 600 == got.distinct().count()


def test_neighbours_of_groups_and_boxes(spark):
    chunks = spark.createDataFrame([("s", i) for i in range(6)], "source string, chunk_index int")
    hits = spark.createDataFrame([("g", "s", 0), ("g", "s", 1), ("h", "t", 3)], "g string, source string, chunk_index int")
    got = vectors.expanded_or_hits(hits, chunks, "g")
    assert sorted(tuple(r) for r in got.select("g", "source", "chunk_index").collect()) == [("g", "s", 0), ("g", "s", 1), ("g", "s", 2), ("g", "s", 3), ("h", "t", 3)]
    boxes = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [1.0]],)], "r array<array<double>>").select(vectors.rect_structs(F.col("r")).alias("r")).first().r
    assert [tuple(b) for b in boxes] == [(1.0, 2.0, 3.0, 4.0)]


def test_body_spans(spark):
    rows = [(1, 0, "long body text", 10.04), (1, 1, "Title", 16.0), (1, 2, "more body", 9.98), (1, 3, "  ", 10.0)]
    got = layout.body_spans(spark.createDataFrame(rows, "page int, ord int, text string, size double"), ["page"])
    assert sorted(r.ord for r in got.collect()) == [0, 2]


def test_sources_read_and_write(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for n in ("b.pdf", "a.pdf"):
        (tmp_path / "t" / n).write_bytes(b"x")
    assert [r.name for r in files.templates(spark, str(tmp_path / "t")).collect()] == ["a.pdf", "b.pdf"]
    names = F.array(F.lit("a.pdf"))
    got = spark.range(1).select(files.chosen_template(F.lit("z"), names, "d.pdf"), files.chosen_template(F.lit("a.pdf"), names, "d.pdf"), files.upload_name(F.lit("1/ç.x"), F.lit(""))).first()
    assert tuple(got) == ("d.pdf", "a.pdf", "1çx.pdf")
    files.append_chunks(spark.createDataFrame([("s", 1), ("t", 2)], "source string, n int"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).where("source = 't'").first().n == 2
