"""The driver's contract, sources and streaming jobs."""

import json
import os
import zipfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.plans import queries as plans
from paperloom.sources import files
from paperloom.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark conversations labels".split()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = plans.QUERIES[name](spark, sf_dir)
    want = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    shown = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    a = sorted(tuple(shown(r[c]) for c in names) for r in got.collect())
    assert sorted(got.columns) == sorted(names)
    assert a == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["knn_every20", "neighbour_hits"])
def test_searches_of_the_whole_query_set_match_their_sql(spark, sf_dir, name):
    test_queries_match_their_sql(spark, sf_dir, name)
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    if name == "knn_every20":
        assert {r.query_id for r in plans.QUERIES[name](spark, sf_dir).collect()} == ids


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_docx_files_are_read_and_broken_ones_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p ><w:t>three</w:t></w:p>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.source: (r.text, r.error) for r in files.read_docx(spark, str(tmp_path / "*.docx")).collect()}
    assert got == {"good.docx": ("One & two\nthree", None), "bad.docx": (None, "BadZipFile")}


def test_unknown_kinds_go_to_the_dead_letters(spark):
    good, bad = files.route(spark.createDataFrame([("a.PDF",), ("b.exe",), ("c",)], "path string"))
    assert [r.path for r in good.collect()] == ["a.PDF"]
    assert sorted(r.path for r in bad.collect()) == ["b.exe", "c"]


def test_a_result_store_returns_the_last_one_saved(spark, tmp_path):
    for i in (1, 2):
        files.save_results(spark.createDataFrame([("d", i, i * 10)], "doc_id string, saved_at int, v int"), str(tmp_path / "r"))
    store = files.read_results(spark, str(tmp_path / "r"), "doc_id string, saved_at int, v int")
    assert [r.v for r in files.result(store, "d").collect()] == [20]


def test_a_feed_is_published_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("c", "queued", "", "{}", datetime(2024, 1, 1))], jobs.EVENT).write.parquet(src)
    seen = []
    q = jobs.publish(jobs.feed(spark, src), lambda df, _: seen.extend(r.event for r in df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert seen == ["queued"]


def test_windows_count_a_stream_as_a_batch(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert jobs.windowed_counts(df, "ts", "event_type").agg(F.sum("n")).first()[0] == df.count()


def test_bench_names_registered_queries():
    import bench

    assert set(bench.HEADLINE) <= set(entry.queries())
    assert json.dumps(bench.HEADLINE) and os.path.exists(bench.__file__)
