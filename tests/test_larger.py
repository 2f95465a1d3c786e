"""Rows that only tables larger than the given ones hold: queries over made tables against their SQL."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.functions import pii
from paperloom.operators import context


def against_sql(spark, name, folder, **tables):
    """The rows of a query over ``tables`` (name -> rows as DuckDB SQL), held against its SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"copy ({rows}) to '{folder}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = sorted((tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(folder)).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_colours_of_numbers_over_24_and_32_bits(spark, tmp_path):
    keys = "select unnest([0, 1, 16777, 16778, 268436, 2147483, 2147484, 5000000000]) as p_partkey, 8::int as p_size"
    got = against_sql(spark, "layout_values", tmp_path, part=keys)
    assert ("#100031", 16778) in {(r[1], r[0]) for r in got}


def test_fonts_of_odd_keys_with_near_values(spark, tmp_path):
    customer = "select unnest([1, 2, 3]) as c_custkey, unnest([10.0, 10.0, 50.0]::double[]) as c_acctbal"
    supplier = "select unnest([1, 2, 3]) as s_suppkey, unnest([10.5, 10.5, 10.0]::double[]) as s_acctbal"
    got = against_sql(spark, "page_criteria", tmp_path, customer=customer, supplier=supplier)
    assert {(r[0], r[2]) for r in got if r[1] == "main_font"} == {(1, False), (2, True), (3, False)}


def test_texts_are_searched_once_for_personal_data(spark):
    seen = spark.sparkContext.accumulator(0)

    def text(k):
        seen.add(1)
        return f"call 91234-{k:04d} at 10:{k % 60:02d}"

    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.udf(text)("id").alias("text"))
    assert {r.text for r in pii.anonymise(df, "doc_id").collect()} == {"call <PHONE_NUMBER_BR_0> at <TIME_0>"}
    assert seen.value <= 80  # once to search, once for what is returned


def test_texts_of_a_small_file_are_dealt_over_tasks(spark, sf_dir):
    assert entry.queries()["pii_kinds"](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_notices_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(context, "TASK_ROWS", 100)
    changes = spark.range(1000).selectExpr("id as document_id", "'WAITING_FOR_REVIEW' as status")
    parties = changes.selectExpr("document_id", "'creator' as role", "document_id % 7 as user_id")
    got = context.notifications(changes, parties, spark.createDataFrame([(1,), (9,)], "user_id long"))
    assert got.count() == 3000 - len(range(1, 1000, 7))
    assert got.rdd.getNumPartitions() == 31  # 1000 changes, each told to one party and two auditors
