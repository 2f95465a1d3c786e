"""Scans in slices against the window form."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import latest, scan, vectors


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A key of half the rows, a null key, null values and equal rows, as a written table of many slices."""
    dice = random.Random(2)
    rows = []
    for i in range(600):
        k = dice.choice([0, 0, 0, 1, 2, None])
        rows.append((k, dice.randint(0, 200), dice.choice([None, dice.randint(0, 900)]), i))
    rows += [(0, 7, 5, 1000)] * 20
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "k int, at int, v int, i int").repartition(6).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def held(df):
    return sorted(map(repr, df.collect()))


def test_each_kind_of_scan(events):
    rows = scan.slices(events, ["k"], [F.col("at").asc(), F.col("i").asc()])
    assert rows.where("k = 0").select(scan.SLICE).distinct().count() > 1
    kinds = {"n": ("count", None, True), "s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "l": ("last", F.col("v"), True), "b": ("before", F.col("v"), False)}
    got = sorted((tuple(r) for r in scan.scan(rows, ["k"], kinds).select("k", "at", "i", "v", scan.AT, *kinds).collect()), key=lambda r: r[4])
    state = {}
    for k, at, i, v, _, n, s, m, last, before in got:
        old = state.setdefault(k, [])
        values = [x for x in [*old, v] if x is not None]
        past = [x for x in old if x is not None]
        assert n == len(old) + 1 and s == (sum(values) if values else None), (k, at, i)
        assert m == (max(past) if past else None) and last == (values[-1] if values else None)
        assert before == (old[-1] if old else None)
        old.append(v)


def test_operators_give_the_same_either_way(spark, events):
    ends = events.withColumn("end", F.when(F.col("i") % 3 == 0, F.col("at") + 1)).where("i < 1000")
    assert held(latest.lead_fill(ends, ["k"], ["at", "i"], "at", "end", spread=True)) == held(latest.lead_fill(ends, ["k"], ["at", "i"], "at", "end", spread=False))
    spans = events.select("k", F.col("at").alias("low"), (F.col("at") + F.coalesce("v", F.lit(0)) % 5).alias("high"))
    assert held(latest.islands(spans, ["k"], "low", "high", 1, spread=True)) == held(latest.islands(spans, ["k"], "low", "high", 1, spread=False))
    one = events.where("i < 1000")
    assert held(latest.release_versions(one, "k", ["at", "i"], spread=True)) == held(latest.release_versions(one, "k", ["at", "i"], spread=False))
    chunks = one.select("k", "i", F.col("at").alias("start"), F.lit(3).alias("length"))
    marks = one.where("i % 5 = 0").select("k", F.col("i").alias("ord"), (F.col("i") / 3).cast("int").alias("start"), F.col("i").cast("string").alias("section"))
    marks = marks.unionByName(spark.createDataFrame([(0, 700, 150, "late"), (0, 701, 20, "back"), (0, 702, 180, "lost")], marks.schema))
    a, b = (held(vectors.asof_sections(chunks, marks, "k", spread=s)) for s in (True, False))
    assert a == b and not any("lost" in r for r in a)


def test_what_decides(spark, events):
    assert scan.crowded(events, ["k"], most=100) and not scan.crowded(events, ["k"])
    empty = events.where("false")
    assert not scan.crowded(empty, ["k"])
    assert latest.release_versions(empty, "k", ["at"], spread=True).count() == 0
