"""Work that is carried over from run to run: pseudonyms, batches that come again, states with an end."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import pii
from paperloom.sources.store import FileStore, PseudonymStore
from paperloom.streaming import jobs


def test_no_matched_character_stays_readable():
    dice = random.Random(5)
    for _ in range(2000):
        spans = []
        for k in range(dice.randint(1, 5)):
            at = 0
            while at < 40 and dice.random() < 0.8:
                a = at + dice.randint(0, 6)
                b = a + dice.randint(1, 9)
                spans.append((a, b, k))
                at = b
        kept = pii._kept(spans)
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
        assert {c for a, b, _ in kept for c in range(a, b)} == {c for a, b, _ in spans for c in range(a, b)}
        whole = [s for s in kept if s in spans]
        for a, b, k in spans:  # a span that is not kept whole meets one, as long at least, that is
            assert (a, b, k) in kept or any(c < b and a < d and (d - c, -o) >= (b - a, -k) for c, d, o in whole)


def test_a_match_is_not_lost_to_one_that_is_lost_itself(spark):
    df = spark.createDataFrame([(1, 0, "(,00)12308888-10:55")], "doc_id long, chunk_index int, text string")
    assert [r.entity for r in pii.entities(df, "doc_id").where("kind = 'TIME'").collect()] == ["10:55"]
    r = pii.anonymise(df, "doc_id").withColumn("back", pii.restore(F.col("text"), F.col("pii_map"))).first()
    assert not any(c in r.text for c in ("10:55", "8888", "-10")) and r.back == "(,00)12308888-10:55"


def halves(spark):
    texts = [
        (1, 0, "a@x.org às 10:55, b@x.org"), (1, 1, "c@x.org, a@x.org às 11:00"), (1, 2, "b@x.org d@x.org 10:55"), (1, 3, None),
        (2, 0, "nada"), (2, 1, "10:55 z@x.org"), (3, 2, "q@x.org"), (None, 0, "a@x.org"),
    ]
    return spark.createDataFrame(texts, "doc_id long, chunk_index int, text string")


def test_runs_over_parts_number_as_one_run(spark, tmp_path):
    df = halves(spark).where("doc_id is not null")
    store = PseudonymStore(spark, str(tmp_path / "numbers"))
    whole = {(r.doc_id, r.chunk_index): r.text for r in pii.anonymise(df, "doc_id").collect()}
    first = store.anonymise(df.where("chunk_index < 2"), "one").collect()
    again = store.anonymise(df.where("chunk_index < 2"), "one").collect()  # a run that is repeated changes nothing
    assert sorted(first, key=repr) == sorted(again, key=repr)
    second = store.anonymise(df.where("chunk_index >= 2"), "two").collect()
    assert {(r.doc_id, r.chunk_index): r.text for r in [*first, *second]} == whole
    assert store.held().groupBy("doc_id", "kind", "n").count().where("count > 1").count() == 0
    back = spark.createDataFrame(second, "doc_id long, chunk_index int, text string, pii_map map<string,map<string,string>>")
    back = {(r.doc_id, r.chunk_index): r.back for r in back.withColumn("back", pii.restore(F.col("text"), F.col("pii_map"))).collect()}
    assert back == {(r.doc_id, r.chunk_index): r.text for r in df.where("chunk_index >= 2").collect()}
    assert {r.doc_id: len(r.pii_map["EMAIL_ADDRESS"]) for r in second if r.pii_map} == {1: 4, 3: 1}


def test_no_earlier_numbers(spark, tmp_path):
    store = PseudonymStore(spark, str(tmp_path / "numbers"))
    assert store.held().count() == 0
    assert store.anonymise(halves(spark).where("doc_id = 9"), "one").count() == 0


def files_in_order(folder, spark, batches, schema):
    for i, batch in enumerate(batches):
        before = set(folder.glob("part-*.parquet"))
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("part-*.parquet")) - before:  # files are read in the order of their times
            os.utime(f, (1_700_000_000 + i * 100,) * 2)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_a_batch_that_comes_again_is_handled_once(spark, tmp_path):
    kind = "document_id int, status string"
    (tmp_path / "in").mkdir()
    files_in_order(tmp_path / "in", spark, [[(1, "COMPLETED"), (2, "WAITING_FOR_REVIEW")], [(1, "UNDER_CONSTRUCTION")]], kind)
    parties = spark.createDataFrame([(1, "editor", 10), (2, "creator", 20)], "document_id int, role string, user_id int")
    auditors = spark.createDataFrame([(30,), (20,)], "user_id int")
    appended, broken = [], [True]

    def append(batch, n):
        appended.append(n)
        jobs.table_sink(str(tmp_path / "history"))(batch, n)

    def notify(batch, n):
        if n == 0 and broken.pop() if broken else False:
            raise RuntimeError("the mail server is away")
        jobs.table_sink(str(tmp_path / "told"))(batch, n)

    handle = jobs.kanban_batches(parties, auditors, append, notify, FileStore(spark, str(tmp_path / "ledger")))
    q = jobs.publish(stream(spark, tmp_path / "in", kind), handle, str(tmp_path / "ck"), once=True)
    with pytest.raises(Exception, match="mail server"):
        q.awaitTermination(120)
    assert not (tmp_path / "told").exists()
    q = jobs.publish(stream(spark, tmp_path / "in", kind), handle, str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(120) and appended == [0, 1]
    history = spark.read.parquet(str(tmp_path / "history"))
    assert sorted(tuple(r) for r in history.collect()) == [(1, "COMPLETED", 0), (1, "UNDER_CONSTRUCTION", 1), (2, "WAITING_FOR_REVIEW", 0)]
    told = sorted((r.document_id, r.user_id, r.batch) for r in spark.read.parquet(str(tmp_path / "told")).collect())
    assert told == [(1, 10, 0), (1, 10, 1), (2, 20, 0), (2, 30, 0)]


def test_messages_to_the_model_are_answered_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, "  hello\n there "), (2, "@Lumi  help")], "id int, content string")
    got = []
    handle = jobs.chat_batches(
        lambda asked: asked.withColumn("content", F.lit("yes")), lambda df, n: got.extend((n, r.id, r.content) for r in df.collect()),
        lambda df, n: got.append((n, "answers", df.count())), FileStore(spark, str(tmp_path / "ledger")),
    )
    for n in (0, 0, 1):
        handle(batch, n)
    assert [g[0] for g in got].count(0) == 3 and [g[0] for g in got].count(1) == 3
    assert (0, 1, "hello there") in got


def test_the_last_event_of_each_channel(spark, tmp_path):
    files_in = tmp_path / "in"
    files_in.mkdir()
    kind = "channel string, event string, ts timestamp"
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 0, m)
    files_in_order(files_in, spark, [[("a", "start", at(1)), ("b", "start", at(2))], [("a", "end", at(5))]], kind)
    q = jobs.progress(stream(spark, files_in, kind)).writeStream.outputMode("complete").format("memory").queryName("progress_now")
    assert q.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.channel, r.event) for r in spark.table("progress_now").collect()) == [("a", "end"), ("b", "start")]


def test_stale_keys_fail_and_silent_ones_are_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    (tmp_path / "in").mkdir()
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    kind = "doc string, state string, at timestamp"
    batches = [
        [("a", "QUEUED", at(0)), ("a", "PROCESSING", at(1)), ("b", "IDLE", at(0)), (None, "IDLE", at(0))],
        [("c", "IDLE", at(40)), ("d", "IDLE", at(41))],
        [("c", "PROCESSING", at(300))],
        [("c", "IDLE", at(301)), ("b", "PROCESSING", at(301))],
        [("b", "IDLE", at(400)), ("c", "QUEUED", at(302)), ("c", "IDLE", at(303))],
    ]
    files_in_order(tmp_path / "in", spark, batches, kind)
    steps = [("IDLE", "QUEUED"), ("QUEUED", "PROCESSING"), ("PROCESSING", "IDLE"), ("PROCESSING", "FAILED")]
    got = []
    out = jobs.supervised(stream(spark, tmp_path / "in", kind), "doc", "state", "at", steps, stale_ms=30 * 60_000, keep_ms=120 * 60_000)
    q = jobs.publish(out, lambda df, n: got.extend((*r,) for r in df.collect()), str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(240)
    seen = sorted((d, s, v, o) for d, s, _, v, o in got)
    assert seen == sorted([
        ("a", "QUEUED", True, False), ("a", "PROCESSING", True, False), ("a", "FAILED", True, True), ("b", "IDLE", True, False),
        ("c", "IDLE", True, False), ("c", "PROCESSING", True, False), ("c", "IDLE", True, False), ("d", "IDLE", True, False),
        ("b", "PROCESSING", True, False), ("b", "FAILED", True, True), ("b", "IDLE", False, False), ("c", "QUEUED", True, False),
        ("c", "IDLE", False, False),
    ])
    assert [a for d, s, a, _, _ in got if s == "FAILED"] == [at(31), at(331)]
    held = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    assert held[-1] < max(held)
