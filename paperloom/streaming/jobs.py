"""Streaming jobs: status feeds, progress, fan-out, chat; windows as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import clean
from paperloom.operators.context import mentions_model, notifications
from paperloom.sources.store import FileStore

EVENT = "channel string, event string, message string, payload string, ts timestamp"


def feed(spark: SparkSession, path: str, schema: str = EVENT, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def publish(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Hand each batch to ``deliver``; with ``once`` what is there now, then stop."""
    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(events: DataFrame) -> DataFrame:
    """The last event and time of each channel, as a running table (update or complete mode)."""
    return events.groupBy("channel").agg(F.max_by("event", "ts").alias("event"), F.max("ts").alias("ts"))


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: events a window and kind, for events at most ``late`` behind; state of closed windows goes."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: events of each key's sessions."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


Step = Callable[[DataFrame, int], None]


def in_steps(ledger: FileStore, *steps: tuple[str, Step]) -> Step:
    """A batch handler that takes named steps one after the other, each once for a batch number.

    A step that is done is noted in ``ledger``, a folder that lives as long as the stream's checkpoint. A batch that comes
    again after a failure goes on with the first step not noted: of the failed step alone its own work may be seen twice,
    and a sink that replaces what the batch wrote before (table_sink()) leaves no trace of that."""

    def handle(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            for name, step in steps:
                note = f"{n:012d}-{name}"
                if not ledger.exists(note):
                    step(held, n)
                    ledger.save(note, b"")
        finally:
            held.unpersist()

    return handle


def table_sink(path: str) -> Step:
    """A step that writes a batch as Parquet in a folder of its own, which it replaces when the batch comes again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return write


def chat_batches(answer: Callable[[DataFrame], DataFrame], store: Step, store_answers: Step, ledger: FileStore) -> Step:
    """A batch handler: messages are stored, those that mention the model are answered, answers stored too, each once."""

    def cleaned(batch: DataFrame) -> DataFrame:
        return batch.withColumn("content", clean(F.col("content")))

    def answers(batch: DataFrame, n: int) -> None:
        store_answers(answer(cleaned(batch).where(mentions_model(F.col("content")))), n)

    return in_steps(ledger, ("messages", lambda batch, n: store(cleaned(batch), n)), ("answers", answers))


def kanban_batches(parties: DataFrame, auditors: DataFrame, append: Step, notify: Step, ledger: FileStore) -> Step:
    """A batch handler: status changes (document_id, status) are appended to the history, then their notifications, by the
    rules of notifications(), handed on; each once for a batch."""

    def told(batch: DataFrame, n: int) -> None:
        notify(notifications(batch, parties, auditors), n)

    return in_steps(ledger, ("history", append), ("notifications", told))


def state_machine(events: DataFrame, key: str, state: str, time: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """(key, state, valid) of each change of a stream: whether the change from the key's last state is allowed.

    Keyed state is one string; a key's first change is valid. The changes of a key in one trigger are put in order of time
    together: what a trigger reads (``per_trigger`` of feed()) bounds them."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    steps = set(allowed)

    def update(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        states = pd.concat(list(batches)).sort_values(time, kind="stable")[state].tolist()
        before = [last, *states[:-1]]
        valid = [a is None or (a, b) in steps for a, b in zip(before, states, strict=True)]
        held.update((states[-1],))
        yield pd.DataFrame({key: k[0], state: states, "valid": valid})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {state} string, valid boolean", "last string", "append", GroupStateTimeout.NoTimeout
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUPERVISED = "state string, at timestamp, valid boolean, timed_out boolean"


def supervised(
    events: DataFrame, key: str, state: str, time: str, allowed: list[tuple[str, str]], busy: str = "PROCESSING",
    failed: str = "FAILED", stale_ms: int = 1_800_000, keep_ms: int = 86_400_000, late: str = "1 minute",
) -> DataFrame:
    """(key, state, at, valid, timed_out) of each change of a stream, with an end to what is kept of a key.

    A key that is ``busy`` and says nothing for ``stale_ms`` of event time becomes ``failed`` by a timer (timed_out); a key
    that says nothing for ``keep_ms`` more is forgotten, so state follows the keys that are alive, not all ever seen. A
    forgotten key begins anew: its next change is valid. Changes of a key in one trigger are put in order of time; those
    older than what the key last said are valid by the order in which they come. Rows without key, state or time go."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers need it
    name, steps = key, set(allowed)

    class Supervisor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "state string, ms bigint")

        def out(self, k: tuple, states: list[str], ms: list[int], valid: list[bool], timed_out: bool) -> pd.DataFrame:
            at = pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")
            return pd.DataFrame({name: [k[0]] * len(states), "state": states, "at": at, "valid": valid, "timed_out": timed_out})

        def keep(self, now: str, ms: int, due: int) -> None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.last.update((now, ms))
            self.handle.registerTimer(due)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            pdf = pd.concat(list(rows)).sort_values("ms", kind="stable")
            states, ms = pdf["said"].tolist(), [int(x) for x in pdf["ms"]]
            last = self.last.get() if self.last.exists() else None
            # timers of this trigger come after its rows: what was due before the first of them is made up for here
            if last and last[0] == busy and ms[0] >= last[1] + stale_ms:
                last = (failed, last[1] + stale_ms)
                yield self.out(key, [failed], [last[1]], [(busy, failed) in steps], True)
            if last and last[0] != busy and ms[0] >= last[1] + keep_ms:
                last = None
            before = [last[0] if last else None, *states[:-1]]
            at = max(ms[-1], last[1] if last else ms[-1])
            self.keep(states[-1], at, at + (stale_ms if states[-1] == busy else keep_ms))
            yield self.out(key, states, ms, [a is None or (a, b) in steps for a, b in zip(before, states, strict=True)], False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            now, _ = self.last.get()
            due = expiredTimerInfo.getExpiryTimeInMs()
            if now == busy:
                self.keep(failed, due, due + keep_ms)
                yield self.out(key, [failed], [due], [(busy, failed) in steps], True)
            else:
                self.last.clear()

        def close(self) -> None:
            pass

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(state).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(key), F.col(state).alias("said"), F.unix_millis(time).alias("ms"), F.col(time))
    return rows.groupBy(key).transformWithStateInPandas(Supervisor(), f"`{key}` {kind}, {SUPERVISED}", "append", "eventTime")
