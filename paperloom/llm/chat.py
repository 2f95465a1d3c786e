"""Chat formatting: a hidden Markov model over speaker markers and line features recovers the roles of transcript lines by
Viterbi; turns are then rendered in one canonical form.

A line is an observation, its role the state. Between lines of a row without a marker a role mostly stays; at the start of
a row, or at a marker, it changes as turns do. Transcripts of any length decode exactly in stretches: each stretch is
summed up as a best-path matrix, the matrices of a transcript are chained, and stretches decode between known ends."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bounded_batches, cut, least_hashes, read

ROLES = ["system", "user", "assistant"]
STRETCH = 256  # lines in a stretch, up to its last row's
GROUP = 256  # matrices that are chained into one, level by level, until a transcript has no more of them
SLICE_ROWS = 64  # rows of a batch that are Python objects at once
TRAIN_ROWS = 4000  # labelled rows that training takes; the bound of the sample
TRAIN_TURNS = 256  # turns of a transcript that are drawn together
TRAIN_CHARS = 50_000  # longer rows are not drawn into the sample (they are formatted whole like all others)

# Speaker names, how markers are written, and the canonical form.
SPEAKERS = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0, "user": 1, "human": 1, "customer": 1, "question": 1,
    "q": 1, "prompter": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "answer": 2, "a": 2, "gpt": 2, "response": 2,
}
MARKER = re.compile(
    r"\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?\s*([A-Za-z]+)\s*(?:\|>|\]|\*\*)?(?:\s*:|\s*$|(?<=\|>)|(?<=\]))\s*(?:\*\*)?"
)
CANONICAL = "<|{role}|>\n{text}\n<|end|>"
SYMBOLS = 3 * 2 * 4  # length, question, first word class


def marker(line: str) -> tuple[int, int]:
    """(role, end of the marker) of a line that begins with a speaker marker, or (-1, 0)."""
    m = MARKER.match(line)
    if not m or (role := SPEAKERS.get(m[1].lower(), -1)) < 0:
        return -1, 0
    bare = m[0].strip().lower() == m[1].lower()  # a lone word is no marker
    return (-1, 0) if bare else (role, m.end())


ASKS = ("how ", "what ", "why ", "can ", "could ", "please ", "who ", "when ", "where ", "is ", "do ", "does ")
TELLS = ("sure", "certainly", "of course", "here ", "yes", "no,", "i ", "the ")
RULES = ("you are ", "you must", "always ", "never ", "act as", "your task", "respond ")


def symbol(line: str) -> int:
    """A line's features as one number: length, whether it asks, how it begins."""
    low = line.lstrip().lower()
    size = 0 if len(line) < 60 else 1 if len(line) < 400 else 2
    start = 1 if low.startswith(ASKS) else 2 if low.startswith(TELLS) else 3 if low.startswith(RULES) else 0
    return (size * 2 + low.rstrip().endswith("?")) * 4 + start


@dataclass
class Hmm:
    first: np.ndarray  # (roles,) log probabilities of a transcript's first line
    turn: np.ndarray  # (roles, roles) at a new turn
    stay: np.ndarray  # (roles, roles) within a turn
    emit: np.ndarray  # (roles, symbols)
    mark: np.ndarray  # (roles, markers + 1): which marker a turn's first line bears

    def step(self, line: str, opens: bool) -> np.ndarray:
        """(roles, roles): log potential of the role before and the role of this line."""
        role, _ = marker(line)
        trans = self.turn if opens or role >= 0 else self.stay
        return trans + (self.emit[:, symbol(line)] + self.mark[:, role + 1])[None, :]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def train(rows: Iterable[tuple[object, int, str | None, str | None]]) -> Hmm:
    """Counts, smoothed, over labelled rows (transcript, turn, role, text); rows of other roles are left out."""
    k = len(ROLES)
    first, turn, emit = np.ones(k), np.ones((k, k)), np.ones((k, SYMBOLS))
    mark = np.full((k, k + 1), 0.5) + np.c_[np.full(k, 20.0), 10 * np.eye(k)]
    last_id, last = object(), -1
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1], str(r[3]))):
        if role not in ROLES:
            continue
        y = ROLES.index(role)
        if c != last_id:
            first[y] += 1
        else:
            turn[last, y] += 1
        last_id, last = c, y
        for i, line in enumerate(lines_of(text)):
            emit[y, symbol(line)] += 1
            if i == 0:
                mark[y, marker(line)[0] + 1] += 1
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Hmm(log(first), log(turn), log(np.full((k, k), 0.002) + 0.994 * np.eye(k)), log(emit), log(mark))


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best-path product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def row_matrix(hmm: Hmm, text: str | None) -> np.ndarray:
    out = None
    for i, line in enumerate(lines_of(text)):
        m = hmm.step(line, i == 0)
        out = m if out is None else chained(out, m)
    return out


def decode(hmm: Hmm, texts: list[str | None], start: int, end: int) -> list[list[int]]:
    """Roles of the lines of each text on the best path from role ``start`` before the first line to ``end`` at the last.

    ``start`` -1: the texts begin a transcript."""
    steps = [(i, hmm.step(line, j == 0), line) for i, t in enumerate(texts) for j, line in enumerate(lines_of(t))]
    back, score = [], None
    for n, (_, m, _) in enumerate(steps):
        if n == 0:
            best = _opening(hmm, m) if start < 0 else m[start]
            back.append(None)
        else:
            all_ = score[:, None] + m
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0)
        score = best
    out: list[list[int]] = [[] for _ in texts]
    role = end
    for n in range(len(steps) - 1, -1, -1):
        out[steps[n][0]].append(role)
        if n:
            role = int(back[n][role])
    return [o[::-1] for o in out]


def _opening(hmm: Hmm, m: np.ndarray) -> np.ndarray:
    """The first line's scores: its transition gives way to how transcripts begin."""
    return hmm.first + (m - hmm.turn)[0]


def segments(text: str | None, roles: list[int]) -> list[dict]:
    """Turns of a row: runs of lines of one role (a marker begins a new one), without markers, trimmed."""
    out: list[dict] = []
    for line, role in zip(lines_of(text), roles, strict=True):
        own, end = marker(line)
        if not out or own >= 0 or ROLES[role] != out[-1]["role"]:
            out.append({"role": ROLES[role], "text": line[end:] if own >= 0 else line})
        else:
            out[-1]["text"] += "\n" + line
    return [{"role": s["role"], "text": s["text"].strip()} for s in out]


def fit(turns: DataFrame, train_rows: int = TRAIN_ROWS) -> Hmm:
    """A model from ``train_rows`` labelled rows: those of the pieces of transcripts (TRAIN_TURNS turns each) with the least
    hashes, the same however the table is partitioned; a hot transcript is drawn piece by piece."""
    fit = F.col("role").isin(ROLES) & (F.coalesce(F.char_length("text"), F.lit(0)) <= TRAIN_CHARS)
    piece = F.struct(F.col("conv_id").cast("string").alias("c"), F.floor(F.col("turn") / TRAIN_TURNS).cast("long").alias("s"))
    own = turns.select(piece.alias("piece"), F.col("turn").alias("at"), "role", "text")
    rows = least_hashes(own, fit, [F.col("piece"), F.lit(1)], train_rows, ["piece", "at", "text"]).collect()
    return train([((r["piece"]["c"], r["piece"]["s"]), r["at"], r["role"], r["text"]) for r in rows])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text, c, n, s): the transcript as a string, how many of its lines come before a row, its stretch."""
    conv = F.col("conv_id").cast("string").alias("c")
    rows = turns.select("conv_id", "turn", F.col("text").cast("string").alias("text"), conv, F.monotonically_increasing_id().alias("u"))
    keys = [F.col(x).asc_nulls_first() for x in ("c", "turn", "text", "u")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slice's number, and how many lines of a row's transcript come before it in the slice."""
        slice_, key, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            before, size = [], []
            for c, x in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), strict=True):
                key, n = c, n if c == key else 0
                before.append(n)
                size.append(len(lines_of(x)))
                n += size[-1]
            more = [pa.array([slice_] * len(size), pa.int64()), pa.array(before, pa.int64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "p", "i", "w"])

    sliced = cut(placed.mapInArrow(count, f"{own}, p long, i long, w long").drop("u"))
    ahead = F.sum("w").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each slice that goes on with the transcript of the slice before it
    offset = sliced.groupBy("c", "p").agg(F.sum("w").alias("w")).withColumn("o", ahead).where("o > 0")
    offset = F.broadcast(offset.select(F.col("c").alias("c1"), F.col("p").alias("p1"), "o"))
    dealt = sliced.join(offset, F.col("c").eqNullSafe(F.col("c1")) & (F.col("p") == F.col("p1")), "left")
    dealt = dealt.withColumn("n", F.col("i") + F.coalesce("o", F.lit(0))).drop("c1", "p1", "o", "p", "i", "w")
    return dealt.withColumn("s", F.floor(F.col("n") / STRETCH).cast("long"))


def format_chats(turns: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, turn, role_pred, segments, rendered) of each row of ``turns`` (conv_id, turn, text).

    Rows of a transcript follow each other by turn, then text; roles in the input are not used. ``segments`` are a row's
    turns (role, text), ``rendered`` their canonical form, ``role_pred`` the first one's role. A null text is empty: one
    empty line; a null conv_id is a transcript of its own name; null turns come first; repeated rows follow each other.
    Other columns take no part; an empty table gives an empty one.

    Rows are numbered by counts of lines in range-partitioned slices and running offsets, and dealt by transcript and
    stretch of STRETCH lines, whatever the turn numbers are, so a transcript of any length is shared by many tasks; between
    the passes only a matrix of three by three for each stretch travels, and GROUP of them are chained into one, level by
    level, so no task meets all of a transcript's. Memory: an Arrow batch of bounded rows, of which SLICE_ROWS at a time are
    Python objects, and the rows of one stretch, which may end in a longer row."""
    bounded_batches(turns.sparkSession)
    k = len(ROLES)
    shared = turns.sparkSession.sparkContext.broadcast(hmm)
    dealt = numbered(turns)
    order = [F.col("c").asc_nulls_first(), "s", "n"]

    def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
        """Consecutive rows of equal keys, across batches."""
        key, held = None, []
        for b in batches:
            for i in range(0, b.num_rows, SLICE_ROWS):
                for r in b.slice(i, SLICE_ROWS).to_pylist():
                    now = tuple(r[x] for x in keys)
                    if held and now != key:
                        yield key, held
                        held = []
                    key = now
                    held.append(r)
        if held:
            yield key, held

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = shared.value, []
        for (c, s), own in runs(batches, ["c", "s"]):
            total = opening = None
            for r in own:
                x = row_matrix(m, r["text"])
                if opening is None:
                    first = lines_of(r["text"])
                    opening = _opening(m, m.step(first[0], True))
                    for line in first[1:]:
                        opening = (opening[:, None] + m.step(line, False)).max(axis=0)
                else:
                    opening = (opening[:, None] + x).max(axis=0)
                total = x if total is None else chained(total, x)
            out.append({"c": c, "s": s, "m": total.ravel().tolist(), "o": opening.tolist()})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, _SUMS)
                out = []
        yield pa.RecordBatch.from_pylist(out, _SUMS)

    _SUMS = pa.schema([("c", pa.string()), ("s", pa.int64()), ("m", pa.list_(pa.float64())), ("o", pa.list_(pa.float64()))])  # noqa: N806
    _ENDS = pa.schema([("c", pa.string()), ("s", pa.int64()), ("a", pa.int32()), ("z", pa.int32())])  # noqa: N806

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One matrix and opening for each (c, g) out of those of its stretches."""
        out = []
        for (c, g), own in runs(batches, ["c", "g"]):
            total, opening = np.array(own[0]["m"]).reshape(k, k), np.array(own[0]["o"])
            for r in own[1:]:
                m = np.array(r["m"]).reshape(k, k)
                total, opening = chained(total, m), (opening[:, None] + m).max(axis=0)
            out.append({"c": c, "s": g, "m": total.ravel().tolist(), "o": opening.tolist()})
        yield pa.RecordBatch.from_pylist(out, _SUMS)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The roles before and at the end of each stretch on the best path between the roles before and at the end of its
        group: ``a`` (-1: the transcript begins) and ``z`` (-1: it ends)."""
        out = []
        for (c, _), own in runs(batches, ["c", "g"]):
            a, z = own[0]["a"], own[0]["z"]
            score, back = np.array(own[0]["o"]) if a < 0 else np.array(own[0]["m"]).reshape(k, k)[a], []
            for r in own[1:]:
                all_ = score[:, None] + np.array(r["m"]).reshape(k, k)
                back.append(all_.argmax(axis=0))
                score = all_.max(axis=0)
            role = int(score.argmax()) if z < 0 else z
            for i in range(len(own) - 1, -1, -1):
                before = int(back[i - 1][role]) if i else a
                out.append({"c": c, "s": own[i]["s"], "a": before, "z": role})
                role = before
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, _ENDS)
                out = []
        yield pa.RecordBatch.from_pylist(out, _ENDS)

    stretches = dealt.select("c", "s", "n", "text").repartition("c", "s").sortWithinPartitions(*order)
    matrices = "c string, s long, m array<double>, o array<double>"
    levels = [cut(stretches.mapInArrow(sums, matrices), "matrices")]
    by_group = [F.col("c").asc_nulls_first(), "g", "s"]

    def grouped(level: DataFrame) -> DataFrame:
        return level.withColumn("g", F.floor(F.col("s") / GROUP))

    while (levels[-1].groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > GROUP:
        up = grouped(levels[-1]).repartition("c", "g").sortWithinPartitions(*by_group).mapInArrow(fold, matrices)
        levels.append(cut(up, "matrices"))
    top = levels.pop().withColumns({"g": F.lit(0).cast("long"), "a": F.lit(-1), "z": F.lit(-1)})
    known = top.repartition("c").sortWithinPartitions(*by_group).mapInArrow(ends, "c string, s long, a int, z int")
    while levels:
        named = known.select(F.col("c").alias("c2"), F.col("s").alias("g2"), "a", "z")
        own = grouped(levels.pop()).join(named, F.col("c").eqNullSafe(F.col("c2")) & (F.col("g") == F.col("g2"))).drop("c2", "g2")
        known = own.repartition("c", "g").sortWithinPartitions(*by_group).mapInArrow(ends, "c string, s long, a int, z int")
    known = known.select(F.col("c").alias("c2"), F.col("s").alias("s2"), "a", "z")
    both = dealt.join(known, F.col("c").eqNullSafe(F.col("c2")) & (F.col("s") == F.col("s2"))).drop("c2", "s2")
    both = both.repartition("c", "s").sortWithinPartitions(*order)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        schema = None
        out: list[dict] = []

        def flush():
            return pa.RecordBatch.from_pylist(out, schema)

        def watched():
            nonlocal schema
            for b in batches:
                if schema is None:
                    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                    at = b.schema
                    schema = pa.schema(
                        [at.field("conv_id"), at.field("turn"), ("role_pred", pa.string()), ("segments", kind), ("rendered", pa.string())]
                    )
                yield b

        for _, own in runs(watched(), ["c", "s"]):
            roles = decode(m, [r["text"] for r in own], own[0]["a"], own[0]["z"])
            for r, y in zip(own, roles, strict=True):
                parts = segments(r["text"], y)
                out.append(
                    {"conv_id": r["conv_id"], "turn": r["turn"], "role_pred": parts[0]["role"], "segments": parts,
                     "rendered": "\n".join(CANONICAL.format(**p) for p in parts)}
                )
            if len(out) >= 2000:
                yield flush()
                out = []
        if schema is not None:
            yield flush()

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    return both.mapInArrow(
        render,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role_pred string, "
        "segments array<struct<role:string,text:string>>, rendered string",
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` with its first role, number of turns and canonical form; cases as format_chats() says."""
    turns = read(spark, sf_dir, "conversations")
    out = format_chats(turns.select("conv_id", "turn", "text"), fit(turns))
    return out.select("conv_id", "turn", "role_pred", F.size("segments").alias("n_segments"), "rendered")
