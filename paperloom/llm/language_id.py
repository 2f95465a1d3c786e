"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated scores and rejection."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, read, released, strings

TRAIN_ROWS = 6000  # labelled rows that training takes in all; the bound of the sample
DICE = 1 << 40  # values of the hash that draws the sample: a share of the largest tables is still told apart from none
TRAIN_CHARS = 50_000  # longer texts are not drawn into the sample (they are predicted whole like all others)
BUCKETS_LOG2 = 16
DIM = 16
ORDERS = (1, 2, 3, 4)  # characters of a subword
EPOCHS, STEP = 6, 0.5
REJECT_SHARE = 0.002  # of held-back labelled rows that rejection may cost
MOST_THRESHOLD = 0.5  # rejection never asks for more
CHUNK = 1 << 18  # code points worked on at a time

_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _ALPHA[0]


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Letters of the text, lower-cased, and a blank for each run of others, a chunk at a time, between two blanks.

    Nothing for a text without letters."""
    low, found, before = text.lower(), False, True
    pending = [np.array([32], np.uint64)]
    for i in range(0, len(low), CHUNK):
        x = np.frombuffer(low[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _letters()[x]
        keep = alpha.copy()
        keep[1:] |= alpha[:-1]
        keep[0] |= before
        before, found = alpha[-1], found or alpha.any()
        pending.append(np.where(alpha, x, 32)[keep].astype(np.uint64))
        if i + CHUNK >= len(low):
            pending.append(np.array([32], np.uint64))
        if found:
            yield np.concatenate(pending)
            pending = []


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all subwords of the text, a chunk at a time; memory follows the chunk, not the text."""
    tail = np.empty(0, np.uint64)
    for x in _symbols(text or ""):
        x = np.concatenate([tail, x])
        out, h = [], np.zeros(len(x), np.uint64)
        for n in ORDERS:
            y = x[n - 1 :]
            h = h[: len(y)] * _A[0] + (y + np.uint64(n)) * _A[1]
            new = h[max(0, len(tail) - n + 1) :]  # those that end before were in the last chunk
            out.append(((new ^ (new >> np.uint64(29))) * _A[2] >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
        yield np.concatenate(out)
        tail = x[1 - ORDERS[-1] :]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages): what each subword adds to the mean
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for b in subwords(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return "und", 0.0
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Fit on four fifths of the rows, calibrate temperature and rejection threshold on the rest."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    rows = []
    for t, label in zip(texts, labels, strict=True):
        if got := list(subwords(t)):
            b, c = np.unique(np.concatenate(got), return_counts=True)
            # buckets fit 16 bits, counts of a sampled text nearly always: the driver holds four bytes for each subword
            rows.append((b.astype(np.uint16), np.minimum(c, 65535).astype(np.uint16), langs.index(label)))
    emb = np.zeros((1 << BUCKETS_LOG2, DIM), np.float32)  # subwords that no row shows say nothing: strange texts score low
    w = rng.normal(0, 0.1, (DIM, max(1, len(langs)))).astype(np.float32)
    bias = np.zeros(max(1, len(langs)), np.float32)
    held = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 50 else rows
    fit = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    gain = 20.0  # means of embeddings are small; their gradient is scaled to match
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            b, c, y = fit[i]
            c = c / np.float32(c.sum())
            h = c @ emb[b]
            g = _softmax(h @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= step * np.outer(h, g)
            bias -= 0.05 * step * g
            emb[b] -= step * gain * np.outer(c, back)
    model = Model(langs, (emb @ w).astype(np.float32), bias.astype(np.float64))
    z = np.array([(r[1] / np.float32(r[1].sum())) @ model.table[r[0]] + model.bias for r in held])
    y = np.array([r[2] for r in held])
    if len(langs) > 1 and len(held):
        # targets are smoothed by their number (Platt's rule): held-back rows without an error don't ask for certainty
        rest = 1 / (len(y) + 2)
        goal = np.full(z.shape, rest / (len(langs) - 1))
        goal[np.arange(len(y)), y] = 1 - rest
        loss = {t: -(goal * np.log(_softmax(z / t) + 1e-12)).sum() for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = min(MOST_THRESHOLD, float(right[math.floor(REJECT_SHARE * len(right))]))
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from a sample of ``train_rows`` labelled rows at most, alike many from each language: those with the least
    hashes of doc_id and text among rows whose crc32(doc_id as text) mod 4 is not 2 and whose text has at most TRAIN_CHARS
    code points. Rows of equal id and text count once, in the sample and in the numbers that set its shares. All languages
    are learnt, one row each at least; were there more of them than ``train_rows``, those with the most rows. Rows and
    lengths bound what the driver collects, whatever ids repeat or are null."""
    own = docs.where(F.col("lang").isNotNull() & (F.char_length("text") <= TRAIN_CHARS) & ~held_out())
    n = F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02)  # the same however rows are dealt
    by = own.groupBy("lang").agg(n.alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows)
    counts = {r["lang"]: max(1, r["n"]) for r in by.collect()}
    if not counts:
        return Model([], np.zeros((1 << BUCKETS_LOG2, 0), np.float32), np.zeros(0))
    each = max(1, train_rows // len(counts))
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2 * each / n) * DICE))])
    dice = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(DICE))
    drawn = own.select("doc_id", "text", "lang", dice.alias("dice")).where(F.col("dice") < F.element_at(most, F.col("lang")))
    drawn = drawn.groupBy("lang", "dice", "doc_id").agg(F.min("text").alias("text"))
    least = Window.partitionBy("lang").orderBy("dice", F.col("doc_id").asc_nulls_last())
    rows = drawn.withColumn("at", F.row_number().over(least)).where(F.col("at") <= each).select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    model = train([r["text"] for r in rows], [r["lang"] for r in rows])
    del rows
    released()
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``accepted`` (score at or over the model's threshold).

    A null text, or one without a letter, is ``und`` with score 0 and not accepted; so is every text of a model without
    languages (nothing labelled). Repeated rows get equal results; an empty table stays empty; columns of the result's
    names (all begin with ``prefix``) are replaced. The model (a few MB, fixed by BUCKETS_LOG2 and the number of
    languages) is broadcast; texts are read whole where they are, without a shuffle."""
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in strings(b.column(b.schema.get_field_index("text")))]
            more = [
                pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[0] != "und" and g[1] >= m.threshold for g in got], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])
        released()

    return arrow_map(docs, predict, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean", drop=tuple(names))


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language a model trained on them accepts; columns as they are.

    Null texts and texts without a letter are rejected, and so are all rows where nothing is labelled. Repeated rows fare
    alike; rows without an id are predicted like others; an empty table stays empty."""
    found = identify(docs, fit(docs, train_rows), prefix="__pl_")
    return found.where("__pl_accepted").select(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; cases as identify() says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
