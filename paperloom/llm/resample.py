"""Importance resampling towards a target distribution: a sparse matrix of documents by hashed n-gram buckets is kept as
blocks of compressed rows; its column sums are the distributions, its product with the vector of gains the weights."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bounded_batches, cut, in_order, read

BUCKETS = 10_000
RUN = 1  # longest run of words that is a feature
MIN_WORDS = 20  # shorter documents are never drawn
PERCENT = 10  # of the documents long enough, so many in a hundred are drawn
SEED = "2024"
BLOCK_DOCS = 64  # documents of a block at most
BLOCK_ENTRIES = 1 << 10  # a block ends with the document that reaches so many entries: readers hold thousands of blocks at once

#: a word in the UTF-8 bytes of a text whose A-Z are lower-cased: digits, letters a to z and all beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_BLOCK = pa.schema(
    [("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
     ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)
_BLOCK_SQL = "ids array<long>, n_words array<long>, starts array<long>, buckets array<int>, counts array<int>"


def features(words: list[bytes], run: int) -> Iterator[bytes]:
    yield from words
    for k in range(2, run + 1):
        for i in range(len(words) - k + 1):
            yield b" ".join(words[i : i + k])


def count_blocks(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """The count matrix of ``texts`` (id long, text) as a written table of blocks of compressed rows: of each block the ids
    and numbers of words of its documents, where each one's entries start, and the entries' buckets and counts.

    Documents of a task share blocks in the order in which they come. A null text has no words; null and repeated ids have
    rows of their own. Memory: one block and one text; a document has at most as many entries as there are buckets."""
    bounded_batches(texts.sparkSession)
    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            cols = [ids, words_of, starts, at, n]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, _BLOCK, strict=True)], schema=_BLOCK)

        ids, words_of, starts, at, n = [], [], [0], [], []
        for b in batches:
            for i in range(b.num_rows):
                words = WORD.findall((b.column(1)[i].as_py() or b"").lower())
                held: Counter[int] = Counter()
                for f, c in Counter(features(words, run)).items():
                    held[zlib.crc32(f) % buckets] += c
                ids.append(b.column(0)[i].as_py())
                words_of.append(len(words))
                at.extend(held.keys())
                n.extend(held.values())
                starts.append(len(at))
                if len(ids) >= BLOCK_DOCS or len(at) >= BLOCK_ENTRIES:
                    yield block()
                    ids, words_of, starts, at, n = [], [], [0], [], []
        if ids:
            yield block()

    return cut(rows.mapInArrow(run_blocks, _BLOCK_SQL), "blocks")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each bucket over all documents: one vector a task, added up by bucket; ``buckets`` bounds what comes back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    parts = blocks.select("buckets", "counts").mapInArrow(add, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    ratio = [((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k)) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of each document: the floored mean of its features' gains, 0 without features. Blocks
    are multiplied with the vector where they lie, those of an Arrow batch at once."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words_of, starts, at, n = (b.column(j).flatten() for j in range(5))
            n, entries = n.to_numpy().astype(np.int64), np.diff(starts.to_numpy())
            last = np.cumsum(pc.list_value_length(b.column(2)).to_numpy())[:-1] - 1  # from a block's end to the next one's start
            starts = np.concatenate([[0], np.cumsum(np.delete(entries, last))])
            sums = np.concatenate([[0], np.cumsum(n * gain[at.to_numpy()])])
            held = np.concatenate([[0], np.cumsum(n)])
            size = held[starts[1:]] - held[starts[:-1]]
            weight = (sums[starts[1:]] - sums[starts[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([ids, words_of, pa.array(size, pa.int64()), pa.array(weight, pa.int64())], names=names)

    names = ["id", "n_words", "n_features", "weight"]
    return blocks.mapInArrow(product, "id long, n_words long, n_features long, weight long")


def weights_towards(texts: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """weights() of ``texts`` (id, text) by gains of the texts of ``target`` over them."""
    own = count_blocks(texts, buckets, run)
    wanted = count_blocks(target.select(F.lit(None).cast("long").alias("id"), "text"), buckets, run)
    return weights(own, gains(column_sums(own, buckets), column_sums(wanted, buckets)))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise that a hash of the id draws; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_ranks(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, min_words: int = MIN_WORDS, percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``; rank is null for rows that are not drawn.

    Features are runs of 1 to ``run`` words, hashed into buckets; weights compare the texts of ``target`` with those of
    ``docs``; a score is weight and noise by doc_id. Of the N rows with at least ``min_words`` words, floor(percent * N /
    100) with the highest scores are drawn, equal ones by doc_id, then n_features, then weight, least first and null ids
    last: without replacement. Null texts have no words (weight 0); repeated rows count and are drawn each by itself; other
    columns take no part; no documents give no rows, no target texts a distribution of smoothing alone.

    What travels of a document is its id and five numbers; rows are ranked in slices of a range partitioning (in_order())."""
    weight = weights_towards(docs.select(F.col("doc_id").alias("id"), "text"), target, buckets, run)
    scored = weight.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = cut(scored, "scores")
    long_enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(long_enough).count() // 100
    order = [(~long_enough).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = in_order(scored, order, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank)


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, min_words: int = MIN_WORDS, percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` that importance_ranks() draws, with their columns and ``rank`` (which replaces one of that name).

    Rows are told apart by a number of their own, so rows that share an id are drawn one by one; noise stays by doc_id."""
    numbered = cut(docs.drop("rank").withColumn("__pl_u", F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.col("__pl_u").alias("id"), F.col("doc_id").alias("__pl_d"), "text")
    weight = weights_towards(ids.drop("__pl_d"), target, buckets, run).where(F.col("n_words") >= min_words)
    scored = weight.join(ids.drop("text"), "id").withColumn("score", F.col("weight") + noise(F.col("__pl_d"), seed))
    scored = cut(scored, "scores")
    order = [F.col("score").desc(), F.col("__pl_d").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = in_order(scored, order, "place").where(F.col("place") < percent * scored.count() // 100)
    ranks = placed.select(F.col("id").alias("__pl_u"), (F.col("place") + 1).cast("long").alias("rank"))
    return numbered.join(ranks, "__pl_u").drop("__pl_u")


def op13_resample(spark, sf_dir: str) -> DataFrame:
    """Every document's weight towards ``benchmark`` and its rank among those drawn; cases as importance_ranks() says."""
    return importance_ranks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"('0x' || substr(hex(encode({text})), cast(2 * i + 1 as int), 2))::bigint"
    bits = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    held = f"list_concat([4294967295::bigint], list_transform(range(0, strlen({text})), lambda i: {byte}))"
    return f"xor(list_reduce({held}, lambda a, b: {bits}), 4294967295::bigint)"


def _words_sql(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"select {key}, unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from {table}"


OP13_SQL = f"""
with own as ({_words_sql("documents", "doc_id")}), wanted as ({_words_sql("benchmark", "item_id")}),
words as (select distinct word from (select word from own union all select word from wanted)),
hashed as (select word, {crc32_sql("word")} % {BUCKETS} as bucket from words),
counts as (select doc_id, bucket, count(*) as n from own join hashed using (word) group by all),
source as (select bucket, sum(n) as s from counts group by bucket),
target as (select bucket, count(*) as t from wanted join hashed using (word) group by bucket),
totals as (select (select coalesce(sum(s), 0)::double from source) as s_all, (select coalesce(sum(t), 0)::double from target) as t_all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {BUCKETS}) / ((s + 1)::double * (t_all + {BUCKETS}))))::bigint as gain
  from source left join target using (bucket), totals
), weights as (
  select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight
  from counts join gains using (bucket) group by doc_id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from documents left join weights using (doc_id)
), drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= {MIN_WORDS}
)
select doc_id, n_features, weight, score, case when r <= {PERCENT} * n // 100 then r end as rank
from scored left join drawn using (doc_id)
"""
