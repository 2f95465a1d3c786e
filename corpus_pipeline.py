"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of ``documents``; ``n_chars`` follows the text.

Of odd rows: a null text, or one without a letter, is rejected by the first stage; rows without a doc_id pass all stages
(they are no one's near-duplicate); of rows that share a doc_id unlike texts all stay in the third; very long texts are treated
whole; extra columns, of whatever name, stay up to the last stage, which returns its own; an empty table gives an empty
one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, language_id, line_dedup, setsketch
from paperloom.llm.common import cut, read


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go; the documents stay, empty if need be."""
    return _counted(line_dedup.dedup_lines(docs).select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id."""
    return setsketch.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that hold little else go."""
    return _counted(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers) of each text, and what they decode to."""
    out = bpe.encode_bpe(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", "lang", "source", n, "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontaminate", benchmark),
    ("bpe", tokens),
]

#: Language ID has no SQL form. Tests hold stages 2 to 5 against plain Python and the tokenizers library, each on its own
#: input; of language ID they test what it rejects and how much it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
