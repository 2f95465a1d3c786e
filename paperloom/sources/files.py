"""Readers and writers: texts, DOCX, spans, JSON result stores, vector and report sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas

SUFFIX = r"\.([A-Za-z0-9]+)$"
KNOWN = ["txt", "docx", "pdf"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row a UTF-8 file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.DOTALL)
    lines = ["".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in paragraphs]
    text = "\n".join(lines)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(name, char)
    return text


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, error): one row a DOCX file; unreadable ones have a null text and say why."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((p.rsplit("/", 1)[-1], docx_text(c), None))
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
                    rows.append((p.rsplit("/", 1)[-1], None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    return files.mapInPandas(run, "source string, text string, error string")


def route(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files of known kinds with ``kind``, and the others with ``error`` (the dead letters)."""
    kind = F.lower(F.regexp_extract(path, SUFFIX, 1))
    marked = files.withColumn("kind", kind)
    good = marked.where(F.col("kind").isin(KNOWN))
    bad = marked.where(~F.col("kind").isin(KNOWN)).withColumn("error", F.concat(F.lit("unsupported extension: "), F.col("kind")))
    return good, bad


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of PDF pages, extracted beforehand."""
    return spark.read.schema(schemas.WORDS).parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SPANS).parquet(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON results by key; unreadable records are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def result(store: DataFrame, key: str, column: str = "doc_id", order: str = "saved_at") -> DataFrame:
    """The last result saved under a key."""
    return store.where(F.col(column) == key).orderBy(F.desc(order)).limit(1)


def result_keys(store: DataFrame, column: str = "doc_id") -> DataFrame:
    """The keys under which results are saved, each once, in order."""
    return store.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """The vector sink: chunks by source, so that reads of one source touch its files only."""
    chunks.write.mode("append").partitionBy("source").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (root, j, k, line) in display order as text."""
    lines.orderBy("root", "j", "k").select("line").write.mode("overwrite").text(path)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files in a folder, sorted."""
    names = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.orderBy("name")


def chosen_template(wanted: Column, names: Column, default: str) -> Column:
    return F.when(F.array_contains(names, wanted), wanted).otherwise(F.lit(default))


def upload_name(doc_id: Column, suffix: Column, default: str = ".pdf") -> Column:
    clean = F.regexp_replace(doc_id, r"[^\p{L}\p{N}_-]", "")
    return F.concat(clean, F.coalesce(F.nullif(suffix, F.lit("")), F.lit(default)))
