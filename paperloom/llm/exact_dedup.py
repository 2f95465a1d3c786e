"""Exact dedup by skew-safe combining, in DataFrame operations only: equal texts are combined in each task, then in salted
groups of their digest, then the salts' winners over all; every stage groups by the whole text beside the digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import HEAVY_KEYS, cut, heavy_join, read

SALTS = 32  # partial groups of one text that the salted stage leaves, at most


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def same(text: Column) -> Column:
    """The normalisation that changes nothing."""
    return text


def _rows(docs: DataFrame, normal: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    text = docs.select(F.col("doc_id").alias("__pl_d"), normal(F.coalesce(F.col("text"), F.lit(""))).alias("__pl_x"))
    return text.withColumn("__pl_g", digest(F.col("__pl_x")))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, largest id, rows) of each distinct text of ``rows``, dealt by digest.

    The first grouping combines equal texts of a task before anything travels; its salt is the task's own number, so a text
    of any task is one partial row, and a text of a third of all rows meets itself in ``salts`` tasks. The second combines
    at most ``salts`` winners of a text."""
    salted = rows.withColumn("__pl_s", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("__pl_g", "__pl_s", "__pl_x").agg(F.max("__pl_d").alias("__pl_k"), F.count(F.lit(1)).alias("__pl_n"))
    dealt = winners.repartition("__pl_g")
    return dealt.groupBy("__pl_g", "__pl_x").agg(F.max("__pl_k").alias("__pl_k"), F.sum("__pl_n").alias("__pl_n"))


def digest_groups(rows: DataFrame, salts: int = SALTS) -> tuple[DataFrame, int, int]:
    """The written table (digest, texts, largest id, rows), how many rows it stands for, and how many digests stand for
    more than one text, by comparison of whole texts."""
    by_text = combine(rows, salts)
    found = by_text.groupBy("__pl_g").agg(
        F.count(F.lit(1)).alias("__pl_t"), F.max("__pl_k").alias("__pl_k"), F.sum("__pl_n").alias("__pl_n")
    )
    found = cut(found, "digests")
    n, clashes = found.agg(F.coalesce(F.sum("__pl_n"), F.lit(0)), F.count_if(F.col("__pl_t") > 1)).first()
    return found, n, clashes


def exact_groups(
    docs: DataFrame,
    normal: Callable[[Column], Column] = same,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when ``normal`` makes them the same text; a null text counts as empty. keep_id is the largest doc_id of
    the group (null where no row has one), group_size counts its rows, text_sha256 is of the normalised text. kept:
    doc_id is keep_id; so rows that repeat both id and text all say so, and a row without an id is kept only where no equal
    row has one. Other columns take no part; an empty table gives an empty one.

    Texts travel twice, after tasks have combined their own: to the salted groups, and those groups' winners to their
    digest. The comparison there tells which digests stand for one text alone, so rows then meet their group by digest; rows
    of any other digest meet it by digest and whole text. Groups of more than a ``heavy_keys``-th of all rows, hence
    bounded in number, are broadcast; no other key is hot."""
    rows = _rows(docs, normal, digest)
    found, n, clashes = digest_groups(rows, salts)
    sha = F.sha2(F.col("__pl_x").cast("binary"), 256)
    own = rows.select("__pl_d", "__pl_g", *([] if digest is sha256 else [sha.alias("__pl_h")]))
    own = cut(own, "rows")
    single = found.where("__pl_t = 1").select("__pl_g", "__pl_k", "__pl_n", F.col("__pl_n").alias("__pl_w"))
    out = heavy_join(own, single, ["__pl_g"], "__pl_w", n, heavy_keys)
    if clashes:
        several = rows.join(found.where("__pl_t > 1").select("__pl_g"), "__pl_g", "left_semi").withColumn("__pl_h", sha)
        several = cut(several, "clashes")
        texts = combine(several, salts).withColumn("__pl_w", F.col("__pl_n"))
        more = heavy_join(several, texts, ["__pl_g", "__pl_x"], "__pl_w", n, heavy_keys)
        out = out.unionByName(more.select(*out.columns))
    hashed = F.lower(F.hex("__pl_g")) if digest is sha256 else F.col("__pl_h")
    return out.select(
        F.col("__pl_d").alias("doc_id"),
        F.col("__pl_k").alias("keep_id"),
        F.col("__pl_n").cast("long").alias("group_size"),
        F.col("__pl_d").eqNullSafe(F.col("__pl_k")).alias("kept"),
        hashed.alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, normal: Callable[[Column], Column] = same, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """The columns of ``docs``, one row for each distinct text: that with the largest doc_id, whole and not normalised.

    Null texts are empty texts and come out empty. Of rows alike in id and text, that whose other columns come last as JSON stays.
    Rows of a group travel by digest and id, so copies are spread; those that stay are compared by their whole text."""
    rows = _rows(docs, normal, digest)
    kept = combine(rows, salts).select("__pl_g", "__pl_x", F.col("__pl_k").alias("__pl_d"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumns({"__pl_raw": text, "__pl_x": normal(text)}).withColumn("__pl_g", digest(F.col("__pl_x")))
    own = own.withColumnRenamed("doc_id", "__pl_o")
    met = (own["__pl_g"] == kept["__pl_g"]) & own["__pl_o"].eqNullSafe(kept["__pl_d"]) & (own["__pl_x"] == kept["__pl_x"])
    stay = own.join(kept, met, "left_semi")
    others = F.struct(*[F.col(f"`{c}`") for c in rest], F.col("__pl_raw"))
    one = stay.groupBy("__pl_o", "__pl_x").agg(F.max_by(others, F.to_json(others)).alias("__pl_r"))
    pick = {"doc_id": F.col("__pl_o"), "text": F.col("__pl_r.__pl_raw")} | {c: F.col(f"__pl_r.`{c}`") for c in rest}
    return one.select(*[pick[c].alias(c) for c in docs.columns])


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and the row of it that stays; cases as exact_groups() says."""
    return exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = """
select doc_id, max(doc_id) over w as keep_id, cast(count(*) over w as bigint) as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
"""
