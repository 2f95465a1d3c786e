"""Line dedup, in DataFrame operations only: explode normalised lines, hash, count the documents of each hash, drop the
lines of frequent hashes, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, read, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS = 10  # a key found in so many documents loses its lines
MIN_CHARS = 1  # shorter keys are never dropped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; texts of one byte a character take the built-in, quicker way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop, in every document, the lines whose key occurs in at least ``min_docs`` documents.

    The rows and columns of ``docs`` stay; ``text`` becomes the kept lines, and ``n_lines`` (before dropping) and
    ``n_dropped`` are put in (they replace columns of these names).

    A key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; keys are compared by 128 bits of hash.
    A document is a distinct (doc_id, text); repeated rows count once and are all cleaned. A null or empty text is one
    empty line and stays as it is (null becomes empty). Null ids take part. No rows give no rows.

    Lines are split and hashed once, into a table of hashes and positions. Shuffles: (key, document) pairs for
    distinctness, then counts with map-side sums, so a line of a third of all documents is a few partial counts; the join
    of hashes with frequent keys is salted by document; last, texts meet their dropped positions by document."""
    here = docs.withColumns({"n_lines": F.lit(None), "n_dropped": F.lit(None)}).columns
    base = docs.drop("n_lines", "n_dropped")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = base.select(F.col("doc_id").alias("__pl_d"), F.xxhash64(whole).alias("__pl_t"), whole.alias("__pl_x"))
    split = rows.select("__pl_d", "__pl_t", F.posexplode(F.split("__pl_x", "\n", -1)).alias("__pl_p", "__pl_l"))
    key = F.trim(ascii_lower(F.col("__pl_l")), F.lit(BLANKS))
    keyed = split.select("__pl_d", "__pl_t", "__pl_p", key.alias("__pl_k")).where(F.char_length("__pl_k") >= min_chars)
    hashed = keyed.select("__pl_d", "__pl_t", "__pl_p", F.xxhash64("__pl_k").alias("__pl_h"), F.xxhash64(F.lit(7), "__pl_k").alias("__pl_g"))
    hashed = cut(hashed, "lines")
    pairs = hashed.drop("__pl_p").distinct()
    frequent = pairs.groupBy("__pl_h", "__pl_g").agg(F.count(F.lit(1)).alias("__pl_n")).where(F.col("__pl_n") >= min_docs).drop("__pl_n")
    lost = salted_join(hashed, frequent, ["__pl_h", "__pl_g"], ["__pl_d", "__pl_t"])
    lost = lost.groupBy("__pl_d", "__pl_t").agg(F.collect_set("__pl_p").alias("__pl_lost"))
    lost = lost.select(F.col("__pl_d").alias("__pl_ld"), F.col("__pl_t").alias("__pl_lt"), "__pl_lost")
    out = base.withColumn("__pl_t", F.xxhash64(whole)).join(
        lost, F.col("doc_id").eqNullSafe(F.col("__pl_ld")) & (F.col("__pl_t") == F.col("__pl_lt")), "left"
    )
    out = out.withColumn("__pl_ls", lines_of(F.col("text"))).withColumn("n_lines", F.size("__pl_ls").cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__pl_ls") - 1), F.col("__pl_lost"))
    out = out.withColumn("__pl_keep", F.when(F.col("__pl_lost").isNotNull(), kept))
    text = F.when(F.col("__pl_keep").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform("__pl_keep", lambda p: F.get(F.col("__pl_ls"), p)), "\n")
    )
    out = out.withColumn("text", text)
    out = out.withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size("__pl_keep"), F.lit(0)).cast("long"))
    return out.select(*here)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line counts and what is kept of every whole text of ``documents``; cases as dedup_lines() says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = f"""
with lines as (
  select doc_id, i, l,
         translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
        from documents)
), hot as (
  select k from lines where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}
), marked as (
  select doc_id, i, l, k in (select k from hot) as drop_it from lines
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where drop_it) as bigint) as n_dropped,
       sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not drop_it), '')) as kept_sha256
from marked group by doc_id
"""
