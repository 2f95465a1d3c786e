"""Usage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_used(df: DataFrame, keys: Sequence[str], n: int, alias: str = "n") -> DataFrame:
    """The n keys with the most rows; ties by the keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias)).orderBy(F.desc(alias), *keys).limit(n)


def kpi_row(**tables: DataFrame) -> DataFrame:
    """One row of the tables' counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one)  # of one row each
    return out


def metrics(parents: DataFrame, children: DataFrame, key: str, pending: Column) -> DataFrame:
    """Each parent with ``total`` children and those ``pending``; parents without children count 0."""
    own = children.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return parents.join(own, key, "left").select(*parents.columns, zero("total"), zero("pending"))


def top_and_bottom(df: DataFrame, keys: Sequence[str], score: str, ordinal: str, n: int = 2) -> DataFrame:
    """The n best and the n worst rows of each key with ``side`` and ``place``; both sets overlap if rows are few.

    Best first by score, ties in input order; the worst are the last of that order, in it."""
    from pyspark.sql import Window

    down = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(ordinal))
    up = Window.partitionBy(*keys).orderBy(F.asc(score), F.desc(ordinal))
    ranked = df.withColumn("__t", F.row_number().over(down)).withColumn("__b", F.row_number().over(up))
    side = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("__t") <= n, F.struct(F.lit("top").alias("side"), F.col("__t").alias("place"))),
                F.when(F.col("__b") <= n, F.struct(F.lit("bottom").alias("side"), (n + 1 - F.col("__b")).alias("place"))),
            )
        )
    )
    out = ranked.withColumn("__s", side)
    return out.select(*df.columns, F.col("__s.side").alias("side"), F.col("__s.place").alias("place"))
