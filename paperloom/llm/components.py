"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, salted_join


def _hub(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest id among u and its neighbours in ``edges``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(edges, least, ["u"], ["v"])


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges run from the larger id ``u`` to the smaller ``v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _hub(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _hub(large)
    down = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    small = small.select(F.explode(F.array(*down)).alias("e"))
    return small.select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id on an edge, the smallest id that it reaches.

    Edges may repeat and run either way; loops are left out, and so is an id that is on loops only; an edge with a null end
    links nothing; an empty table gives an empty one. Other columns take no part. Tasks hold partial
    minima and salted joins only, whatever the degree of an id; each round is cut through the shared folder."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()  # also leaves null ends out
    e, seen = cut(e), None
    while True:
        e = cut(_step(e))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        tops.select("id", F.col("id").alias("component"))
    )
