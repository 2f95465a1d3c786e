"""Prefix scans over ordered rows of keys of any size: rows are range-partitioned by key and order, each slice is scanned by
itself, and the state at its end is carried to the next slices of the same key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.stored import stored

CROWD = 1_000_000  # rows of a key that one task may order by itself
AT, SLICE = "__at", "__slice"


def crowded(df: DataFrame, keys: Sequence[str], most: int = CROWD) -> bool:
    """Whether some key has more than ``most`` rows."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) > most


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` as a written table with its rows' place in key and order (AT) and the slice that holds it (SLICE).

    Rows that are equal in key and order keep to the order of a number of their own, so they too are shared by slices; that
    number is sound when ``df`` reads a table as written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("__u").asc()]
    placed = df.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stored(placed.drop("__u").withColumn(AT, F.monotonically_increasing_id()), "slices")
    return placed.withColumn(SLICE, F.shiftright(AT, 33))


def _parts(kind: str, value: Column) -> tuple[Column, Column]:
    """The state of a slice by its rows, and over the rows so far of a window: both for the same column."""
    if kind == "count":
        return F.count(F.lit(1)), F.count(F.lit(1))
    if kind == "sum":
        return F.sum(value), F.sum(value)
    if kind == "max":
        return F.max(value), F.max(value)
    if kind == "last":  # the last that is not null
        return F.max(F.when(value.isNotNull(), F.struct(F.col(AT), value.alias("v"))))["v"], F.last(value, ignorenulls=True)
    if kind == "before":  # of the row before, null or not
        return F.max(F.struct(F.col(AT), value.alias("v")))["v"], F.lag(value)
    raise ValueError(f"no such scan: {kind}")


def _joined(kind: str, carried: Column, own: Column, first: Column) -> Column:
    if kind in ("count", "sum"):
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
    if kind == "max":
        return F.greatest(carried, own)
    return F.coalesce(own, carried) if kind == "last" else F.when(first, carried).otherwise(own)


def scan(rows: DataFrame, keys: Sequence[str], out: dict[str, tuple[str, Column | None, bool]]) -> DataFrame:
    """``rows`` (of slices()) with a column for each of ``out``: name -> (count, sum, max, last or before; of what; whether the
    row itself counts), over the rows of its key so far.

    A slice that goes on with the key of the slice before it is told what came before: one row a slice at most, which is
    broadcast. The other keys lie within one slice each."""
    rows = rows.withColumns({f"__scan_v{i}": F.lit(None) if v is None else v for i, (_, v, _) in enumerate(out.values())})
    own = Window.partitionBy(SLICE, *keys).orderBy(AT)
    so_far = {True: own.rowsBetween(Window.unboundedPreceding, 0), False: own.rowsBetween(Window.unboundedPreceding, -1)}
    parts = [(name, kind, itself, *_parts(kind, F.col(f"__scan_v{i}"))) for i, (name, (kind, _, itself)) in enumerate(out.items())]
    ends = rows.groupBy(SLICE, *keys).agg(*[state.alias(f"__scan_e{i}") for i, (*_, state, _) in enumerate(parts)])
    ahead = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__n", F.count(F.lit(1)).over(ahead))
    for i, (_, kind, *_) in enumerate(parts):
        e = F.col(f"__scan_e{i}")
        over = {"count": F.sum(e), "sum": F.sum(e), "max": F.max(e), "last": F.last(e, ignorenulls=True), "before": F.last(e)}[kind]
        carried = carried.withColumn(f"__scan_c{i}", over.over(ahead))
    back = [F.col(k).alias(f"__scan_k{j}") for j, k in enumerate(keys)]
    carried = carried.where("__n > 0").select(F.col(SLICE).alias("__slice_c"), *back, *[f"__scan_c{i}" for i in range(len(parts))], F.lit(True).alias("__on"))
    same = [F.col(SLICE) == F.col("__slice_c"), *(F.col(k).eqNullSafe(F.col(f"__scan_k{j}")) for j, k in enumerate(keys))]
    local = {}
    for i, (_, kind, itself, _, window) in enumerate(parts):
        local[f"__scan_l{i}"] = window.over(own) if kind == "before" else window.over(so_far[itself])
    local["__first"] = F.row_number().over(own) == 1
    met = rows.withColumns(local).join(F.broadcast(carried), reduce(lambda a, b: a & b, same), "left")
    done = {name: _joined(kind, F.col(f"__scan_c{i}"), F.col(f"__scan_l{i}"), F.col("__first")) for i, (name, kind, *_) in enumerate(parts)}
    return met.select(*[c for c in rows.columns if not c.startswith("__scan_v")], *[c.alias(n) for n, c in done.items()])


def unsliced(rows: DataFrame) -> DataFrame:
    return rows.drop(AT, SLICE)
