"""Latest rows, versions and state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import scan


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the last by ``order``. Tasks keep the last of their own rows of a key before anything travels."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest]).select(*df.columns)


def with_latest(parents: DataFrame, children: DataFrame, on: str, order: Sequence[str], how: str = "inner") -> DataFrame:
    """Parents with their latest child; parents without one go (inner) or stay (left)."""
    return parents.join(latest(children, [on], order), on, how)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def last_n_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key with ``rn``, their place in ascending order from 1."""
    down = [F.col(c).desc() for c in order]
    kept = first_n(df, keys, down, n)
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _spread(df: DataFrame, keys: Sequence[str], spread: bool | None) -> bool:
    """Whether to scan in slices: as asked, or else if some key is more than one task should order."""
    return scan.crowded(df, keys) if spread is None else spread


def release_versions(releases: DataFrame, key: str, order: Sequence[str], column: str = "version", spread: bool | None = None) -> DataFrame:
    """Back-filled versions 1.0.n, n from 0 in each key's order; ``spread`` shares a key among tasks (scan.py; None: if one
    has more than scan.CROWD rows)."""
    if _spread(releases, [key], spread):
        rows = scan.slices(releases, [key], [F.col(c).asc() for c in order])
        out = scan.scan(rows, [key], {"__n": ("count", None, False)})
        return scan.unsliced(out.withColumn(column, F.concat(F.lit("1.0."), F.col("__n").cast("string"))).drop("__n"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return releases.withColumn(column, F.concat(F.lit("1.0."), n.cast("string")))


def bumped(version: Column, part: Column) -> Column:
    """The next version: ``major`` and ``minor`` reset what follows, anything else bumps the patch; missing parts are 0;
    no version gives 1.0.0."""
    parts = F.split(version, r"\.")
    num = [F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)) for i in range(3)]
    text = lambda *xs: F.concat_ws(".", *[x.cast("string") for x in xs])
    zero = F.lit(0)
    return (
        F.when(version.isNull(), F.lit("1.0.0"))
        .when(part == "major", text(num[0] + 1, zero, zero))
        .when(part == "minor", text(num[0], num[1] + 1, zero))
        .otherwise(text(num[0], num[1], num[2] + 1))
    )


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(from_state, to_state, n) of neighbouring rows of each key."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    pairs = df.select(before.alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


PROCESSING = [("IDLE", "QUEUED"), ("QUEUED", "PROCESSING"), ("PROCESSING", "IDLE"), ("PROCESSING", "FAILED"), ("FAILED", "QUEUED")]


def invalid_transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """State changes that the processing state machine doesn't have."""
    found = transitions(df, keys, order, state)
    allowed = F.struct("from_state", "to_state").isin([F.struct(F.lit(a), F.lit(b)) for a, b in PROCESSING])
    return found.where(~allowed)


def mirrored_status(histories: DataFrame, project_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """Project documents with the latest status of their document."""
    now = latest(histories, ["document_id"], ["created_at", "id"]).select("document_id", F.col("status").alias("__s"))
    link = documents.select(F.col("id").alias("document_id"), F.col("project_document_id").alias("__p"))
    status = link.join(now, "document_id").groupBy("__p").agg(F.max_by("__s", "document_id").alias("__s"))
    out = project_documents.join(status, project_documents["id"] == F.col("__p"), "left")
    return out.withColumn("status", F.coalesce("__s", "status")).drop("__p", "__s")


def lead_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, spread: bool | None = None) -> DataFrame:
    """Open ends end where the next row starts; ``spread`` as in release_versions()."""
    if _spread(df, keys, spread):
        rows = scan.slices(df, keys, [F.col(c).desc_nulls_last() for c in order])
        out = scan.scan(rows, keys, {"__next": ("before", F.col(start), False)})
        return scan.unsliced(out.withColumn(end, F.coalesce(end, "__next")).drop("__next"))
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(end, F.coalesce(end, nxt))


def islands(df: DataFrame, keys: Sequence[str], low: str, high: str, gap: float, spread: bool | None = None) -> DataFrame:
    """Intervals merged where the next begins at most ``gap`` after all before it end: keys, low, high, n; ``spread`` as in
    release_versions()."""
    new = F.when(F.col("__reach").isNull() | (F.col(low) - F.col("__reach") > gap), 1).otherwise(0)
    if _spread(df, keys, spread):
        rows = scan.slices(df, keys, [F.col(low).asc(), F.col(high).asc()])
        marked = scan.scan(rows, keys, {"__reach": ("max", F.col(high), False)})
        marked = scan.scan(marked.withColumn("__new", new), keys, {"__i": ("sum", F.col("__new"), True)})
    else:
        w = Window.partitionBy(*keys).orderBy(low, high)
        marked = df.withColumn("__reach", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__new", new)
        marked = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "__i").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n"))
    return out.drop("__i")


def changed(column: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Whether the value differs from the row before (the first row: yes)."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return first | ~F.col(column).eqNullSafe(before)
