"""Filters, ordering, paging, look-ups and keyed changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.latest import latest


def json_text(column: str, key: str) -> Column:
    """The value of a key of a JSON text as text; null where the key is missing or null."""
    return F.get_json_object(column, f"$.{key}")


def json_is(column: str, key: str, *values) -> Column:
    """Whether the text of a JSON key is one of ``values``; of none it is false."""
    return json_text(column, key).isin([str(v) for v in values]) if values else F.lit(False)


def concatenated(*results: DataFrame, part: str | None = None) -> DataFrame:
    """The rows of all results, repeats kept; columns meet by name, and ``part`` (if given) numbers the results from 0."""
    numbered = results if part is None else [r.withColumn(part, F.lit(i)) for i, r in enumerate(results)]
    return reduce(DataFrame.unionByName, numbered)


def any_of(predicates: Sequence[Column]) -> Column:
    """OR of the predicates; none is true of nothing."""
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def ilike_any(columns: Sequence[str], text: str | None) -> Column:
    """Whether any column contains ``text`` in any case; its wildcards are not escaped; no text: all rows."""
    return any_of([F.col(c).ilike(f"%{text}%") for c in columns]) if text else F.lit(True)


def optional(df: DataFrame, **equal) -> DataFrame:
    """Equality filters, of which those with a false value (None, "", 0, empty) are not applied."""
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def archived(df: DataFrame, value: bool | None = False, column: str = "is_archived") -> DataFrame:
    """Only (un)archived rows; the default leaves archived ones out; None applies nothing."""
    return df if value is None else df.where(F.col(column) == value)


def in_list(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """IN; an empty list gives an empty result."""
    return df.where(F.col(column).isin(list(values)) if values else F.lit(False))


def in_query(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """IN (sub-query) or EXISTS through a relation."""
    return df.join(other.select(F.col(other_column).alias(column)).distinct(), column, "left_semi")


def missing(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows without a partner: orphans, or requested ids that don't exist."""
    return df.join(other.select(F.col(other_column).alias(column)), column, "left_anti")


def both_bounds(df: DataFrame, column: str, low, high) -> DataFrame:
    """Inclusive range, applied only if both bounds are given."""
    return df if low is None or high is None else df.where(F.col(column).between(F.lit(low), F.lit(high)))


def bounds(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive bounds, each on its own."""
    df = df if low is None else df.where(F.col(column) >= F.lit(low))
    return df if high is None else df.where(F.col(column) <= F.lit(high))


def ordered(df: DataFrame, column: str, direction: str = "desc", tie: str = "id") -> DataFrame:
    """``asc`` ascends, anything else descends; nulls as larger than all; ``tie`` makes the order total."""
    key = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_first()
    return df.orderBy(key, F.col(tie).asc_nulls_last())


def ordered_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Ordered by several (column, direction) keys, each as in ordered(); the last one should make the order total."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_first() for c, d in keys])


def after(df: DataFrame, column: str, last, last_tie, limit: int = 100, tie: str = "id") -> DataFrame:
    """The page after the row (last, last_tie) in ascending order: rows before it are filtered out, not counted off, so a
    page costs the same wherever it stands. Without ``last`` the first page."""
    if last is not None:
        at = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in ((column, last), (tie, last_tie))]
        df = df.where((F.col(column) >= at[0]) & (F.struct(column, tie) > F.struct(*at)))  # the first part reaches the scan
    return df.orderBy(column, tie).limit(limit)


def joined_if(df: DataFrame, other: DataFrame, on: Column, **equal) -> DataFrame:
    """``df`` joined with ``other`` only if a filter on ``other`` has a value; a row with several partners repeats."""
    asked = {c: v for c, v in equal.items() if v}
    return df.join(optional(other, **asked), on).select(*[df[c] for c in df.columns]) if asked else df


def page(df: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of an ordered table."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be at least 0 and limit at least 1")
    return df.offset(offset).limit(limit)


def conflicts(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], id_column: str = "id") -> DataFrame:
    """Candidates whose keys an existing row of another id already holds; null keys equal nulls."""
    there = existing.select(*[F.col(k).alias(f"__e_{k}") for k in keys], F.col(id_column).alias("__e_id"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys])
    return candidates.join(there, on & ~F.col(id_column).eqNullSafe(F.col("__e_id")), "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one active row holds; keys with a null are distinct, as in a unique index."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(there).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def scoped(df: DataFrame, user: str, is_admin: bool, advisor: str | None = None, advisee: str | None = None) -> DataFrame:
    """Advisorships that a user may list: administrators all asked for; others, unless they are a requested party, their
    own as advisor."""
    df = optional(df, advisor_id=advisor, advisee_id=advisee)
    return df if is_admin or user in (advisor, advisee) else df.where(F.col("advisor_id") == user)


def related(df: DataFrame, user: str) -> DataFrame:
    """Advisorships in which the user takes part in either role."""
    return df.where((F.col("advisor_id") == user) | (F.col("advisee_id") == user))


def resolve(ids: DataFrame, key: str, branches: DataFrame, applied: DataFrame) -> DataFrame:
    """The branch of each id: directly, else through the applied branch of this id and its original."""
    own = branches.select(F.col("id").alias("__b"), F.col("title").alias("__bt"))
    via = applied.select(F.col("id").alias("__a"), F.col("original_id").alias("__o"))
    far = branches.select(F.col("id").alias("__f"), F.col("title").alias("__ft"))
    out = ids.join(own, F.col(key) == F.col("__b"), "left").join(via, F.col(key) == F.col("__a"), "left")
    out = out.join(far, F.col("__o") == F.col("__f"), "left")
    return out.select(*ids.columns, F.coalesce("__b", "__f").alias("branch_id"), F.coalesce("__bt", "__ft").alias("title"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """The table with changed rows in place of old ones: the newest version of each key stays."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], ["__new", stamp]).drop("__new")


def soft_delete(table: DataFrame, ids: DataFrame, key: str, at: Column, by: Column) -> DataFrame:
    """The table with ``deleted_at`` and ``deleted_by`` set on the rows of ``ids`` that are still active."""
    gone = ids.select(F.col(key).alias("__k")).distinct().withColumn("__gone", F.lit(True))
    now = F.col("__gone").isNotNull() & F.col("deleted_at").isNull()
    out = table.join(gone, F.col(key) == F.col("__k"), "left")
    out = out.withColumns(
        {"deleted_by": F.when(now, by).otherwise(F.col("deleted_by")), "deleted_at": F.when(now, at).otherwise(F.col("deleted_at"))}
    )
    return out.drop("__k", "__gone")


def hard_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children that stay when ``parents`` go."""
    return missing(children, child_key, parents, parent_key)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set-based update: a new snapshot with the values where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_matching(df: DataFrame, matches: dict[str, DataFrame], condition: Column | None = None, **values: Column) -> DataFrame:
    """Set-based update of rows for which ``condition`` holds or a column is among the ids of its table in ``matches`` (column
    -> its first column): a new snapshot. Ids may repeat and be null; a null column matches none."""
    out, hits = df, [F.lit(False) if condition is None else F.coalesce(condition, F.lit(False))]
    for i, (column, ids) in enumerate(matches.items()):
        flag = f"__m{i}"
        own = ids.select(F.col(ids.columns[0]).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct().withColumn(flag, F.lit(True))
        out = out.join(own, F.col(column) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        hits.append(F.coalesce(flag, F.lit(False)))
    return update_where(out, reduce(lambda a, b: a | b, hits), **values).select(*df.columns)


def get_or_create(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct wanted keys that don't exist yet."""
    return wanted.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def ensured(wanted: DataFrame, existing: DataFrame, keys: Sequence[str], id_column: str = "id") -> DataFrame:
    """One row for each distinct wanted key: the existing one, else a new one with an id made of its keys (the same however
    often it is done), and ``created``."""
    new = get_or_create(wanted, existing, keys)
    made = new.withColumn(id_column, F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256))
    held = existing.join(wanted.select(*keys).distinct(), list(keys), "left_semi").withColumn(id_column, F.col(id_column).cast("string"))
    one = latest(held, list(keys), [id_column])
    return one.withColumn("created", F.lit(False)).unionByName(made.withColumn("created", F.lit(True)), allowMissingColumns=True)
