"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name``; any path that Spark itself can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A folder of our own is set only where the session names none and one machine does all (local tests)."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor then costs no recomputation of it. A table tells its true size, where a checkpoint carries on the
    estimates of its plan, which multiply from round to round in an iteration. clear_cuts() removes the tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashes(df: DataFrame, fit: Column, keys: list[Column], rows: int, order: list[str]) -> DataFrame:
    """The ``rows`` rows of ``df`` with the least hashes of ``keys`` among those that are ``fit``, equal hashes by ``order``:
    the same rows however the table is partitioned. A count bounds what tasks hand on to about twice as many rows in all."""
    dice = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    most = int(min(1.0, 2 * rows / max(1, df.where(fit).count())) * (1 << 40))
    return df.where(dice < most).where(fit).withColumn("__pl_dice", dice).orderBy("__pl_dice", *order).limit(rows).drop("__pl_dice")


BATCH_ROWS = 1024  # rows of an Arrow batch at most: what a worker and its executor hold at once of whole texts


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold BATCH_ROWS rows at most from now on, unless the session asks for fewer: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def arrow_map(df: DataFrame, work: Callable[[Iterator[Any]], Iterator[Any]], more: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``more`` (as in a schema string) that ``work`` puts behind its own; ``drop`` goes first."""
    bounded_batches(df.sparkSession)
    base = df.drop(*drop)
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields]
    return base.mapInArrow(work, ", ".join([*own, more]))


def released() -> None:
    """Give memory that this Python worker no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def clear_cuts(spark: SparkSession) -> None:
    """Remove what cut() has written in this session; tables that still read of it can't be read after."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(conf).delete(path, True)


_CUTS: list[str] = []
_TABLES: dict[Any, Any] = {}


def worker_table(key: Any, make: Callable[[], Any]) -> Any:
    """The table ``key`` of this Python worker, made at its first use.

    A worker holds one at a time: a worker that goes on to another operator gives up what the last one remembered."""
    if key not in _TABLES:
        _TABLES.clear()
        released()
        _TABLES[key] = make()
    return _TABLES[key]


def strings(column: Any, rows: int = 512) -> Iterator[str | None]:
    """The values of an Arrow column of texts, of which ``rows`` at a time are Python objects."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], salts: int = 16, how: str = "inner"):
    """Join ``many`` with ``one`` (one row a key) so that a hot key's rows of ``many`` go to ``salts`` tasks.

    Rows of ``many`` are dealt by the hash of ``spread``; ``one`` is repeated for each salt. Keys must not be null."""
    left = many.withColumn("__pl_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__pl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__pl_salt"], how).drop("__pl_salt")


HEAVY_KEYS = 1024  # a key with more than this part of all rows is heavy: so there are fewer than so many heavy keys


def heavy_join(many: DataFrame, one: DataFrame, keys: list[str], weight: str, rows: int, parts: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of ``many`` with ``one`` (one row a key; no null keys), whose column ``weight`` tells how many of the
    ``rows`` rows of ``many`` have its key; the column goes.

    Heavy keys are those with more than a ``parts``-th of all rows, hence fewer than ``parts`` rows of ``one``: the size of
    what is broadcast is bounded. Their rows of ``many`` stay where they are; the others are shuffled, none of them hot.
    ``many`` is read twice and should be a written table."""
    hot = F.col(weight) > rows // parts
    heavy, light = one.where(hot).drop(weight), one.where(~hot).drop(weight)
    rest = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return many.join(F.broadcast(heavy), keys).unionByName(rest)


def in_order(df: DataFrame, order: list[Column], place: str = "__pl_n", name: str = "order") -> DataFrame:
    """``df`` with the column ``place``: where a row stands (from 0) in ``order``; equal rows take neighbouring places.

    Rows are sorted in slices of a range partitioning, however often a value repeats: the row's own number in ``df``, which
    must be a table as written, parts equal ones. Counts of slices, one row each, give their offsets."""
    keys = [*order, F.col("__pl_u")]
    placed = df.withColumn("__pl_u", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(placed.drop("__pl_u").withColumn("__pl_m", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__pl_p", F.shiftright("__pl_m", 33)).withColumn("__pl_i", F.col("__pl_m").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__pl_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__pl_p").agg(F.count(F.lit(1)).alias("__pl_c"))
    offsets = sizes.select("__pl_p", F.coalesce(F.sum("__pl_c").over(before), F.lit(0)).alias("__pl_o"))
    out = placed.join(F.broadcast(offsets), "__pl_p")  # one row a slice
    return out.withColumn(place, F.col("__pl_o") + F.col("__pl_i")).drop("__pl_p", "__pl_m", "__pl_i", "__pl_o")
