"""Table access with soft delete built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.sources.store import FileStore


class Catalog:
    """Tables as Parquet under ``root``. Rows with ``deleted_at`` set are left out of every read unless asked for; the
    predicate reaches the scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._current = FileStore(spark, f"{self.root}/_current")

    def path(self, name: str) -> str:
        """The published version of a table, or the table itself where none is."""
        current = self._current.load(name).decode() if self._current.exists(name) else ""
        return f"{self.root}/{name}{current and '@'}{current}.parquet"

    def source(self, name: str) -> DataFrame:
        """All rows of a table."""
        reader = self.spark.read
        if name in schemas.TABLES:
            reader = reader.schema(schemas.schema_of(name))
        return reader.parquet(self.path(name))

    def table(self, name: str, include_deleted: bool = False) -> DataFrame:
        df = self.source(name)
        return df if include_deleted else active(df)

    def by_id(self, name: str, key, column: str = "id") -> DataFrame:
        return self.table(name).where(F.col(column) == key)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def snapshot(self, name: str, rows: DataFrame, version: str) -> str:
        """Write a whole new version of a table beside it; publish() points readers at it."""
        path = f"{self.root}/{name}@{version}.parquet"
        rows.write.mode("error").parquet(path)
        return path

    def publish(self, name: str, version: str) -> None:
        """From now on reads and appends take this version, which snapshot() wrote; the older ones stay where they are."""
        self._current.save(name, version.encode())

    def register(self, *names: str, prefix: str = "", suffix: str = "_all") -> None:
        """Views of tables for SQL text: ``prefix`` and name without deleted rows, with ``suffix`` behind it all rows.

        What a query does with a view, by whatever alias, in joins with itself or in subqueries, it does with live rows;
        deleted ones take the other name. The predicate reaches the scan as in table()."""
        for name in names:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")
            self.table(name, include_deleted=True).createOrReplaceTempView(f"{prefix}{name}{suffix}")

    def sql(self, text: str, *names: str, include_deleted: bool = False) -> DataFrame:
        """A query in SQL over the tables ``names``; with ``include_deleted`` the same text sees deleted rows too.

        The text names them in braces, as ``from {documents} d``: no view is left behind or replaced."""
        return self.spark.sql(text, **{name: self.table(name, include_deleted) for name in names})


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
