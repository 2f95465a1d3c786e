"""A store of named files in any folder that Hadoop's file systems reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import pii


class FileStore:
    """Files by name under ``root``, with addresses under ``base_url``. Names are plain: no folders, no way out."""

    def __init__(self, spark: SparkSession, root: str, base_url: str = "/uploads") -> None:
        self.root, self.base_url = root.rstrip("/"), base_url.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a plain file name: {name!r}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def save(self, name: str, content: bytes) -> str:
        """Write the file, over an older one of its name; its address."""
        path = self._path(name)
        out = self._fs(path).create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return self.url(name)

    def load(self, name: str) -> bytes:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return self._fs(path).exists(path)

    def delete(self, name: str) -> bool:
        """Whether there was such a file."""
        path = self._path(name)
        return self._fs(path).exists(path) and self._fs(path).delete(path, False)

    def names(self) -> list[str]:
        """Names in order; none where the folder does not exist."""
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []

    def url(self, name: str) -> str:
        return f"{self.base_url}/{name}"


class PseudonymStore:
    """Numbers of entities (key, kind, entity, n), kept under ``path`` so that later runs go on with them.

    A run adds a folder of its own, named by ``run``; run again, it replaces that folder and nothing else."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"`{key}` {kind}, kind string, entity string, n long, run string"

    def held(self, without: str | None = None) -> DataFrame:
        """All numbers, but for those that the run ``without`` added."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if without is None else rows.where(F.col("run") != without)

    def anonymise(self, df: DataFrame, run: str, order: str = "chunk_index", text: str = "text", **how) -> DataFrame:
        """pii.anonymise() of a document's next chunks: entities of earlier runs keep their numbers, new ones are added."""
        found = pii.entities(df, self.key, order, text, how.get("patterns", tuple(pii.PATTERNS)))
        fresh = pii.numbers(found, self.key, order, self.held(without=run)).where("new").drop("new")
        fresh.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return pii.anonymise(df, self.key, order, text, held=self.held(), **how)
