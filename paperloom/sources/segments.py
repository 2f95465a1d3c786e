"""An inverted index that is updated: sorted segments with tombstones, read together, merged by size."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators.search import search_postings, terms, terms_in
from paperloom.sources.store import FileStore

FAN = 4  # neighbouring segments of one size that are merged into one
FEW_KEYS = 200_000  # up to so many tombstones are broadcast


class SegmentedIndex:
    """Postings (term, key) of rows that come, change and go, under ``path``.

    An update writes a segment: the new postings of its rows, in ranges of (term, key), and the keys whose older postings
    are void from then on (tombstones). Nothing older is touched. A list of the segments, oldest first, is a small file of
    its own; a new list is a new file, written last, so readers see an update whole or not at all. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "long") -> None:
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind
        self.lists = FileStore(spark, f"{self.path}/lists")

    def segments(self) -> list[dict]:
        """(name, rows, keys) of the segments that count, oldest first."""
        names = self.lists.names()
        return json.loads(self.lists.load(names[-1]).decode()) if names else []

    def _publish(self, segments: list[dict]) -> None:
        names = self.lists.names()
        last = int(names[-1].split(".")[0]) if names else 0
        self.lists.save(f"{last + 1:012d}.json", json.dumps(segments).encode())

    def _write(self, postings: DataFrame, gone: DataFrame | None, own: bool) -> dict:
        """A segment of ``postings``, each once; its tombstones are ``gone`` and, if ``own``, the keys of its postings.

        Postings are worked out once, as they come; then one shuffle deals them into ranges, where equal ones meet."""
        name, cols = uuid.uuid4().hex, ["term", self.key]
        at, each = f"{self.path}/{name}", Window.partitionBy(*cols).orderBy(*cols)
        postings.select(*cols).write.option("parquet.enable.dictionary", "false").parquet(f"{at}/unsorted")
        held = self._postings(name, "unsorted")
        ranges = held.repartitionByRange(*cols).withColumn("__n", F.row_number().over(each)).where("__n = 1").select(*cols)
        ranges.sortWithinPartitions(*cols).write.parquet(f"{at}/postings")
        keys = ([held.select(self.key)] if own else []) + ([gone.select(self.key)] if gone is not None else [])
        keys = keys or [held.select(self.key).where(F.lit(False))]
        reduce(DataFrame.unionByName, keys).distinct().write.parquet(f"{at}/dead")
        self._delete(f"{at}/unsorted")
        return {"name": name, "rows": self._postings(name).count(), "keys": self._dead(name).count()}

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _postings(self, name: str, part: str = "postings") -> DataFrame:
        return self.spark.read.schema(f"term string, `{self.key}` {self.kind}").parquet(f"{self.path}/{name}/{part}")

    def _dead(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"`{self.key}` {self.kind}").parquet(f"{self.path}/{name}/dead")

    def update(self, postings: DataFrame, deleted: DataFrame | None = None) -> None:
        """Postings of new and changed rows (all terms of each; search.postings()), and keys (column ``key``) of rows that are
        gone or have no terms any more; a key in both is changed."""
        self._publish([*self.segments(), self._write(postings, deleted, own=True)])

    def _live(self, segments: list[dict], wanted: list[str] | None = None) -> DataFrame | None:
        """Postings of the segments that no later one of them has made void, of prefixes ``wanted`` alone if given: that
        filter reaches each segment's files, and tombstones meet only what it leaves."""
        if not segments:
            return None
        parts = []
        for i, s in enumerate(segments):
            own = self._postings(s["name"])
            if wanted is not None:
                own = own.where(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in wanted]))
            parts.append(own.withColumn("__seg", F.lit(i)))
        later = [(i, s) for i, s in enumerate(segments) if i and s["keys"]]  # the first one's tombstones lie on nothing
        if not later:
            return reduce(DataFrame.unionByName, parts).select("term", self.key)
        graves = reduce(DataFrame.unionByName, [self._dead(s["name"]).withColumn("__void", F.lit(i)) for i, s in later])
        last = graves.groupBy(F.col(self.key).alias("__key")).agg(F.max("__void").alias("__void"))
        few = sum(s["keys"] for _, s in later) <= FEW_KEYS
        void = (F.col(self.key) == F.col("__key")) & (F.col("__void") > F.col("__seg"))
        older = reduce(DataFrame.unionByName, parts[:-1]).join(last.hint("broadcast" if few else "shuffle_hash"), void, "left_anti")
        return older.unionByName(parts[-1]).select("term", self.key)

    def postings(self) -> DataFrame:
        """All postings that count."""
        return self._live(self.segments()) or self.spark.createDataFrame([], f"term string, `{self.key}` {self.kind}")

    def search(self, query: str | None, config: str = "simple") -> DataFrame:
        """Keys for which every term of the query begins some term, as search_postings() of a rebuilt index."""
        wanted = terms_in(query, config) if terms(query) else None
        live = self._live(self.segments(), wanted) if wanted != [] else None
        return search_postings(self.postings() if live is None else live, self.key, query, config)

    def merge(self, fan: int = FAN) -> int:
        """Merge runs of ``fan`` neighbouring segments whose rows and tombstones are of one power of ``fan``; the number of
        merges. Void postings go, tombstones too where nothing older is left. Old files stay for those who read them:
        vacuum() removes them."""
        done = 0
        while (run := self._run(segments := self.segments(), fan)) is not None:
            old = segments[run : run + fan]
            graves = reduce(DataFrame.unionByName, [self._dead(s["name"]) for s in old])
            one = self._write(self._live(old), graves if run else None, own=False)
            self._publish([*segments[:run], one, *segments[run + fan :]])
            done += 1
        return done

    @staticmethod
    def _run(segments: list[dict], fan: int) -> int | None:
        tier = []
        for s in segments:
            n, t = s["rows"] + s["keys"], 0
            while n >= fan:
                n, t = n // fan, t + 1
            tier.append(t)
        return next((i for i in range(len(tier) - fan + 1) if len(set(tier[i : i + fan])) == 1), None)

    def vacuum(self) -> int:
        """Remove segments that the last list doesn't name, and older lists; how many segments went. For a time without
        readers of older lists."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        kept = {s["name"] for s in self.segments()} | {"lists"}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        for name in self.lists.names()[:-1]:
            self.lists.delete(name)
        return len(gone)
