"""Exact filtered nearest neighbours and what is built on their hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from paperloom.operators import scan

MARGIN = 2
BLOCK = 1024  # chunks, and queries, of one filter value that meet in one task, about
MOST_HOT = 50_000  # frequent filter values that are broadcast at most; more are joined as Spark sees fit
SLICE = 256  # queries of a block that are scored in one product
SLACK = 1e-9  # what a product may be off by; distances that decide are summed component by component


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def _hot(queries: DataFrame, chunks: DataFrame, on: str) -> DataFrame:
    """(``on``, __blocks, __groups): filter values of more than BLOCK chunks or queries, and the parts to deal either over.

    Broadcast only after a count: the table grows as rows / BLOCK."""
    side = lambda df, c, q: df.select(on, F.lit(c).alias("c"), F.lit(q).alias("q"))
    n = side(chunks, 1, 0).unionByName(side(queries, 0, 1)).groupBy(on).agg(F.sum("c").alias("c"), F.sum("q").alias("q"))
    n = n.where((F.greatest("c", "q") > BLOCK) & F.col(on).isNotNull())
    parts = [F.greatest(F.lit(1), F.ceil(F.col(x) / BLOCK)).alias(name) for x, name in (("c", "__blocks"), ("q", "__groups"))]
    hot = n.select(on, *parts)
    return F.broadcast(hot) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else hot


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of each number of components: places, components (one row a component), norms. Null vectors, those without
    length and those with null or non-finite components are left out."""
    held = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start, out = np.cumsum(size) - size, {}
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        v = np.ascontiguousarray(flat[start[at][:, None] + np.arange(n)].T)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(_summed(v, v))
        sound = np.isfinite(norm) & (norm > 0)
        out[n] = at[sound], v[:, sound], norm[sound]
    return out


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of columns, summed in the order of the components."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def _nearest(q: pa.ChunkedArray, c: pa.ChunkedArray, keys: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, chunk's place, distance) of the k nearest of each query of a block, ties by key: matrix products
    find who may be among them, sums in the order of the components decide."""
    place = np.empty(len(keys), np.int64)
    place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    ours, theirs = _by_length(q), _by_length(c)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for n in ours.keys() & theirs.keys():
        (at, a, na), (to, b, nb) = ours[n], theirs[n]
        if not len(to):
            continue
        near, most = b / nb, min(k, len(to))
        for lo in range(0, len(at), SLICE):
            part, size = a[:, lo : lo + SLICE], na[lo : lo + SLICE]
            d = 1 - (part / size).T @ near
            i, j = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most] + SLACK)
            dots = np.zeros(len(i))
            for x, y in zip(part, b, strict=True):
                dots += x[i] * y[j]
            exact = 1 - dots / (size[i] * nb[j])
            order = np.lexsort((place[to[j]], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((at[lo + i[best]], to[j[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def knn(queries: DataFrame, chunks: DataFrame, k: int, on: str = "source", key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest by cosine to each query among those of the query's ``on`` value, with ``distance``, ``rank``.

    ``queries``: query_id, ``on``, vector. Chunks and queries of a frequent ``on`` value are dealt over blocks by hash; each
    pair of blocks meets by itself as matrices and keeps k chunks a query, of which the k nearest stay; ties go to the
    smaller key. Every pair of a query and a chunk of its value is scored. Vectors that are null, have no length or hold null
    or non-finite components take no part, nor do null ``on`` values; vectors of unlike length are not compared. Rows that
    share a key share a block. ``chunks`` travel with all their columns: select those that are needed."""
    q = queries.where(F.col(on).isNotNull()).select(on, "query_id", F.col("vector").alias("__q"))
    c = chunks.where(F.col(on).isNotNull())
    hot = _hot(q, c, on)
    part = lambda name, n: F.pmod(F.xxhash64(name), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1))
    q, c = (x.join(hot, on, "left") for x in (q, c))
    q = q.withColumn("__g", part("query_id", F.col("__groups"))).withColumn("__b", every(F.col("__blocks")))
    c = c.withColumn("__b", part(key, F.col("__blocks"))).withColumn("__g", every(F.col("__groups")))
    rest = [x for x in chunks.columns if x != on]
    schema = StructType([chunks.schema[on], queries.schema["query_id"], *(chunks.schema[x] for x in rest)]).add("distance", DoubleType())

    def block(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        i, j, distance = _nearest(ours.column("__q"), theirs.column("embedding"), theirs.column(key), k)
        held, ids = theirs.take(pa.array(j)), ours.column("query_id").take(pa.array(i))
        return pa.table([held.column(on), ids, *(held.column(x) for x in rest), pa.array(distance)], names=schema.names)

    # new names on the one side: queries may come from the chunks' own table
    ours = q.select(F.col(on).alias("__on"), "query_id", "__q", F.col("__b").alias("__qb"), F.col("__g").alias("__qg"))
    theirs = c.drop("__blocks", "__groups").groupBy(on, "__b", "__g")
    both = ours.groupBy("__on", "__qb", "__qg").cogroup(theirs).applyInArrow(block, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(hits: DataFrame, chunks: DataFrame, margin: int = MARGIN, source: str = "source", index: str = "chunk_index") -> DataFrame:
    """Chunks of the hits' sources whose index is within ``margin`` of a hit's, each once, in order of source and index;
    hits without source or index bring nothing."""
    sound = hits.where(F.col(source).isNotNull() & F.col(index).isNotNull())
    low = F.greatest(F.lit(0).cast("long"), F.col(index).cast("long") - margin)
    band = sound.select(source, F.explode(F.sequence(low, F.col(index).cast("long") + margin)).alias(index)).distinct()
    return chunks.withColumn(index, F.col(index).cast("long")).join(band, [source, index]).orderBy(source, index)


def expanded_or_hits(hits: DataFrame, chunks: DataFrame, group: str, margin: int = MARGIN) -> DataFrame:
    """(group, source, chunk_index): neighbours of each group's hits; a group for which nothing is found keeps its hits."""
    low = F.greatest(F.lit(0).cast("long"), F.col("chunk_index").cast("long") - margin)
    band = hits.select(group, "source", F.explode(F.sequence(low, F.col("chunk_index").cast("long") + margin)).alias("chunk_index"))
    near = chunks.select("source", F.col("chunk_index").cast("long").alias("chunk_index"))
    found = band.distinct().join(near, ["source", "chunk_index"])
    rest = hits.select(group, "source", F.col("chunk_index").cast("long").alias("chunk_index"))
    return found.unionByName(rest.join(found.select(group).distinct(), group, "left_anti"))


def chunks_at(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of wanted (source, chunk_index) pairs."""
    return chunks.join(wanted.select("source", "chunk_index").distinct(), ["source", "chunk_index"], "left_semi")


def citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited chunks (ord, chunk_id) with what was retrieved: unknown ids go, the first citation of an id wins, of repeated
    chunk ids the last retrieved (by pos) counts; in the order of citation."""
    first = cited.groupBy("chunk_id").agg(F.min("ord").alias("ord"))
    rest = [c for c in retrieved.columns if c not in ("chunk_id", "pos")]
    last = retrieved.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "pos").alias("__r"))
    out = first.join(last, "chunk_id").select("ord", "chunk_id", *[F.col(f"__r.{c}").alias(c) for c in rest])
    return out.orderBy("ord")


def rect_structs(rects: Column) -> Column:
    """Rectangles of four numbers as structs; others go."""
    four = F.filter(rects, lambda r: F.size(r) == 4)
    return F.transform(
        four, lambda r: F.struct(r[0].alias("x1"), r[1].alias("y1"), r[2].alias("x2"), r[3].alias("y2"))
    )


def asof_sections(chunks: DataFrame, sections: DataFrame, key: str = "doc_id", spread: bool | None = None) -> DataFrame:
    """Each chunk (key, start, length) with the last section (key, ord, start, section) that starts at or before the
    chunk's middle, start + length // 2; sections count up to the first whose start lies before its forerunner's.

    One sort of chunks and sections together; no pairs are formed. ``spread`` shares a key among tasks (scan.py; None: if
    one has more than scan.CROWD chunks)."""
    spread = scan.crowded(chunks, [key]) if spread is None else spread
    w = Window.partitionBy(key).orderBy("ord")
    drop = F.when(F.col("start") < F.col("__before"), 1).otherwise(0)
    if spread:
        rows = scan.scan(scan.slices(sections, [key], [F.col("ord").asc()]), [key], {"__before": ("before", F.col("start"), False)})
        marked = scan.scan(rows.withColumn("__drop", drop), [key], {"__bad": ("sum", F.col("__drop"), True)})
    else:
        marked = sections.withColumn("__before", F.lag("start").over(w)).withColumn("__drop", drop)
        marked = marked.withColumn("__bad", F.sum("__drop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fine = marked.where("__bad = 0")
    names = [c for c in chunks.columns]
    mid = F.col("start") + F.floor(F.col("length") / 2)
    left = chunks.select(key, mid.alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("int").alias("__ord"),
                         F.struct(*names).alias("__c"), F.lit(None).cast("string").alias("__s"))
    right = fine.select(key, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__side"), F.col("ord").cast("int").alias("__ord"),
                        F.lit(None).cast(left.schema["__c"].dataType).alias("__c"), F.col("section").alias("__s"))
    both = left.unionByName(right).withColumnRenamed("__at", "__pos")
    order = [F.col("__pos").asc(), F.col("__side").asc(), F.col("__ord").asc_nulls_last()]
    if spread:
        both = scan.scan(scan.slices(both, [key], order), [key], {"section": ("last", F.col("__s"), True)})
    else:
        seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("section", F.last("__s", ignorenulls=True).over(seen))
    return both.where("__side = 1").select(*[F.col(f"__c.{c}").alias(c) for c in names], "section")
