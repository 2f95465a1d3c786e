"""Exact top-k by inner product with an M-tree, best first.

Whole-number vectors of a block get one more coordinate that makes their norms equal, so that larger inner products are
smaller distances. Nodes are pages with a routing vector, a covering radius and the distance to the parent's routing
vector; the triangle inequality over stored distances spares computations."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import read

K = 20
SCALE = 64.0
BLOCK = 4096  # vectors of one tree, about
QUERIES = 4096  # queries of one task, about
PAGE, FAN = 128, 24  # entries of a leaf, children of an inner node
SLACK = 1e-6  # of float distances


class Node:
    """A page: rows (leaf) or children (inner), with their distances to the page's routing vector."""

    __slots__ = ("children", "parent_d", "radii", "rows", "routes")

    def __init__(self, rows=None, parent_d=None, children=None, radii=None, routes=None) -> None:
        self.rows, self.parent_d, self.children, self.radii, self.routes = rows, parent_d, children, radii, routes


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.v = ids, vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", self.v, self.v)
        self.m2 = float(norms.max()) if len(ids) else 0.0
        self.extra = np.sqrt(np.maximum(self.m2 - norms, 0))
        self.top = int(np.argmin(self.extra)) if len(ids) else 0
        self.scored = 0  # pairs of a query and a row whose score has been computed
        self.root = self._build(np.arange(len(ids)), self.top)[0] if len(ids) else None

    def _d(self, a: int, rows: np.ndarray) -> np.ndarray:
        dot = self.v[rows] @ self.v[a] + self.extra[rows] * self.extra[a]
        return np.sqrt(np.maximum(2 * self.m2 - 2 * dot, 0))

    def _build(self, rows: np.ndarray, route: int) -> tuple[Node, float]:
        """The node over ``rows`` with routing row ``route``, and its covering radius."""
        d = self._d(route, rows)
        radius = float(d.max())
        if len(rows) <= PAGE or radius <= SLACK:
            order = np.argsort(d, kind="stable")
            return Node(rows=rows[order], parent_d=d[order]), radius
        seeds, apart = [route], [d]  # the next seed is the row farthest from those before it
        for _ in range(min(FAN, -(-len(rows) // PAGE) * 2) - 1):
            seeds.append(int(rows[np.minimum.reduce(apart).argmax()]))
            apart.append(self._d(seeds[-1], rows))
        near = np.stack(apart).argmin(axis=0)
        parts = [(s, rows[near == i]) for i, s in enumerate(seeds) if (near == i).any()]
        if len(parts) == 1:  # all as near to one seed: a page of its own size
            order = np.argsort(d, kind="stable")
            return Node(rows=rows[order], parent_d=d[order]), radius
        built = [self._build(p, int(s)) for s, p in parts]
        routes = np.array([s for s, _ in parts])
        return Node(
            children=[b[0] for b in built], radii=np.array([b[1] for b in built]), routes=routes,
            parent_d=self._d(route, routes),
        ), radius

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, score) of the k highest scores of each row of ``queries`` but for the id in ``own``, ties to
        smaller ids.

        Best first over pages for all queries together: the page with the least distance bound of any query comes next,
        with those queries whose bounds still reach it; its entries are scored in one product."""
        best = _Best(len(queries), own, k)
        if self.root is None or not len(queries):
            return best.rows()
        q = queries.astype(np.float64)
        base = np.einsum("ij,ij->i", q, q) + self.m2
        every = np.arange(len(q))

        def dist(at: np.ndarray, dots: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base[at].reshape(-1, *[1] * (dots.ndim - 1)) - 2 * dots, 0))

        count, queue = 0, [(0.0, 0, self.root, every, dist(every, q @ self.v[self.top]), np.zeros(len(q)))]
        limit = np.full(len(q), np.inf)
        while queue:
            _, _, node, at, dq, low = heapq.heappop(queue)
            reached = low <= limit[at] + SLACK
            at, dq = at[reached], dq[reached]
            if not len(at):
                continue
            far = limit[at] + SLACK
            if node.rows is not None:
                # |d(q, route) - d(row, route)| bounds d(q, row) from below: rows out of every query's reach are left out
                a, b = np.searchsorted(node.parent_d, [(dq - far).min(), (dq + far).max()])
                rows = node.rows[a : b + 1]
                self.scored += len(at) * len(rows)
                changed = best.add(at, q[at] @ self.v[rows].T, self.ids[rows])
                full = changed[best.full[changed]]
                limit[full] = dist(full, best.worst[full])
                continue
            near = np.abs(dq[:, None] - node.parent_d) - node.radii <= far[:, None]
            some = np.flatnonzero(near.any(axis=0))
            d = dist(at, q[at] @ self.v[node.routes[some]].T)
            for i, j in enumerate(some.tolist()):
                low = np.maximum(d[:, i] - node.radii[j], 0.0)
                go = near[:, j] & (low <= far)
                if go.any():
                    count += 1
                    heapq.heappush(queue, (float(low[go].min()), count, node.children[j], at[go], d[go, i], low[go]))
        return best.rows()


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, own: np.ndarray, k: int) -> None:
        self.k, self.own = k, own
        self.q, self.id, self.score = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        self.full = np.zeros(queries, bool)
        self.worst, self.worst_id = np.full(queries, -np.inf), np.zeros(queries, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Take in the scores of queries ``at`` (rows) and ``ids`` (columns); the queries whose best have changed."""
        worst = self.worst[at][:, None]
        better = (scores > worst) | (scores == worst) & (ids < self.worst_id[at][:, None])
        i, j = np.nonzero(better & (ids != self.own[at][:, None]))
        if not len(i):
            return i
        changed = np.zeros(len(self.full), bool)
        changed[at[i]] = True
        old = changed[self.q]
        q = np.concatenate([self.q[old], at[i]])
        n = np.concatenate([self.id[old], ids[j]])
        s = np.concatenate([self.score[old], scores[i, j]])
        order = np.lexsort((n, -s, q))
        q, n, s = q[order], n[order], s[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        last = np.flatnonzero(place == self.k - 1)
        self.full[q[last]], self.worst[q[last]], self.worst_id[q[last]] = True, s[last], n[last]
        keep = place < self.k
        self.q = np.concatenate([self.q[~old], q[keep]])
        self.id = np.concatenate([self.id[~old], n[keep]])
        self.score = np.concatenate([self.score[~old], s[keep]])
        return np.flatnonzero(changed)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.q, self.id, self.score.astype(np.int64)


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(table.num_rows, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` with the highest inner
    product of floor(64 * component), ranks from 1, ties to the smaller vec_id; all, if fewer. A row is never its own
    result: rows of the query's vec_id are left out.

    Both tables have vec_id and embedding. Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part; vectors meet those of their own length only. Repeated rows are results each on their own (with one rank
    each) and repeated queries are answered once. Scores are exact while sums of squares stay under 2**53. Other columns
    take no part; empty tables give an empty one.

    Vectors are dealt over blocks of about BLOCK rows by a hash, queries over parts of about QUERIES; each task builds a
    tree of one block and searches it for one part's queries together. Blocks' best k meet by query, cut to k before the
    shuffle."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False))
    own = F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    clean = lambda df: df.where(there).select(*own, F.size("embedding").alias("dim"))
    found, asked = clean(vectors), clean(queries).dropDuplicates(["id", "dim"])
    blocks = max(1, -(-found.count() // BLOCK))
    parts = max(1, -(-asked.count() // QUERIES))
    c = found.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    c = c.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = asked.withColumn("p", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, i, s = (np.empty(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            own = left.column("id").to_numpy()
            q, i, s = MTree(right.column("id").to_numpy(), _vectors(right)).search(_vectors(left), own, k)
            q = own[q]
        return pa.table({"query_id": q, "vec_id": i, "score": s})

    keys = ["dim", "b", "p"]
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows for each row of ``embeddings`` whose id is divisible by 20; cases as top_k() says."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e::double[], c.e::double[]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
  from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
