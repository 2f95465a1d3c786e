"""Near-duplicate documents with SetSketch registers.

A register holds the floor of the logarithm of the least exponential hash value over a document's shingles: exponentially
spaced, truncated minima. Sketches of parts merge by taking maxima, and equal registers tell of similar sets. Bands of
registers name the candidates, a joint likelihood over registers and set sizes estimates their similarity, and full sets
decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bounded_batches, cut, in_order, read, released, salted_join, strings, worker_table
from paperloom.llm.components import components

BANDS, ROWS = 30, 4  # a pair of similarity 0.8 shares no band once in seven million times
REGISTERS = BANDS * ROWS
BASE, TOP, RATE = 1.001, 65_534, 20.0  # of SetSketch: base b, largest register q + 1, rate a
SHINGLE = 5  # words
PERCENT = 80  # least similarity of a link, in hundredths
LEAST_ESTIMATE = 0.6  # over five standard errors (0.037 at 0.8) below the limit: no link is lost to the estimate
ALIKE = REGISTERS // 3  # equal registers that a pair needs to be looked at: a link has 96 on average, and fewer than this
# once in 10**25 times; both ways of comparison ask it
SMALL_BUCKET = 64  # buckets of more members go by families and blocks, which find the same links with fewer pairs
BLOCK_ROWS, BLOCK_CHARS = 1024, 8_000_000  # of one side of a block
FANOUT = 128  # texts that are verified against one copy of another
BIN_ROWS = 1500  # a fourth of the members of a group of small buckets, about
WORDS_HELD = 60_000  # hashes of words that a Python worker remembers

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_table("words", _Words).__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for j in range(size):
        s += h[j : j + n] * _PLACES[j]
    return np.unique(_mixed(s))


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set of hashes: one pass for all registers, merged over slices."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 512):
        v = s[i : i + 512, None] * _MULTIPLIERS
        v += _OFFSETS
        np.minimum(least, v.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of the pairs (x[i], y[i]) of sketches of sets of nx[i] and ny[i] elements, by joint maximum likelihood.

    The likelihood is that of the numbers of registers that are larger, smaller and equal; steps of 1/64."""
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - up - down
    u, v = nx / (nx + ny), ny / (nx + ny)
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(x), -np.inf), np.zeros(len(x))
    for j in np.linspace(0, 1, 65):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-9
        ll = up * np.log(a + tiny) + down * np.log(b + tiny) + equal * np.log(np.maximum(1 - a - b, 0) + tiny)
        ll = np.where(j <= np.minimum(u / v, v / u) + 1 / 64, ll, -np.inf)
        at = np.where(ll > best, j, at)
        best = np.maximum(ll, best)
    return at


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    if len(s) > len(t):
        s, t = t, s
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
    return 100 * both >= percent * (len(s) + len(t) - both) and both > 0


def _bits(bands) -> np.ndarray:
    """Registers of a column of band keys."""
    flat = bands.combine_chunks() if isinstance(bands, pa.ChunkedArray) else bands
    return flat.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, d1, d2, bands) of each row: set size, 128 bits that name the set, registers as band keys (null if empty)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, one, two, bands = [], [], [], []
            for t in strings(b.column(1)):
                s = shingles(t, k)
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(_mixed(s * _PLACES[63]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "d1", "d2", "bands"],
            )
        released()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, d1 long, d2 long, bands array<long>")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sizes allow a link and whose sketches make one likely."""
    own = sets.select("id", "n", "bands")
    left = own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ba"))
    right = own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("bb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    names = pairs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.schema.get_field_index
                sizes = [b.column(at(x)).to_numpy(zero_copy_only=False).astype(np.float64) for x in ("na", "nb")]
                j = estimate(_bits(b.column(at("ba"))), _bits(b.column(at("bb"))), *sizes)
                yield b.select(names).filter(pa.array(j >= LEAST_ESTIMATE))

    return both.select(*names, "na", "nb", "ba", "bb").mapInArrow(keep, pairs.schema)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (of 64-bit shingle hashes) are similar enough. ``a`` is the hub: its text travels
    once for FANOUT others and comes before them, so a task holds the hub's set and that of one other text, besides an Arrow
    batch, whose rows and bytes are bounded."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FANOUT).alias("f"))
    dealt = salted_join(pairs, fan, ["a"], ["b"]).withColumn("s", F.pmod(F.xxhash64("b"), F.col("f")))
    dealt = cut(dealt.select("a", "b", "s"))
    others = dealt.select("a", "s", F.col("b").alias("id"), F.lit(1).alias("turn"))
    hubs = dealt.select("a", "s", F.col("a").alias("id"), F.lit(0).alias("turn")).distinct()
    rows = others.unionByName(hubs).join(texts, "id")
    rows = rows.select("a", "s", "turn", "id", "text").repartition("a", "s").sortWithinPartitions("a", "s", "turn")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for b in batches:
            found = []
            hub, salt, turn, ids = (b.column(i).to_pylist() for i in range(4))
            for a, s, t, i, text in zip(hub, salt, turn, ids, strings(b.column(4)), strict=True):
                if (a, s) != key:
                    key, own = (a, s), []
                x = shingles(text, k)
                if t == 0:
                    own.append(x)
                elif any(linked(h, x, percent) for h in own):
                    found.append((a, i))
            cols = [pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])
        released()

    bounded_batches(pairs.sparkSession)
    return rows.mapInArrow(check, "a long, b long")


def _labelled(live: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold several labels, with their labels."""
    labels = components(links)
    now = live.drop("label").join(labels.withColumnRenamed("component", "label"), "id", "left")
    now = now.withColumn("label", F.coalesce("label", "id"))
    mixed = now.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("lo < hi").select("band", "key")
    return cut(salted_join(now, mixed, ["band", "key"], ["id"]))


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's members with one of them, by another order in each turn and for odd bands."""
    rank = F.when(F.col("band") % 2 == 0, F.col("id")) if turn == 0 else F.xxhash64("id", F.lit(turn))
    rank = F.coalesce(rank, F.xxhash64("id", F.lit(100 + turn)))
    hubs = members.groupBy("band", "key").agg(F.min(F.struct(rank.alias("r"), "id", "label")).alias("h"))
    hubs = hubs.select("band", "key", F.col("h.id").alias("a"), F.col("h.label").alias("la"))
    pairs = salted_join(members, hubs, ["band", "key"], ["id"]).where("a != id and la != label")
    pairs = pairs.select("a", F.col("id").alias("b"))
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a")).select(
        "a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")
    )


def _small(members: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs with different labels of buckets of at most SMALL_BUCKET members, each in its first band."""
    bins = max(1, members.count() // (4 * BIN_ROWS))
    rows = members.select("band", "key", "id", "label").join(sets.select("id", "bands"), "id")
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("band", "key"), F.lit(bins)))

    def pairs(group: pa.Table) -> pa.Table:
        keys = np.stack([group.column(c).to_numpy().astype(np.int64) for c in ("band", "key")], 1)
        ids, label = group.column("id").to_numpy(), group.column("label").to_numpy()
        regs = _bits(group.column("bands"))
        bands = regs.view(np.int64)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        edges = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(axis=1)) + 1
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in np.split(order, edges):
            i, j = np.triu_indices(len(g), 1)
            i, j = g[i], g[j]
            other = label[i] != label[j]
            i, j = i[other], j[other]
            same = (regs[i] == regs[j]).sum(axis=1) >= ALIKE
            i, j = i[same], j[same]
            first = (bands[i] == bands[j]).argmax(axis=1) == keys[i, 0]
            a.append(np.minimum(ids[i[first]], ids[j[first]]))
            b.append(np.maximum(ids[i[first]], ids[j[first]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("bin").applyInArrow(pairs, "a long, b long").where("a != b").distinct()


def _blocks(members: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different labels of large buckets.

    Members that meet in large buckets form families. Those outside a family's largest label are compared with all its
    members, in blocks of bounded rows and characters; a block links by full sets and returns a spanning forest."""
    hubs = members.groupBy("band", "key").agg(F.min("id").alias("a"))
    family = components(salted_join(members, hubs, ["band", "key"], ["id"]).select("a", F.col("id").alias("b")).distinct())
    family = cut(family.withColumnRenamed("component", "family"))
    rows = members.select("id", "label").distinct().join(family, "id")
    rows = rows.join(texts.select("id", F.char_length("text").alias("chars")), "id")
    sized = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("x"))
    sized = sized.groupBy("family").agg(
        F.max_by("label", F.struct("c", "label")).alias("big"), F.max("c").alias("most"),
        F.sum("c").alias("c"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("labels"),
    )
    parts = lambda n: F.ceil(F.greatest(n / BLOCK_ROWS, F.col("x") * n / F.col("c") / BLOCK_CHARS)).cast("int")
    sized = sized.where("labels > 1").select(
        "family", "big", parts(F.col("c")).alias("p"), parts(F.col("c") - F.col("most")).alias("q")
    )
    rows = cut(salted_join(rows.drop("chars"), sized, ["family"], ["id"]))
    every = rows.select(
        "family", "id", "label", F.pmod(F.xxhash64("id"), F.col("p")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(0).alias("side"),
    )
    outer = rows.where("label != big").select(
        "family", "id", "label", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("q")).cast("int").alias("j"), F.lit(1).alias("side"),
    )
    dealt = every.unionByName(outer).join(sets.select("id", "n", "bands"), "id").join(texts, "id")

    def block(group: pa.Table) -> pa.Table:
        side, ids, label = (group.column(c).to_numpy() for c in ("side", "id", "label"))
        n, regs = group.column("n").to_numpy().astype(np.float64), _bits(group.column("bands"))
        text = group.column("text")
        held: dict[int, np.ndarray] = {}
        root = {int(x): int(x) for x in np.concatenate([label, ids])}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def own(x: int) -> np.ndarray:
            if x not in held:
                held[x] = shingles(text[x].as_py(), k)
            return held[x]

        found = []
        inner = np.flatnonzero(side == 0)
        for x in np.flatnonzero(side == 1).tolist():
            cand = inner[(label[inner] != label[x]) & (100 * np.minimum(n[inner], n[x]) >= percent * np.maximum(n[inner], n[x]))]
            alike = (regs[cand] == regs[x]).sum(axis=1)
            cand = cand[alike >= ALIKE]
            if not len(cand):
                continue
            j = estimate(regs[cand], np.broadcast_to(regs[x], (len(cand), REGISTERS)), n[cand], np.full(len(cand), n[x]))
            for y in cand[np.argsort(-j, kind="stable")][: int((j >= LEAST_ESTIMATE).sum())].tolist():
                a, b = top(int(label[x])), top(int(label[y]))
                if a != b and linked(own(x), own(y), percent):
                    root[max(a, b)] = min(a, b)
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(block, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, turns: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    A set: the distinct k-word shingles of the text (words between ``[\\x20\\x09-\\x0D]``, A-Z lower-cased); a text of
    fewer words is one shingle; an empty or null text has an empty set, is linked with nothing and kept. Documents are
    linked if 100 * shared >= percent * all of their shingles; a component's id is its smallest doc_id, whose row is
    kept. Equal sets (repeated rows, copies) always meet. Rows with a null doc_id are on their own: null component, kept.
    Rows that share a doc_id count as one document. Other columns take no part. An empty table gives an empty one.

    1. Sketch each text where it is read; equal sets fold into one by partial minima.
    2. Band keys; buckets of one set go. In ``turns`` rounds, each bucket's members are paired with one of them, likely
       pairs verified, components formed: a group of copies costs pairs in proportion to its size.
    3. What a bucket still holds under different labels is compared exactly: all pairs of a small bucket, blocks of a
       family for large ones. Nothing is capped."""
    own = cut(sketches(docs, k), "sketches")
    sets = own.where("n > 0 and id is not null").groupBy("n", "d1", "d2")
    sets = cut(sets.agg(F.min("id").alias("id"), F.max("bands").alias("bands")), "sets")
    keys = sets.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = cut(salted_join(keys, shared, ["band", "key"], ["id"], salts=4).withColumn("label", F.col("id")), "live")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    texts = cut(texts.join(live.select("id").distinct(), "id", "left_semi").distinct(), "texts")
    members, links = live, None
    for turn in range(turns):
        new = cut(verified(cut(likely(_star(members, turn), sets, percent)), texts, k, percent))
        links = new if links is None else links.unionByName(new)
        members = _labelled(live, links)
    few = verified(cut(likely(_small(members.where(f"size <= {SMALL_BUCKET}"), sets), sets, percent)), texts, k, percent)
    many = _blocks(members.where(f"size > {SMALL_BUCKET}"), sets, texts, k, percent)
    found = components(cut(links.unionByName(few).unionByName(many)))
    named = sets.select("n", "d1", "d2", "id").join(found, "id", "left")
    named = named.select("n", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = salted_join(own.drop("bands"), named, ["n", "d1", "d2"], ["id"], how="left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), whole.alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest doc_id, of rows that share it the first by
    text. Unlike texts all stay, also under one doc_id; rows without an id all stay; columns as they are. Null and empty
    texts are linked with nothing and stay; an empty table stays empty. ``docs`` is a table as written."""
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.limit(1).count():
        gone = near_duplicates(docs.select("doc_id", "text"), k, percent).where(~F.col("kept"))
        gone = gone.select(F.col("doc_id").alias("__pl_gone"))
        return docs.join(gone, docs["doc_id"] == F.col("__pl_gone"), "left_anti")
    # rows are told apart by their place in order of id and text
    named = in_order(docs.where(F.col("doc_id").isNotNull()), [F.col("doc_id").asc(), F.col("text").asc_nulls_first()], "__pl_place")
    found = near_duplicates(named.select(F.col("__pl_place").alias("doc_id"), "text"), k, percent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__pl_place"))
    kept = named.join(gone, "__pl_place", "left_anti")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document by four-word shingles; cases as near_duplicates() says."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
