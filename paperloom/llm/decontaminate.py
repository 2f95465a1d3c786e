"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

Training words stream through the automaton, which tracks the longest match that ends at each word; a match of a whole
window marks the window's words as hit, and hit spans can be removed."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, cut, read, released, salted_join, strings, worker_table

WINDOW = 10  # words
MAX_COVERAGE = 0.5  # documents with a larger share of hit words are left with nothing worth keeping
PART_WORDS = 500_000  # test words in one automaton at most (of one item, if that is longer)

#: Bytes of UTF-8: A-Z to a-z; digits, letters and all that is not ASCII stay; the rest are blanks.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The same words where they stand in the text itself.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of items, each a list of words, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.len, self.link, self.next = [0], [-1], [{}]
        kept = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]) for i, ws in items if ws]
        for _, ids in kept:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: the state that a suffix of a whole window's words has, on the way from a state to the root
        self.cover = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            if self.len[v] >= window:
                up = self.link[v]
                self.cover[v] = self.cover[up] if self.len[up] >= window else v
        #: state -> [(words, item)] of windows; only items of fewer words have others than ``window``
        self.windows: dict[int, set[tuple[int, str | None]]] = {}
        self.shortest = window
        for item, ids in kept:
            m = min(window, len(ids))
            self.shortest = min(self.shortest, m)
            v = n = 0
            for c in ids:
                v, n = self.step(v, n, c)
                if n >= m:
                    u = self.cover[v] if m == window else self._of_length(v, m)
                    self.windows.setdefault(u, set()).add((m, item))
        #: nearest state with a shorter window above each state
        self.short_up = [-1] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            self.short_up[v] = up if any(m < window for m, _ in self.windows.get(up, ())) else self.short_up[up]
        size = len(self.vocab) + 1
        pairs = {a * size + b for _, ids in kept for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array([*sorted(pairs), 1 << 62], np.int64)

    def _new(self, length: int, link: int, nexts: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nexts)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the words of ``p`` and then ``c``, taken out of ``q`` if that also holds longer ones."""
        if self.len[p] + 1 == self.len[q]:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _of_length(self, v: int, m: int) -> int:
        while self.len[self.link[v]] >= m:
            v = self.link[v]
        return v

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """From state ``v`` with ``n`` words matched, one word on."""
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.len[v]
        to = self.next[v].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None], int]:
        """Hit word ranges (start, end exclusive; ascending ends), the items met, the longest match.

        Words that no item has, and pairs of neighbours that no item has, break every match: only stretches between
        them as long as the shortest window are streamed."""
        if len(words) < self.shortest or not self.vocab:
            return [], set(), 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        ranges, met, longest = [], set(), 0
        if self.shortest > 1:
            codes = ids[:-1] * (len(self.vocab) + 1) + ids[1:]
            good = self.pairs[np.searchsorted(self.pairs, codes)] == codes
        else:
            good = ids > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            b += self.shortest > 1
            if b - a < self.shortest:
                continue
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                v, n = self.step(v, n, c)
                longest = max(longest, n)
                if n >= self.window:
                    u = self.cover[v]
                    ranges.append((i - self.window, i))
                    met.update(item for _, item in self.windows[u])
                    u = self.short_up[u]
                else:
                    u = v
                while u > 0:
                    for m, item in self.windows.get(u, ()):
                        if m <= n:
                            ranges.append((i - m, i))
                            met.add(item)
                    u = self.short_up[u]
        return ranges, met, longest


def parts_of(benchmark: DataFrame, window: int, part_words: int) -> Iterator[bytes]:
    """Automata, pickled, of at most ``part_words`` test words each (of one item, if that is longer).

    Tasks build them, each of the items of one hash bin; the driver holds one part at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    blanks = F.size(F.split(F.coalesce("t", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.sum(blanks)).first()[0] or 0
    n = max(1, -(-2 * total // part_words)) if total > part_words else 1

    def build(group: pa.Table) -> pa.Table:
        own = zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True)
        got = sorted(((i, words_of(t)) for i, t in own), key=lambda x: (x[0] or "", x[1]))
        return pa.table({"bin": group.column("bin")[:1], "raw": pa.array([pickle.dumps(Automaton(got, window))], pa.binary())})

    binned = items.withColumn("bin", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    built = cut(binned.groupBy("bin").applyInArrow(build, "bin long, raw binary"), "automata")
    bins = sorted(r["bin"] for r in built.select("bin").collect())
    for k in bins:
        yield bytes(built.where(F.col("bin") == k).first()["raw"])
    if not bins:
        yield pickle.dumps(Automaton([], window))


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, prefix: str = ""
) -> DataFrame:
    """Add to each row what of the test items its text holds:

    ``n_words`` (long), ``n_hit`` (long: words inside an occurrence of a window), ``item_ids`` (array of strings, sorted:
    items with occurring windows), ``longest`` (int: words of the longest match streamed), ``spans`` (array of structs of
    start and end, exclusive: code points of the hit stretches, from first to last word).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
    empty texts have no words; items without words and null items are nowhere; an item whose id is null hits words but
    is not listed; repeated rows each get their own result; columns of the result's names (all begin with ``prefix``) are
    replaced.

    An automaton is broadcast whole, which its number of words bounds; documents are scanned where they were read. A
    benchmark of several automata takes a pass over the documents for each; then what the passes have found, which is
    little, is merged by text and joined."""
    names = [f"{prefix}{n}" for n in ("n_words", "n_hit", "item_ids", "longest", "spans")]
    base, parts = docs.drop(*names), parts_of(benchmark, window, part_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        found = arrow_map(base, _scan(base.sparkSession.sparkContext.broadcast(first)), _FOUND)
    else:
        found = _merged_passes(base, chain([first, second], parts))
    return found.select(
        *base.columns,
        F.col("__pl_words").alias(names[0]),
        F.aggregate("__pl_ranges", F.lit(0).cast("long"), lambda n, r: n + r["y"] - r["x"]).alias(names[1]),
        F.col("__pl_items").alias(names[2]),
        F.col("__pl_longest").alias(names[3]),
        F.transform("__pl_ranges", lambda r: F.struct(r["start"], r["end"])).alias(names[4]),
    )


#: what a scan adds: words and code points of each hit stretch, ends exclusive
_FOUND = "__pl_words long, __pl_longest int, __pl_items array<string>, __pl_ranges array<struct<x:int,y:int,start:int,end:int>>"
_RANGES = pa.list_(pa.struct([(n, pa.int32()) for n in ("x", "y", "start", "end")]))


def _scan(part) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of a batch through the automaton that is broadcast as ``part``, one at a time."""
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_table(("automaton", name), lambda: pickle.loads(part.value))
        for b in batches:
            n_words, most, met, hits = [], [], [], []
            for t in strings(b.column(b.schema.get_field_index("text")), 64):
                words = words_of(t)
                ranges, items, longest = automaton.scan(words)
                at = [m.span() for m in WORD.finditer(t)] if ranges else []
                n_words.append(len(words))
                most.append(longest)
                met.append(sorted(x for x in items if x is not None))
                hits.append([{"x": x, "y": y, "start": at[x][0], "end": at[y - 1][1]} for x, y in merged(ranges)])
            more = [pa.array(n_words, pa.int64()), pa.array(most, pa.int32()), pa.array(met, pa.list_(pa.string())), pa.array(hits, _RANGES)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(x.split()[0] for x in _FOUND.split(", "))])
        released()

    return scan


def _merged_passes(base: DataFrame, parts: Iterable[bytes]) -> DataFrame:
    """``base`` with what all parts find; a text is known by 128 bits of hash and its length."""
    text = F.coalesce("text", F.lit(""))
    key = {"__pl_h": F.xxhash64(text), "__pl_g": F.xxhash64(F.lit(7), text), "__pl_n": F.char_length(text)}
    hits = None
    for raw in parts:
        part = base.sparkSession.sparkContext.broadcast(raw)
        own = arrow_map(base.select("text"), _scan(part), _FOUND)
        new = cut(own.withColumns(key).drop("text", "__pl_words"), "leaks")
        part.unpersist()
        hits = new if hits is None else hits.unionByName(new)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__pl_ranges")
            out = []
            for rs in b.column(at).to_pylist():
                own: list[dict] = []
                for r in sorted(rs, key=lambda r: (r["x"], r["y"])):
                    if own and r["x"] <= own[-1]["y"]:
                        if r["y"] > own[-1]["y"]:
                            own[-1] |= {"y": r["y"], "end": r["end"]}
                    else:
                        own.append(r)
                out.append(own)
            yield b.set_column(at, b.schema.field(at), pa.array(out, _RANGES))

    flat = lambda c: F.flatten(F.collect_set(c)).alias(c)  # noqa: E731  equal texts give equal lists in a pass
    hits = hits.groupBy(*key).agg(F.max("__pl_longest").alias("__pl_longest"), flat("__pl_items"), flat("__pl_ranges"))
    hits = hits.withColumn("__pl_items", F.sort_array(F.array_distinct("__pl_items")))
    hits = cut(hits.mapInArrow(merge, hits.schema), "leaks")
    rows = base.withColumns(key).withColumn("__pl_u", F.monotonically_increasing_id())
    found = salted_join(rows, hits, list(key), ["__pl_u"], how="left")
    words = F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")
    empty = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return found.select(
        *base.columns, words.alias("__pl_words"), F.coalesce("__pl_longest", F.lit(0)).alias("__pl_longest"),
        empty("__pl_items"), empty("__pl_ranges"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """Remove hit spans from the texts; documents with more than ``max_coverage`` of their words hit go altogether.

    Other rows, and the columns of ``docs``, stay as they are: null and empty texts (they have no words), repeated rows,
    rows without an id, columns of any name. Spans run from a first to a last word, so blanks around them stay. Without
    test items, or without documents, nothing is removed."""
    p = "__pl_"
    found = find_leaks(docs, benchmark, window, prefix=p)
    hit, words, spans = F.col(f"{p}n_hit"), F.col(f"{p}n_words"), F.col(f"{p}spans")
    kept = found.where((hit == 0) | (hit <= max_coverage * words))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    until = lambda i: F.when(i == F.size(spans), F.char_length("text")).otherwise(F.get(spans, i)["start"])
    rest = F.transform(
        F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(F.col("text"), before(i) + 1, until(i) - before(i))
    )
    text = F.when(hit == 0, F.col("text")).otherwise(F.array_join(rest, ""))
    return kept.withColumn("text", text).select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """What every whole text of ``documents`` holds of ``benchmark``; cases as find_leaks() says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7_SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
it as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
lens as (select distinct least({WINDOW}, len(w)) as m from it where len(w) > 0),
iw as (
  select distinct item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as g
  from (select item_id, w, least({WINDOW}, len(w)) as m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as i
        from it where len(w) > 0)
),
dw as (
  select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lens where len(w) >= m)
),
hit as (select dw.doc_id, dw.m, dw.i, iw.item_id from dw join iw on dw.m = iw.m and dw.g = iw.g),
words as (select doc_id, count(distinct p) as n_hit
          from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
