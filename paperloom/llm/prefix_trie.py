"""The trie of conversation prefixes: turns are digested, edges lead from a prefix's digest to that without the last turn, and
pointer jumping rolls leaf counts and savings up to all ancestors in rounds that double the reach."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import HEAVY_KEYS, cut, heavy_join, in_order, read

FAMILY = 20  # conversations c to c + FAMILY - 1 may share the first turns of conversation c - c % FAMILY
SHARED = 4  # of which each takes crc32(c) % SHARED
STRETCH = 512  # turns of a stretch within which digests are run up
CHUNK = 4096  # conversation ids of a chunk of a node's ends
NODE = ["depth", "a", "b"]  # a node: how many turns, and the digest of what they say


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at, size): each turn's place (from 1) in its conversation, and how many turns that has.

    Turns follow each other by turn (null first), then role, then text; null roles and texts are empty. Rows without a
    conv_id have no conversation and go. Places come from slices of a range partitioning, so a conversation of any length is
    shared by many tasks."""
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = in_order(rows.where("conv_id is not null"), order, "place", "turns")
    # the written table stands below ``placed``: both uses of it see the same places
    sizes = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    sizes = cut(sizes.withColumn("w", F.col("size")), "conversations")
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = heavy_join(placed, sizes, ["conv_id"], "w", n)
    return out.withColumn("at", F.col("place") - F.col("first") + 1).drop("place", "first")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, depth, x, y, words) of each turn, x and y its digest, and (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % family (all if it has fewer, none if it has none),
    h = crc32(c in decimal) % shared, and goes on with its own turns after its first h. The remainder of a negative c is
    not negative either."""
    digest = [F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y")]
    own = cut(numbered_turns(turns).select("conv_id", "at", "size", *digest, words_in(F.col("text")).alias("words")), "digests")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = own.groupBy("conv_id").agg(F.max("size").alias("size")).withColumn("h", h)
    convs = convs.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family)))
    held = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(held, "base", "left").withColumn("m", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = convs.withColumn("length", F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv_id", "base", "h", "m", "size", "length"), "shapes")
    n = convs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    mine = heavy_join(own.drop("size"), convs.select("conv_id", "h", "m", "size"), ["conv_id"], "size", n).where("at > h")
    mine = mine.select("conv_id", (F.col("at") - F.col("h") + F.col("m")).alias("depth"), "x", "y", "words")
    first = own.where((F.col("at") < shared) & (F.col("conv_id") % family == 0))
    first = first.select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "x", "y", "words")
    theirs = convs.where("m > 0").select("conv_id", "base", "m").join(first, "base").where("depth <= m")
    return mine.unionByName(theirs.select(*mine.columns)), convs.select("conv_id", "length")


def digested(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``turns`` (conv_id, depth, x, y, words) with a and b, the digest of all turns down to ``depth``, and pa and pb, that
    without the last: exclusive ors of hashes of depth and turn, 128 bits in all.

    They are run up within stretches of a conversation; what came before a stretch is run up over the stretches."""
    rows = turns.select(
        "conv_id", "depth", "words", F.floor((F.col("depth") - 1) / stretch).cast("long").alias("st"),
        F.xxhash64("depth", "x", "y").alias("x"), F.xxhash64("y", "x", "depth", F.lit(5)).alias("y"),
    )
    rows = cut(rows, "steps")
    ahead = Window.partitionBy("conv_id").orderBy("st").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "st").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = ends.select("conv_id", "st", F.bit_xor("x").over(ahead).alias("cx"), F.bit_xor("y").over(ahead).alias("cy")).where("st > 0")
    here = Window.partitionBy("conv_id", "st").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"a": F.bit_xor("x").over(here), "b": F.bit_xor("y").over(here)}).join(before, ["conv_id", "st"], "left")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0))) for k, c in (("a", F.col("cx")), ("b", F.col("cy")))}
    run = run.withColumns(whole)
    back = {"pa": F.col("a").bitwiseXOR(F.col("x")), "pb": F.col("b").bitwiseXOR(F.col("y"))}
    return run.withColumns(back).select("conv_id", "depth", "a", "b", "pa", "pb", "words")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ids (conv_id) that end at a node, ascending in decimal, with commas.

    Ids are joined in chunks of CHUNK neighbouring ones; a node's chunks then pass one after the other through one hash, of
    which only the state is held, however many ids a node has."""
    chunk = F.floor(F.col("conv_id") / CHUNK).cast("long").alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    chunks = ends.groupBy(*NODE, chunk).agg(ids)
    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *now, ids in zip(*(b.column(n).to_pylist() for n in (*NODE, "ids")), strict=True):
                if now != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield made(out)
        if key:
            yield made([(*key, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=[*NODE, "ends_sha256"])

    return dealt.select(*NODE, "ids").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str], heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``nodes`` (depth, a, b, pa, pb and ``values``) with each value summed over the node's subtree, itself included.

    Before round k a node holds the sum over the nodes less than 2**k below it, and points to the ancestor 2**k above: it
    then adds the sums of all that point to it, and points where its pointer points. So there are as many rounds as the
    greatest depth has binary digits. Each is two passes: sums go up by pointer (tasks add theirs first, so a node with any
    number of branches gets one partial sum a task), and pointers come back down, heavy ones without a shuffle."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up = [F.col("depth") >= 1, F.col("pa"), F.col("pb")]
    state = nodes.select(*NODE, *values, F.when(up[0], up[1]).alias("pa"), F.when(up[0], up[2]).alias("pb"))
    reach = 1
    while reach <= deepest:
        sent = state.where("pa is not null").groupBy((F.col("depth") - reach).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
        sent = sent.agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("w"))
        own = state.select(*NODE, *values, F.lit(0).cast("long").alias("w"), "pa", "pb")
        both = own.unionByName(sent.withColumns({"pa": F.lit(None).cast("long"), "pb": F.lit(None).cast("long")}))
        # one row of a node tells its pointer, the other what it was sent
        sums = [*(F.sum(v).alias(v) for v in values), F.sum("w").alias("w"), F.max("pa").alias("pa"), F.max("pb").alias("pb")]
        added = cut(both.groupBy(*NODE).agg(*sums), "added")
        there = F.col("depth") >= 2 * reach
        asks = added.where(there).withColumn("t", F.col("depth") - reach).drop("w")
        tells = added.where("w > 0").select(
            F.col("depth").alias("t"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("na"), F.col("pb").alias("nb"), "w"
        )
        sent_in_all = added.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        moved = heavy_join(asks, tells, ["t", "pa", "pb"], "w", sent_in_all, heavy_keys)
        moved = moved.select(*NODE, *values, F.col("na").alias("pa"), F.col("nb").alias("pb"))
        none = F.lit(None).cast("long")
        done = added.where(~there).select(*NODE, *values, none.alias("pa"), none.alias("pb"))
        state = cut(moved.unionByName(done), "jumped")
        reach *= 2
    return state.select(*NODE, *values)


def prefix_nodes(turns: DataFrame, family: int = FAMILY, shared: int = SHARED, stretch: int = STRETCH, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (rebuilt()): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text), the root that of none; conv_id is its smallest member,
    parent_conv_id its parent's (null at the root), n_leaves and saved_tokens are sums over its subtree: of childless nodes,
    and of (members - 1) times the words of a node's last text. ends_sha256 is of the ids of conversations that end there.

    Null roles and texts are empty, null turns come first, tied turns follow role and text, equal rows are turns of their own;
    rows without a conv_id go; other columns take no part; an empty table gives no node, not even the root. Sequences are
    told apart by 128 bits of hash. A conversation, a node or a branch of a third of all rows is shared by many tasks;
    only the ids that end at one node pass through one task, a chunk at a time."""
    rows, convs = rebuilt(turns, family, shared)
    steps = digested(rows, stretch)
    zero = {c: F.lit(0).cast("long") for c in ("depth", "a", "b", "pa", "pb", "words")}
    roots = convs.withColumns(zero)
    lengths = convs.withColumnRenamed("length", "depth")
    steps = cut(steps.unionByName(roots.select(*steps.columns)), "prefixes")
    grouped = steps.groupBy(*NODE, "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    below = grouped.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    nodes = grouped.join(below.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.withColumns({"n_leaves": leaf, "saved_tokens": saved, "n_children": F.coalesce("n_children", F.lit(0)).cast("long")})
    nodes = cut(nodes.drop("words"), "nodes")
    inner = nodes.where("n_children > 0").select(
        F.col("depth").alias("t"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("w")
    )
    edges = nodes.where("depth > 0").withColumn("t", F.col("depth") - 1).drop("n_leaves", "saved_tokens")
    named = heavy_join(edges, inner, ["t", "pa", "pb"], "w", edges.count(), heavy_keys)
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    named = named.select(*columns).unionByName(top.select(*columns))
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], heavy_keys)
    ends = ends_digests(steps.join(lengths, ["conv_id", "depth"], "left_semi").select(*NODE, "conv_id"))
    out = named.join(sums, NODE).join(ends, NODE, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of ``conversations``; cases as prefix_nodes() says."""
    return prefix_nodes(read(spark, sf_dir, "conversations"))


def _sql() -> str:
    from paperloom.llm.resample import crc32_sql

    return f"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - (conv_id % {FAMILY} + {FAMILY}) % {FAMILY} as base,
         {crc32_sql("conv_id::varchar")} % {SHARED} as h
  from (select distinct conv_id from own)
), parts as (
  select conv_id, pos, role, text from own join convs using (conv_id) where pos > h
  union all
  select c.conv_id, o.pos, role, text from convs c join own o on o.conv_id = c.base where o.pos <= h
), rebuilt as (
  select conv_id, role, text, row_number() over (partition by conv_id order by pos) as depth from parts
), seqs as (
  select conv_id, depth, list({{'role': role, 'text': text}}) over (partition by conv_id order by depth) as seq, text from rebuilt
  union all
  select conv_id, 0, [], '' from convs
), lengths as (
  select conv_id, max(depth) as length from seqs group by conv_id
), nodes as (
  select depth, seq, min(conv_id) as conv_id, count(*) as n_convs,
         (count(*) - 1) * length(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) as saved,
         sha256(coalesce(string_agg(case when length = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from seqs join lengths using (conv_id) group by depth, seq
), children as (
  select depth - 1 as depth, seq[:len(seq) - 1] as seq, count(*) as n_children from nodes where depth > 0 group by all
), full_nodes as (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on c.depth = n.depth and c.seq = n.seq
), above as (
  select d.depth, d.seq[:d.depth] as seq, n_children, saved
  from (select seq, n_children, saved, unnest(range(0, depth + 1)) as depth from full_nodes) d
), sums as (
  select depth, seq, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens from above group by all
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens,
       n.ends_sha256
from full_nodes n join sums s on s.depth = n.depth and s.seq = n.seq
     left join nodes p on p.depth = n.depth - 1 and p.seq = n.seq[:len(n.seq) - 1]
"""


OP12_SQL = _sql()
