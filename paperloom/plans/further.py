"""Queries of what goes beyond one pass: pseudonyms over runs, weighted search, segmented indexes, scans of hot keys, governed
SQL. Inputs are the driver's tables, or texts made of their numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import pii
from paperloom.operators import evaluate, latest, layout, listing, search, stats, vectors
from paperloom.plans.queries import ORACLE_SQL, query, t
from paperloom.plans.review import Domain, domain_query
from paperloom.sources.segments import SegmentedIndex
from paperloom.stored import shared_dir, stored

# One text a customer: an entity of each kind, made of the customer's number, and near misses.
_NAMES = [name.replace("'", "''") for name in pii.INSTITUTIONS]
_PIECES = {
    "PHONE_NUMBER_BR": "printf('9%04d-%04d', c_custkey % 10000, c_custkey % 10000)",
    "CPF": "printf('%03d.456.789-09', c_custkey % 1000)",
    "CNPJ": "printf('12.%03d.678/0001-95', c_custkey % 1000)",
    "RG": "printf('12.%03d.678-9', c_custkey % 1000)",
    "INSTITUTION": f"element_at(array({', '.join(repr(n) for n in _NAMES)}), cast(c_custkey % {len(_NAMES)} as int) + 1)",
    "MONEY": "printf('R$ %d,45', c_custkey % 1000)",
    "PROCESS_NUMBER": "printf('%d.%d/2021-05', c_custkey, c_custkey)",
    "EDITAL_NUMBER": "printf('%05d/2020', c_custkey % 100000)",
    "EMAIL_ADDRESS": "printf('u%d@mail%d.org', c_custkey, c_custkey % 7)",
    "DATE": "printf('%d/%d/2019', 1 + c_custkey % 28, 1 + c_custkey % 12)",
    "TIME": "printf('%02d:%02d', c_custkey % 24, c_custkey % 60)",
    "ZIP_CODE": "printf('%05d-%03d', c_custkey % 100000, c_custkey % 1000)",
}
MISSES = "1:30; a@b; 123.456.789; R$ 1; FIOCRUZES; 99/99/19"


def _spread(df, key: str):
    """Rows of a small file, of which each costs much, dealt over all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _duck(piece: str) -> str:
    return piece.replace("element_at(array(", "list_extract(list_value(")


@query("\nunion all ".join(f"select c_custkey, '{kind}' as kind, {_duck(p)} as entity from customer" for kind, p in _PIECES.items()))
def pii_kinds(spark, d):
    """What is found of each kind in texts that hold one entity of each and near misses."""
    parts = [F.expr(p) for p in _PIECES.values()]
    rows = _spread(t(spark, d, "customer").select("c_custkey"), "c_custkey")
    rows = rows.select("c_custkey", F.lit(0).alias("chunk_index"), F.concat_ws("; ", *parts, F.lit(MISSES)).alias("text"))
    return pii.entities(rows, "c_custkey").select("c_custkey", "kind", "entity")


_MINUTE = "strftime(ts, '%H:%M')"


@query(f"""
with e as (select user_id, event_id, 'TIME' as kind, {_MINUTE} as entity from events
           union all select user_id, event_id, 'EMAIL_ADDRESS', event_type || event_id % 50 || '@a.org' from events),
f as (select user_id, kind, entity, min(event_id) as first_at from e group by all)
select user_id, kind, entity, row_number() over (partition by user_id, kind order by first_at) - 1 as n from f""")
def pii_numbers_of_runs(spark, d):
    """Numbers of a user's entities by two runs, over their earlier and later events: those of one run over all."""
    rows = t(spark, d, "events")
    mail = F.concat("event_type", (F.col("event_id") % 50).cast("string"), F.lit("@a.org"))
    text = F.concat(F.lit("às "), F.date_format("ts", "HH:mm"), F.lit(" de "), mail).alias("text")
    spread = _spread(rows.select("user_id", "event_id", "event_type", "ts"), "event_id")
    found = stored(pii.entities(spread.select("user_id", F.col("event_id").alias("chunk_index"), text), "user_id"), "entities")
    found = found.join(rows.groupBy("user_id").agg(F.avg("event_id").alias("half")), "user_id")
    first = pii.numbers(found.where("chunk_index <= half"), "user_id").drop("new")
    second = pii.numbers(found.where("chunk_index > half"), "user_id", held=first).where("new").drop("new")
    return first.unionByName(second)


_OVERLAPS = "printf('(,00)1230%04d-%02d:%02d', c_custkey % 10000, c_custkey % 24, c_custkey % 60)"


@query(f"select c_custkey, {_OVERLAPS} as text, false as readable from customer")
def pii_overlaps(spark, d):
    """Texts whose matches overlap: what comes back of each, and whether its time or long number can still be read."""
    rows = _spread(t(spark, d, "customer").select("c_custkey"), "c_custkey")
    rows = rows.select("c_custkey", F.lit(0).alias("chunk_index"), F.expr(_OVERLAPS).alias("text"))
    out = pii.anonymise(rows, "c_custkey")
    readable = F.col("text").rlike(r"\d\d:\d\d|\d{4}-")
    return out.select("c_custkey", pii.restore(F.col("text"), F.col("pii_map")).alias("text"), readable.alias("readable"))


# One key of a third of all rows: the events of every third user are those of one.
_HOT_EVENTS = "with events as (select event_id, ts, event_type, case when user_id % 3 = 0 then 0 else user_id end as user_id from events)"


def _hot_events(spark, d):
    return t(spark, d, "events").withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))


def _under_hot_key(name: str) -> str:
    """The SQL of a query over events, over those with a hot key."""
    sql = ORACLE_SQL[name].strip()
    return f"{_HOT_EVENTS}, {sql[5:]}" if sql.startswith("with ") else f"{_HOT_EVENTS} {sql}"


@query(_under_hot_key("asof_section"))
def asof_section_hot(spark, d):
    rows = _hot_events(spark, d).withColumn("start", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    marks = rows.where("event_type = 'purchase'").withColumn("ord", F.row_number().over(w))
    marks = marks.select("user_id", "ord", "start", F.col("event_id").cast("string").alias("section"))
    chunks = rows.where("event_type <> 'purchase'").select("user_id", "event_id", "start", F.lit(100).alias("length"))
    return vectors.asof_sections(chunks, marks, "user_id", spread=True).select("user_id", "event_id", "section")


@query(_under_hot_key("lead_fill"))
def lead_fill_hot(spark, d):
    ends = F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("ends")
    rows = _hot_events(spark, d).select("user_id", "event_id", "ts", ends)
    return latest.lead_fill(rows, ["user_id"], ["ts", "event_id"], "ts", "ends", spread=True).select("event_id", "ends")


@query(_under_hot_key("islands"))
def islands_hot(spark, d):
    x0 = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = _hot_events(spark, d).select("user_id", x0.alias("x0"), (x0 + 600).alias("x1"))
    return latest.islands(rows, ["user_id"], "x0", "x1", 3600, spread=True)


@query(f"""
{_HOT_EVENTS} select event_id, '1.0.' || (row_number() over (partition by user_id order by ts, event_id) - 1) as version from events""")
def versions_hot(spark, d):
    rows = _hot_events(spark, d).select("event_id", "user_id", "ts")
    return latest.release_versions(rows, "user_id", ["ts", "event_id"], spread=True).select("event_id", "version")


_WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_WEIGHTED = (
    f"list_concat(list_transform({_WORDS_SQL.format('coalesce(source, chr(0))')}, lambda x: {{'t': x, 'w': 1.0::double}}), "
    f"list_transform({_WORDS_SQL.format('coalesce(text, chr(0))')}, lambda x: {{'t': x, 'w': 0.1::double}}))"
)


def _hits_sql(term: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(ws, lambda x: starts_with(x.t, '{term}')), lambda x, i: x.w / (i * i))), 0)"


_RANKED = f"""
select doc_id, lang, round(({_hits_sql("src1")} + {_hits_sql("th")}) / (2 * pi() * pi() / 6), 9) as rank
from (select doc_id, lang, {_WEIGHTED} as ws from documents) where {_hits_sql("src1")} > 0 and {_hits_sql("th")} > 0"""


@query(_RANKED)
def weighted_rank(spark, d):
    """Documents by source (weight A) and text (weight D), with their ranks."""
    rows = search.ranked(t(spark, d, "documents").select("doc_id", "lang", "source", "text"), {"source": "A", "text": "D"}, "src1 th")
    return rows.select("doc_id", "lang", F.round("rank", 9).alias("rank"))


@query(f"select doc_id, lang, rank from ({_RANKED}) order by lang desc, rank desc, doc_id limit 40")
def weighted_listing(spark, d):
    """The listing's own key first, rank among equals."""
    return weighted_rank(spark, d).orderBy(F.desc("lang"), F.desc("rank"), "doc_id").limit(40)


_CHANGED = """select doc_id, case when doc_id % 5 = 0 then 'renewed ' || source else text end as text from documents where doc_id % 7 <> 3"""
_CHANGED_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"


def _segmented(spark, d) -> SegmentedIndex:
    """The words of all documents; then a fifth are changed, then a seventh deleted: three updates."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source")
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}", "doc_id")
    index.update(search.postings(docs, "doc_id", ["text"]))
    new = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("renewed "), "source"))
    index.update(search.postings(new, "doc_id", ["text"]))
    index.update(search.postings(new, "doc_id", ["text"]).where("false"), docs.where("doc_id % 7 = 3"))
    return index


@query(f"""
select doc_id, len({_CHANGED_WORDS}) as n from ({_CHANGED}) where len({_CHANGED_WORDS}) > 0""")
def segment_postings(spark, d):
    """How many terms an updated index holds of each document: as many as one that is built anew."""
    index = _segmented(spark, d)
    index.merge(fan=2)
    return index.postings().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
select doc_id from (select doc_id, {_CHANGED_WORDS} as w from ({_CHANGED}))
where len(list_filter(w, lambda x: starts_with(x, 'renew'))) > 0 and len(list_filter(w, lambda x: starts_with(x, 'src1'))) > 0""")
def segment_search(spark, d):
    return _segmented(spark, d).search("renew src1")


@domain_query("""
select a.id, count(*) as n from documents a join documents b on a.created_by = b.created_by and a.id <> b.id
where exists (select 1 from users u where u.id = a.created_by) group by a.id""")
def governed_sql(spark, d):
    """SQL text with a self join and a subquery: no deleted row on either side."""
    text = """select a.id, count(*) as n from {documents} a join {documents} b on a.created_by = b.created_by and a.id <> b.id
              where exists (select 1 from {users} u where u.id = a.created_by) group by a.id"""
    return Domain(spark, d).sql(text, "documents", "users")


@domain_query("""
select (select count(*) from documents) as live, (select count(*) from documents_all) as every,
       (select count(*) from documents_all a where not exists (select 1 from documents b where a.id = b.id)) as gone""")
def governed_views(spark, d):
    """Views for SQL, live and all."""
    Domain(spark, d).register("documents", prefix="review_")
    return spark.sql("""select (select count(*) from review_documents) as live, (select count(*) from review_documents_all) as every,
      (select count(*) from review_documents_all a where not exists (select 1 from review_documents b where a.id = b.id)) as gone""")


def _every_hundredth_fails(payloads: list[dict]) -> list[dict]:
    """A model that can't bear some payloads, and judges by the length of the others."""
    if any(int(p["branch_id"]) % 97 == 5 for p in payloads):
        raise ValueError("unreadable")
    return [{"feedback": p["requirement"], "fulfilled": len(p["context"]) % 2 == 0, "score": len(p["context"]) % 11, "cited": []} for p in payloads]


@query("""
select o_orderkey::varchar as branch_id, case when o_orderkey % 97 = 5 then 'not evaluated: unreadable' else o_orderpriority end as feedback,
  case when o_orderkey % 97 <> 5 then length(o_clerk) % 2 = 0 end as fulfilled, case when o_orderkey % 97 <> 5 then (length(o_clerk) % 11)::int end as score
from (select *, o_orderdate::varchar || o_orderstatus as o_clerk from orders)""")
def evaluation_in_parts(spark, d):
    """A verdict for every payload but those that fail by themselves."""
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("branch_id"), F.col("o_orderpriority").alias("requirement"),
        F.concat(F.col("o_orderdate").cast("string"), "o_orderstatus").alias("context"),
    )
    return evaluate.evaluate(rows, _every_hundredth_fails).select("branch_id", "feedback", "fulfilled", "score")


@domain_query("""
select u.id, u.username, count(*) as n from documents d join users u on d.created_by = u.id group by all order by n desc, u.id limit 5""")
def named_activity(spark, d):
    """The busiest users by key and name."""
    own = Domain(spark, d)
    users = own.table("users").select(F.col("id").alias("created_by"), "username")
    rows = own.table("documents").join(users, "created_by").select(F.col("created_by").alias("id"), "username")
    return stats.most_used(rows, ["id", "username"], 5)


@domain_query("""
select id, case when name = '1-URGENT' or created_by in (select id from users where username like '%7') or id in (select document_id from histories where status = 'R')
  then 'renamed' else name end as name from documents""")
def update_matching(spark, d):
    """Rows renamed by a condition or by ids of other tables."""
    own = Domain(spark, d)
    matches = {
        "created_by": own.table("users").where("username like '%7'").select("id"),
        "id": own.table("document_histories").where("status = 'R'").select("document_id"),
    }
    return listing.update_matching(own.table("documents"), matches, F.col("name") == "1-URGENT", name=F.lit("renamed")).select("id", "name")


_CHECKS = "select p_brand as k, p_size % 5 <> 0 as passed, 'size' as section from part"
_VISUALS = "select p_brand as k, bool_or(p_partkey % 11 = 0) as skipped, min(p_partkey) % 7 <> 0 as rendered, max(p_partkey) % 5 = 0 as failed, sum(p_size) % 2 = 0 as verdict from part group by p_brand"


@query(f"""
with v as ({_VISUALS}), every as ({_CHECKS} union all
  select k, case when skipped then true when not rendered then false when failed then false else verdict end, 'visual' from v)
select k, section, bool_and(passed) as passed, count(*) as n from every group by all""")
def visual_rollup(spark, d):
    """Sections with the visual criterion among them."""
    parts = t(spark, d, "part")
    checks = parts.select(F.col("p_brand").alias("k"), (F.col("p_size") % 5 != 0).alias("passed"), F.lit("size").alias("section"))
    visuals = parts.groupBy(F.col("p_brand").alias("k")).agg(
        F.bool_or(F.col("p_partkey") % 11 == 0).alias("skipped"), (F.min("p_partkey") % 7 != 0).alias("rendered"),
        (F.max("p_partkey") % 5 == 0).alias("failed"), (F.sum("p_size") % 2 == 0).alias("verdict"),
    )
    rows = layout.with_visual(checks, visuals, ["k"])
    return layout.sections(rows, rows, ["k"])


@query("""
select c_custkey, c_custkey % 3 = 0 and c_custkey % 5 <> 0 as strong, split_part(c_name, '#', 1) as base,
  case when c_custkey % 4 = 0 then null else 'x' end as kept, c_custkey % 2 = 0 as image,
  c_custkey % 6 > 2 as late, 'data:image/png;base64,' || base64(encode(c_name)) as url,
  substr(sha256(encode(c_name)), 1, 16) || '_' || c_custkey || '.png' as unique_name,
  list_filter(range(1, 6), lambda p: p <> c_custkey % 5 + 1) as pages
from customer""")
def small_functions(spark, d):
    """Passwords, base names, empty texts, images, expiry, addresses of data, unique names, page ranges."""
    from paperloom.functions import text
    from paperloom.operators import context

    k = F.col("c_custkey")
    strong = F.when(k % 5 == 0, "Short1a").when(k % 3 == 0, "Longer1word").when(k % 3 == 1, "longer1word").otherwise("LongerWord")
    now, file = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.concat(k.cast("string"), F.when(k % 2 == 0, ".PNG").otherwise(".txt"))
    bytes_ = F.col("c_name").cast("binary")
    return t(spark, d, "customer").select(
        "c_custkey", text.password_ok(strong).alias("strong"),
        context.basename(F.concat(F.lit("/a/b/"), F.split("c_name", "#")[0])).alias("base"),
        text.empty_to_null(F.when(k % 4 == 0, "").otherwise("x")).alias("kept"), text.is_image(file).alias("image"),
        text.expired(text.expires(now, 3), now + F.make_dt_interval(mins=(k % 6 + 1).cast("int"))).alias("late"),
        text.data_url(bytes_).alias("url"), text.unique_name(bytes_, F.concat(k.cast("string"), F.lit(".png"))).alias("unique_name"),
        layout.page_range(F.lit(1), F.lit(5), F.array((k % 5 + 1).cast("int"))).alias("pages"),
    )
