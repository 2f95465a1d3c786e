"""Queries over the driver's tables, one or more for each operator family, with DuckDB SQL where it can express them.

Tables stand in for the review domain: region, nation and customer for the criteria tree; orders and lineitem for releases
and applied items; events for histories and audit logs (``error`` events are deleted rows); embeddings for the vector
store (label: source, vec_id: chunk index); documents for chunks; conversations for messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import pii, text
from paperloom.operators import audit, context, evaluate, latest, layout, listing, search, stats, tree, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def live_events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where("event_type <> 'error'")


@query("""
select n_name, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey group by n_name order by n desc, n_name limit 10""")
def top_usage(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.most_used(rows.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), ["n_name"], 10)


@query("""
select user_id, count(*) as n from events where event_type <> 'error' group by user_id order by n desc, user_id limit 5""")
def user_activity(spark, d):
    return stats.most_used(live_events(spark, d), ["user_id"], 5)


@query("""
select (select count(*) from customer) as users, (select count(*) from orders) as documents,
       (select count(*) from events where event_type <> 'error') as analyses""")
def kpi_row(spark, d):
    return stats.kpi_row(users=t(spark, d, "customer"), documents=t(spark, d, "orders"), analyses=live_events(spark, d))


@query("""
select c_custkey, c_name, count(o_orderkey) as total, count(*) filter (where o_orderstatus = 'P') as pending
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name""")
def pending_metrics(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return stats.metrics(t(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", F.col("o_orderstatus") == "P")


@query("""
select user_id, event_id, ts, event_type from events where event_type <> 'error'
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_status(spark, d):
    return latest.latest(live_events(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type")


@query("""
with last as (select conv_id, turn, text from conversations where role = 'assistant'
              qualify row_number() over (partition by conv_id order by turn desc) = 1)
select c.conv_id, c.n, last.turn, length(last.text) as n_chars
from (select conv_id, count(*) as n from conversations group by conv_id) c join last using (conv_id)""")
def latest_required_inner(spark, d):
    rows = t(spark, d, "conversations")
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    out = latest.with_latest(counts, rows.where("role = 'assistant'"), "conv_id", ["turn"])
    return out.select("conv_id", "n", "turn", F.char_length("text").alias("n_chars"))


@query("""
select o_orderkey, o_custkey, '1.0.' || (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)
       as version from orders""")
def release_versions(spark, d):
    out = latest.release_versions(t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "version")


@query("""
with v as (select o_orderkey, case when o_orderkey % 5 = 0 then null else (o_orderkey % 3) || '.' || (o_orderkey % 7)
             || case when o_orderkey % 2 = 0 then '.' || (o_orderkey % 11) else '' end end as version,
             case o_orderkey % 4 when 0 then 'major' when 1 then 'minor' else 'patch' end as part from orders),
p as (select *, cast(split_part(version, '.', 1) as int) a, cast(split_part(version, '.', 2) as int) b,
             coalesce(try_cast(nullif(split_part(version, '.', 3), '') as int), 0) c from v)
select o_orderkey, case when version is null then '1.0.0' when part = 'major' then (a + 1) || '.0.0'
  when part = 'minor' then a || '.' || (b + 1) || '.0' else a || '.' || b || '.' || (c + 1) end as next from p""")
def version_bump(spark, d):
    k = F.col("o_orderkey")
    long = F.when(k % 2 == 0, F.concat(F.lit("."), (k % 11).cast("string"))).otherwise(F.lit(""))
    version = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat((k % 3).cast("string"), F.lit("."), (k % 7).cast("string"), long))
    part = F.when(k % 4 == 0, "major").when(k % 4 == 1, "minor").otherwise("patch")
    return t(spark, d, "orders").select("o_orderkey", latest.bumped(version, part).alias("next"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def paged_listing(spark, d):
    rows = listing.ordered(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "desc", "o_orderkey")
    return listing.page(rows, 100, 50)


@query("""
select p_partkey, p_name from part where p_name ilike '%an%' or p_type ilike '%an%'""")
def ilike_search(spark, d):
    return t(spark, d, "part").where(listing.ilike_any(["p_name", "p_type"], "an")).select("p_partkey", "p_name")


@query("""
select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey
where c_name ilike '%9%' or n_name ilike '%9%'""")
def ilike_joined(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(listing.ilike_any(["c_name", "n_name"], "9")).select("c_custkey", "c_name", "n_name")


@query("""
select event_id, user_id, event_type from events
where ts between timestamp '2024-01-05' and timestamp '2024-01-09' and event_type <> 'error'""")
def date_range_filter(spark, d):
    from datetime import datetime

    rows = listing.both_bounds(live_events(spark, d), "ts", datetime(2024, 1, 5), datetime(2024, 1, 9))
    rows = listing.both_bounds(rows, "ts", datetime(2024, 1, 6), None)  # one bound: not applied
    return listing.optional(rows, event_type=None).select("event_id", "user_id", "event_type")


@query("""
select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def semi_lookup(spark, d):
    return listing.in_query(t(spark, d, "orders"), "o_orderkey", t(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey").select("o_orderkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_orphans(spark, d):
    return listing.missing(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders"), "o_custkey").select("c_custkey")


@query("""
select user_id, event_type, count(*) as n from events where event_type <> 'error' group by user_id, event_type having count(*) > 1""")
def unique_active_check(spark, d):
    return listing.duplicate_keys(live_events(spark, d), ["user_id", "event_type"])


@query("""
with o as (select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then null else o_orderpriority end as p from orders)
select a.o_orderkey from o a where exists (select 1 from o b where a.o_custkey = b.o_custkey
  and a.p is not distinct from b.p and a.o_orderkey <> b.o_orderkey)""")
def null_safe_pair(spark, d):
    p = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p")
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", p)
    return listing.conflicts(rows, rows, ["o_custkey", "p"], "o_orderkey").select("o_orderkey")


@query("""
select r_name, n_name, c_name from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey""")
def tree_flatten(spark, d):
    out = tree.flatten(t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "customer"), "n_regionkey", "c_nationkey", "r_regionkey", "n_nationkey")
    return out.select(F.col("root_r_name").alias("r_name"), F.col("mid_n_name").alias("n_name"), F.col("leaf_c_name").alias("c_name"))


@query("""
select r_name, n, names from (select r_regionkey, r_name from region) join
  (select n_regionkey, count(*) as n, string_agg(n_name || ':' || cs, ',' order by n_name) as names from
     (select n_regionkey, n_name, count(c_custkey) as cs from nation left join customer on c_nationkey = n_nationkey
      group by n_regionkey, n_name) group by n_regionkey) on n_regionkey = r_regionkey""")
def tree_nested(spark, d):
    leaves = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    mids = tree.nest(t(spark, d, "nation"), leaves, "n_nationkey", "c_nationkey", "c_custkey", "branches")
    roots = tree.nest(t(spark, d, "region"), mids, "r_regionkey", "n_regionkey", "n_name", "taxonomies")
    shown = F.transform("taxonomies", lambda x: F.concat_ws(":", x["n_name"], F.size(x["branches"]).cast("string")))
    return roots.select("r_name", F.size("taxonomies").cast("long").alias("n"), F.array_join(shown, ",").alias("names"))


_LEX = "list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"


@query(f"""
select doc_id from (select doc_id, {_LEX} as w from documents)
where len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 and len(list_filter(w, lambda x: starts_with(x, 'and'))) > 0""")
def prefix_search(spark, d):
    return search.search(t(spark, d, "documents").select("doc_id", "text"), ["text"], "th & and!").select("doc_id")


@query(f"""
select doc_id from (select doc_id, {_LEX} as w from documents)
where len(list_filter(w, lambda x: starts_with(x, 'qu'))) > 0 and len(list_filter(w, lambda x: starts_with(x, 'de'))) > 0""")
def prefix_postings(spark, d):
    return search.search_postings(search.postings(t(spark, d, "documents"), "doc_id", ["text"]), "doc_id", "qu de")


_KNN = """
with q as (select vec_id as query_id, label, embedding::double[] as v from embeddings where vec_id % {m} = 0),
s as (select query_id, c.vec_id, round(1 - list_dot_product(q.v, c.embedding::double[]) /
        (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.embedding::double[], c.embedding::double[]))), 9) as distance
      from q join embeddings c using (label)),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from s)
select query_id, vec_id, cast(rank as integer) as rank from r where rank <= {k}"""


def _knn(spark, d, m, k):
    rows = t(spark, d, "embeddings").select("vec_id", F.col("label").alias("source"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = rows.where(F.col("vec_id") % m == 0).select(F.col("vec_id").alias("query_id"), "source", F.col("embedding").alias("vector"))
    return vectors.knn(queries, rows, k, key="vec_id").select("query_id", "vec_id", "rank")


@query(_KNN.format(m=20, k=5))
def knn_filtered(spark, d):
    return _knn(spark, d, 20, 5)


@query(_KNN.format(m=20, k=3))
def knn_batch(spark, d):
    return _knn(spark, d, 20, 3)


@query(f"""
with hits as ({_KNN.format(m=20, k=5)}),
h as (select distinct label, vec_id from hits join embeddings using (vec_id))
select distinct e.label as source, e.vec_id as chunk_index from embeddings e join h on e.label = h.label
 and e.vec_id between greatest(0, h.vec_id - 2) and h.vec_id + 2""")
def neighbour_expand(spark, d):
    """Neighbours of what the search finds for its whole query set."""
    chunks = t(spark, d, "embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("chunk_index"))
    hits = _knn(spark, d, 20, 5).select(F.col("vec_id").alias("chunk_index")).distinct()
    return vectors.neighbours(chunks.join(hits, "chunk_index", "left_semi"), chunks)


@query("""
with cited as (select event_id as ord, user_id as chunk_id from events where event_type = 'click'),
f as (select chunk_id, min(ord) as ord from cited group by chunk_id)
select ord, chunk_id, c_name as title from f join customer on c_custkey = chunk_id""")
def citation_resolve(spark, d):
    cited = t(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("ord"), F.col("user_id").alias("chunk_id"))
    got = t(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("title"))
    return vectors.citations(cited, got)


@query("""
with l as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, sha256(regexp_replace(string_agg(case when before is null then '' when before <> role then chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end
   || case when before is null or before <> role then '## CONTEXTO DA SESSÃO: ' || role || chr(10) else '' end
   || '[FONTE] chunk_id: ' || turn || chr(10) || text, '' order by turn), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as digest
from l group by conv_id""")
def context_format(spark, d):
    rows = t(spark, d, "conversations").select(
        "conv_id", F.col("turn").alias("chunk_index"), F.col("role").alias("section_title"), F.col("turn").alias("chunk_id"),
        text.with_header(F.col("text"), F.col("role")).alias("text"),
    )
    return context.context(rows, ["conv_id"]).select("conv_id", F.sha2("context", 256).alias("digest"))


@query("""
with c as (select user_id, event_id, floor(epoch(ts))::bigint + 50 as mid from events where event_type <> 'purchase'),
s as (select user_id, floor(epoch(ts))::bigint as start, event_id from events where event_type = 'purchase')
select c.user_id as user_id, c.event_id as event_id, s.event_id::varchar as section
from c asof left join (select user_id, start, max(event_id) as event_id from s group by user_id, start) s
  on c.user_id = s.user_id and c.mid >= s.start""")
def asof_section(spark, d):
    rows = t(spark, d, "events").withColumn("start", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    marks = rows.where("event_type = 'purchase'").withColumn("ord", F.row_number().over(w))
    marks = marks.select("user_id", "ord", "start", F.col("event_id").cast("string").alias("section"))
    chunks = rows.where("event_type <> 'purchase'").select("user_id", "event_id", "start", F.lit(100).alias("length"))
    return vectors.asof_sections(chunks, marks, "user_id").select("user_id", "event_id", "section")


@query("""
select event_id, coalesce(case when event_id % 4 = 0 then ts + interval 1 hour end,
  lead(ts) over (partition by user_id order by ts, event_id)) as ends from events""")
def lead_fill(spark, d):
    ends = F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("ends")
    rows = t(spark, d, "events").select("user_id", "event_id", "ts", ends)
    return latest.lead_fill(rows, ["user_id"], ["ts", "event_id"], "ts", "ends").select("event_id", "ends")


@query("""
with e as (select user_id, epoch(ts) as x0, epoch(ts) + 600 as x1 from events),
m as (select *, max(x1) over (partition by user_id order by x0, x1 rows between unbounded preceding and 1 preceding) as r from e),
i as (select *, sum(case when r is null or x0 - r > 3600 then 1 else 0 end) over
        (partition by user_id order by x0, x1 rows unbounded preceding) as g from m)
select user_id, min(x0)::double as x0, max(x1)::double as x1, count(*) as n from i group by user_id, g""")
def islands(spark, d):
    x0 = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t(spark, d, "events").select("user_id", x0.alias("x0"), (x0 + 600).alias("x1"))
    return latest.islands(rows, ["user_id"], "x0", "x1", 3600)


@query("""
select doc_id, i as ord, substr(text, i * 3000 + 1, 3000) as part
from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 3000.0) as bigint))) as i from documents)""")
def fixed_windows(spark, d):
    return text.fixed_windows(t(spark, d, "documents"), "doc_id")


@query(r"select doc_id, trim(regexp_replace(replace(text, chr(0), ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) as text from documents")
def clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query()
def recursive_chunks(spark, d):
    return text.recursive_chunks(t(spark, d, "documents"), "doc_id")


@query(r"""
with recursive w as (select conv_id, turn, unnest(string_split_regex(text, '\s+')) as word,
    generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 as ord from conversations),
l as (select conv_id, turn, ord // 8 as l, string_agg(word, ' ' order by ord) as text,
    [min((ord % 8) * 50)::double, min(ord // 8 * 12)::double, max((ord % 8) * 50 + 45)::double, max(ord // 8 * 12 + 10)::double] as rect from w group by all),
f as (select conv_id, turn, l, 0 as n, length(text) + 1 as used from l where l = 0 union all
  select l.conv_id, l.turn, l.l, case when f.used > 0 and f.used + length(l.text) + 1 > 500 then f.n + 1 else f.n end,
    case when f.used > 0 and f.used + length(l.text) + 1 > 500 then length(l.text) + 1 else f.used + length(l.text) + 1 end
  from f join l on l.conv_id = f.conv_id and l.turn = f.turn and l.l = f.l + 1),
c as (select conv_id as doc_id, turn as page, n, 'chunk_' || turn || '_' || n as chunk_id,
  trim(regexp_replace(string_agg(l.text, ' ' order by l.l), '\s+', ' ', 'g')) as text, list(rect order by l.l) as rects
  from f join l using (conv_id, turn, l) group by all)
select *, row_number() over (partition by doc_id order by page, n) - 1 as chunk_index from c where text <> ''""")
def coordinate_chunks(spark, d):
    """Words of conversations, placed on pages: a turn is a page, eight words a line."""
    w = F.posexplode(F.split("text", r"\s+")).alias("ord", "text")
    words = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), w)
    line = F.floor(F.col("ord") / 8)
    words = words.withColumns(
        {"x0": (F.col("ord") % 8) * 50.0, "y0": line * 12.0, "x1": (F.col("ord") % 8) * 50.0 + 45, "y1": line * 12.0 + 10,
         "block_no": F.lit(0), "line_no": line}
    )
    return text.coordinate_chunks(words)


@query(r"""
select doc_id, len(regexp_extract_all(text, '\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}-?\d{4}\b')) as phone_number_br,
  len(regexp_extract_all(text, '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b')) as cpf, len(regexp_extract_all(text, '\b\d{2}\.?\d{3}\.?\d{3}/\d{4}-\d{2}\b')) as cnpj,
  len(regexp_extract_all(text, '\b\d{2}\.?\d{3}\.?\d{3}-?\d{1,2}\b')) as rg,
  len(regexp_extract_all(text, '(?i)\b(?:FIOCRUZ|Fundação Oswaldo Cruz|Instituto  Nacional  de  Saúde  da  Mulher,  da  Criança  e  do Adolescente Fernandes Figueira|Ministério da Saúde/ANVISA|Fiocruz|fiocruz)\b')) as institution,
  len(regexp_extract_all(text, '(?i)R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}')) as money, len(regexp_extract_all(text, '\b\d+\.\d+/\d{4}-\d{2}\b')) as process_number,
  len(regexp_extract_all(text, '\b\d{2,5}/\d{4}\b')) as edital_number,
  len(regexp_extract_all(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b')) as email_address,
  len(regexp_extract_all(text, '\b(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/\d{4}\b')) as date,
  len(regexp_extract_all(text, '\b(?:[01]\d|2[0-3]):[0-5]\d\b')) as time, len(regexp_extract_all(text, '\b\d{5}-?\d{3}\b')) as zip_code from documents""")
def pii_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", *pii.counts(F.col("text")))


@query()
def pii_placeholders(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    return pii.placeholders(pii.entities(docs, "doc_id"), "doc_id")


@query("""
select doc_id from documents where text is not null""")
def pii_round_trip(spark, d):
    """Documents whose restored text is their own: all of them."""
    docs = t(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text", F.col("text").alias("own"))
    out = pii.anonymise(docs, "doc_id")
    return out.where(pii.restore(F.col("text"), F.col("pii_map")) == F.col("own")).select("doc_id")


@query("""
with m as (select event_id, 'see <' || event_type || ':' || user_id || '> and <my doc:' || event_id || '/x y>' as s from events)
select event_id, unnest(regexp_extract_all(s, '<([^:]+):([^>]+)>', 1)) as type,
       unnest(regexp_extract_all(s, '<([^:]+):([^>]+)>', 2)) as id from m""")
def tag_extract(spark, d):
    s = F.format_string("see <%s:%d> and <my doc:%d/x y>", "event_type", "user_id", "event_id")
    out = t(spark, d, "events").select("event_id", F.explode(context.tags(s)).alias("x"))
    return out.select("event_id", "x.type", "x.id")


@query("""
with n as (select l_returnflag, l_shipmode, count(*) as c, min(p) as p from
  (select l_returnflag, l_quantity as l_shipmode, l_orderkey * 10 + l_linenumber as p from lineitem) group by 1, 2)
select l_returnflag, l_shipmode as mode from n qualify row_number() over (partition by l_returnflag order by c desc, p) = 1""")
def layout_mode(spark, d):
    rows = t(spark, d, "lineitem").withColumn("p", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return layout.first_mode(rows, ["l_returnflag"], "l_quantity", "p")


@query("select l_returnflag, l_linestatus, median(l_quantity) as med from lineitem group by all")
def layout_median(spark, d):
    return layout.medians(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], med="l_quantity")


@query("""
with n as (select p_brand, p_size, sum(length(p_name)) as w from part group by 1, 2)
select p_brand, p_size as mode from n qualify row_number() over (partition by p_brand order by w desc, p_size) = 1""")
def weighted_mode(spark, d):
    return layout.weighted_mode(t(spark, d, "part").withColumn("w", F.char_length("p_name")), ["p_brand"], "p_size", "w")


_METRICS = """
with m as (select c_nationkey as k, max(c_acctbal) as font_size, min(c_acctbal) as leading from customer group by 1),
s as (select s_nationkey as k, max(s_acctbal) as font_size, min(s_acctbal) as leading from supplier group by 1),
c as (select k, 'font_size' as criterion, m.font_size as expected, s.font_size as found, abs(m.font_size - s.font_size) <= 0.7 as passed
      from m join s using (k)
      union all select k, 'leading', m.leading, s.leading, abs(m.leading - s.leading) <= 35 from m join s using (k))
"""


def _checks(spark, d):
    m = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("font_size"), F.min("c_acctbal").alias("leading"))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("font_size"), F.min("s_acctbal").alias("leading"))
    return layout.tolerance_checks(m, s, ["k"])


@query(_METRICS + "select * from c")
def tolerance_check(spark, d):
    return _checks(spark, d)


@query(_METRICS + """select k, count(*) as total, count(*) filter (where passed) as passed, bool_and(passed) as compliant
from c group by k""")
def compliance_rollup(spark, d):
    return layout.summary(_checks(spark, d), ["k"], need_rows=True)


@query(_METRICS + """select k, criterion as section, passed, 1 as n from c
union all select k, 'margin_top', false, 0 from (select distinct k from c)""")
def section_rollup(spark, d):
    checks = _checks(spark, d).withColumnRenamed("criterion", "section")
    names = F.explode(F.array(*[F.lit(x) for x in ("font_size", "leading", "margin_top")])).alias("section")
    return layout.sections(checks, checks.select("k").distinct().select("k", names), ["k"])


@query("""
with r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as a,
  row_number() over (partition by c_nationkey order by c_acctbal, c_custkey desc) as b from customer)
select c_nationkey, c_custkey, 'top' as side, a as place from r where a <= 2
union all select c_nationkey, c_custkey, 'bottom', 3 - b from r where b <= 2""")
def top_bottom(spark, d):
    return stats.top_and_bottom(t(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "side", "place")


@query("""
with p as (select event_id as id, event_type, props, lag(props) over (partition by user_id order by ts, event_id) as old from events)
select id, case when event_type = 'login' then 'Registro criado.' when event_type = 'logout' then 'Registro removido.'
  when old is null then 'Registro alterado.' when old ->> '$.k' = props ->> '$.k' then 'Salvo sem alterações.'
  else 'Alterou K de ' || chr(39) || (old ->> '$.k') || chr(39) || ' para ' || chr(39) || (props ->> '$.k') || chr(39) end as description from p""")
def audit_diff(spark, d):
    old = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    action = F.when(F.col("event_type") == "login", "CREATE").when(F.col("event_type") == "logout", "DELETE").otherwise("UPDATE")
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), action.alias("action"), old.alias("old_data"), F.col("props").alias("new_data"))
    return audit.audit_diff(rows)


@query("select event_id, cast(props ->> '$.k' as bigint) as k from events where (props ->> '$.k') in ('1', '2', '3')")
def json_extract(spark, d):
    rows = t(spark, d, "events").where(listing.json_is("props", "k", 1, 2, 3))
    return rows.select("event_id", listing.json_text("props", "k").cast("long").alias("k"))


@query("select distinct u as user_id from (select o_custkey as u from orders union all select user_id from events)")
def fanout_targets(spark, d):
    both = t(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.lit(None).cast("long").alias("b"))
    both = both.unionByName(t(spark, d, "events").select(F.lit(None).cast("long").alias("a"), F.col("user_id").alias("b")))
    return context.fanout(both, "a", "b")


@query("""
with p as (select lag(event_type) over (partition by user_id order by ts, event_id) as from_state, event_type as to_state from events)
select from_state, to_state, count(*) as n from p where from_state is not null group by 1, 2""")
def state_transitions(spark, d):
    return latest.transitions(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as d from conversations)
select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as rn from r where d <= 3""")
def last_messages(spark, d):
    return latest.last_n_in_order(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("select c_custkey as k from customer union all select s_suppkey from supplier")
def union_all(spark, d):
    customers, suppliers = t(spark, d, "customer"), t(spark, d, "supplier")
    return listing.concatenated(customers.select(F.col("c_custkey").alias("k")), suppliers.select(F.col("s_suppkey").alias("k")))


@query("""
with a as (select o_custkey as k, list(distinct month(o_orderdate)) as m from orders group by 1),
b as (select user_id as k, list(distinct day(ts)) as m from events group by 1)
select k, array_to_string(list_sort(list_filter(b.m, lambda x: not list_contains(a.m, x))), ',') as added,
       array_to_string(list_sort(list_filter(a.m, lambda x: not list_contains(b.m, x))), ',') as removed from a join b using (k)""")
def array_diff(spark, d):
    a = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.month("o_orderdate")).alias("a"))
    b = t(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.collect_set(F.dayofmonth("ts")).alias("b"))
    added, removed = (F.array_join(x, ",") for x in audit.list_changes(F.col("a"), F.col("b")))
    return a.join(b, "k").select("k", added.alias("added"), removed.alias("removed"))


@query("""
select c_custkey, c_name as name, coalesce(n_name, 'none') as parent from customer left join nation
on c_nationkey = n_nationkey and n_regionkey <> 0""")
def left_lookup(spark, d):
    n = t(spark, d, "nation").where("n_regionkey <> 0")
    out = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.col("c_name").alias("name"), F.coalesce("n_name", F.lit("none")).alias("parent"))


@query("""
select a.conv_id, a.turn, b.role as quoted from conversations a left join conversations b
on a.conv_id = b.conv_id and b.turn = a.turn - 1""")
def quoted_messages(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumn("before", F.col("turn") - 1)
    return tree.with_quoted(rows, ["conv_id", "turn"], ["conv_id", "before"], quoted="role").select("conv_id", "turn", "quoted")


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'done' else o_orderstatus end as o_orderstatus from orders""")
def set_update(spark, d):
    return listing.update_where(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", o_orderstatus=F.lit("done"))


@query("""
select distinct o_custkey, o_orderpriority from orders o where not exists
 (select 1 from orders x where x.o_orderkey % 2 = 0 and x.o_custkey = o.o_custkey and x.o_orderpriority = o.o_orderpriority)""")
def get_or_create(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return listing.get_or_create(rows, rows.where("o_orderkey % 2 = 0"), ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority")


@query("""
select c_custkey, case when length(d) = 0 then null when starts_with(d, '55') then d else '55' || d end as phone
from (select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as d from customer)""")
def phone_normal(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.phone_normal(F.col("c_name")).alias("phone"))


@query("""
select p_partkey, case when p_size is null then 'indeterminado' else (select l from (values (0, 1.0, 'simples'), (1, 1.15, '1.15'), (2, 1.5, '1.5'), (3, 2.0, 'duplo')) v(i, s, l)
  order by abs(p_size / 25.0 - s), i limit 1) end as label from part""")
def spacing_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", layout.spacing_label(F.col("p_size") / 25.0).alias("label"))


@query()
def evaluation(spark, d):
    """Every document's chunks as one context, asked for the words of its first line and of its language."""
    docs = t(spark, d, "documents").where("text is not null")
    chunks = text.fixed_windows(docs, "doc_id").select(
        "doc_id", F.col("ord").alias("chunk_index"), F.format_string("%d-%d", "doc_id", "ord").alias("chunk_id"), F.lit("").alias("section_title"), F.col("part").alias("text")
    )
    asked = docs.select("doc_id", F.concat_ws(" ", F.substring_index("text", "\n", 1), "lang").alias("requirement"))
    rows = asked.join(context.context(chunks, ["doc_id"]), "doc_id").withColumn("branch_id", F.col("doc_id").cast("string"))
    return evaluate.evaluate(rows).select("branch_id", "feedback", "fulfilled", "score", F.size("cited").alias("n_cited"), "attempts")


# earlier names of the searches over the whole query set
for _old, _new in (("knn_every20", "knn_filtered"), ("neighbour_hits", "neighbour_expand")):
    QUERIES[_old], ORACLE_SQL[_old] = QUERIES[_new], ORACLE_SQL[_new]
