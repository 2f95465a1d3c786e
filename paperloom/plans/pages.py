"""Queries of page layout, reference sections and sections of texts. Orders stand in for the lines of files (forty customers each): two
text columns, indents, headings, numbers; conversations for texts with sections."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import layout, tree, vectors
from paperloom.plans.queries import query, t

# One line an order, with its place (o), file (k), page and box; a line of text is of its file's style.
_LINES = """
l as (select o_custkey // 40 as k, o_orderkey as o, 1 + o_orderkey // 500 as page, ((o_orderkey % 500) * 2)::double as y0,
  ((o_orderkey % 500) * 2 + 1)::double as y1, (50 + 250 * (o_orderkey % 2) + case when o_orderkey % 7 = 0 then 20 else 0 end)::double as x0,
  (250 + 250 * (o_orderkey % 2) - 3 * (o_orderkey % 5))::double as x1, case when o_orderkey % 97 = 3 then 'Referências'
    when o_orderkey % 89 = 5 then '2. Apêndices' when o_orderkey % 13 = 0 then o_orderkey::varchar when o_orderkey % 17 = 0 then ' '
    when o_custkey // 40 % 4 = 0 then '[' || o_orderkey || '] x' when o_custkey // 40 % 4 = 1 then o_orderkey || '. x'
    when o_custkey // 40 % 4 = 2 then '(' || o_orderkey || ') x' else 'line ' || o_orderkey end as text from orders)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 40)
    n = o.cast("string")
    told = F.when(o % 97 == 3, "Referências").when(o % 89 == 5, "2. Apêndices").when(o % 13 == 0, n).when(o % 17 == 0, " ")
    told = told.when(c % 4 == 0, F.concat(F.lit("["), n, F.lit("] x"))).when(c % 4 == 1, F.concat(n, F.lit(". x")))
    told = told.when(c % 4 == 2, F.concat(F.lit("("), n, F.lit(") x"))).otherwise(F.concat(F.lit("line "), n))
    x0 = 50 + 250 * (o % 2) + F.when(o % 7 == 0, 20).otherwise(0)
    y0 = (o % 500) * 2
    return t(spark, d, "orders").select(
        c.alias("k"), o.alias("ord"), (F.floor(o / 500) + 1).alias("page"), y0.cast("double").alias("y0"), (y0 + 1).cast("double").alias("y1"),
        x0.cast("double").alias("x0"), (250 + 250 * (o % 2) - 3 * (o % 5)).cast("double").alias("x1"), told.alias("text"), F.lit(600.0).alias("page_w"),
    )


_COLUMNS = f"""{_LINES},
s as (select *, max(x1) over (partition by k order by x0, x1, o rows between unbounded preceding and 1 preceding) as m from l),
g as (select k, x0, x1, sum(case when x0 - m <= 10 then 0 else 1 end) over (partition by k order by x0, x1, o rows unbounded preceding) as g from s),
c as (select k, min(x0) as x0, max(x1) as x1, count(*) as n from g group by k, g having max(x1) - min(x0) >= 90)"""


def columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns_of_page(lines(spark, d), ["k"]).drop("page_w")


@query(f"with {_COLUMNS} select k, x0, x1, n from c")
def text_columns(spark, d):
    return columns(spark, d)


@query(f"""
with {_COLUMNS}, n as (select k, lead(x0) over (partition by k order by x0, x1) - x1 as gap from c)
select k, round(coalesce(avg(gap) * 25.4::double / 72, 0), 6) as gutter from n group by k""")
def column_gutters(spark, d):
    return layout.gutter(columns(spark, d), ["k"]).withColumn("gutter", F.round("gutter", 6))


@query(f"""
with {_COLUMNS}, i as (select l.k, c.x1 - l.x1 <= 0.03::double * (c.x1 - c.x0) as j, l.x0 - c.x0 as a, c.x1 - l.x1 as b, c.x1 - c.x0 as w
  from l join c on l.k = c.k and c.x0 - 2 <= l.x0 and l.x1 <= c.x1 + 2),
h as (select k, avg(j::int) as j, avg((not j and abs(a - b) <= 0.02::double * w and a > 0.05::double * w)::int) as m from i group by k)
select k, case when j is null then 'indeterminado' when j >= 0.6::double then 'justificado' when m >= 0.4::double then 'centralizado' else 'esquerda' end as text_alignment
from (select distinct k from l) left join h using (k)""")
def line_alignment(spark, d):
    return layout.text_alignment(lines(spark, d), columns(spark, d), ["k"])


def _mode(source: str, keys: str, value: str, place: str) -> str:
    """SQL: the most frequent value of each key, of ties the first."""
    counted = f"select {keys}, {value}, count(*) as c, min({place}) as p from {source} group by {keys}, {value}"
    return f"select {keys}, {value} from ({counted}) qualify row_number() over (partition by {keys} order by c desc, p) = 1"


@query(f"""
with {_COLUMNS}, i as (select l.k, c.x0 as col, l.x0 as x, l.o from l join c on l.k = c.k and c.x0 - 2 <= l.x0 and l.x0 <= c.x1),
b as ({_mode("i", "k, col", "x", "o")}),
m as (select i.k, i.col, i.x - b.x as indent, i.o from i join b on i.k = b.k and i.col = b.col where i.x - b.x > 2 and i.x - b.x < 40),
e as ({_mode("m", "k, col", "indent", "o")}), f as ({_mode("e", "k", "indent", "col")})
select k, coalesce(indent, 0) as indent from (select distinct k from l) left join f using (k)""")
def first_indents(spark, d):
    return layout.first_line_indent(lines(spark, d), columns(spark, d), ["k"])


_EDGES = f"""{_LINES}, r as (select k, x0, count(*) as c, min(o) as p from l group by k, x0),
t as (select * from r qualify row_number() over (partition by k order by c desc, p) <= 2)"""


@query(f"""
with {_EDGES} select k, min(x0) as marker_x, case when max(x0) - min(x0) > 2 and max(x0) - min(x0) < 40 then max(x0) - min(x0) else 0 end as indent
from t group by k""")
def hanging_indents(spark, d):
    return layout.hanging_indent(lines(spark, d), ["k"])


@query(rf"""
with {_EDGES}, m as (select k, min(x0) as x from t group by k),
s as (select l.k, trim(text) as text from l join m on l.k = m.k and abs(l.x0 - m.x) <= 1)
select k, case when avg(regexp_matches(text, '^\[\d+\]')::int) >= 0.5 then 'colchetes' when avg(regexp_matches(text, '^\d+\.')::int) >= 0.5 then 'numerica'
  when avg(regexp_matches(text, '^\(\d+\)')::int) >= 0.5 then 'parenteses' else 'sem numeracao' end as numbering_style from s group by k""")
def numbering_styles(spark, d):
    return layout.numbering_style(lines(spark, d), ["k"])


@query(f"""
with {_LINES}, g as (select k, page, y0 - lag(y0) over (partition by k, page order by y0) as gap, o from l),
n as (select * from g where gap > 0 and gap < 120), m as ({_mode("n", "k, page", "gap", "o")})
select k, page, gap as spacing, printf('%.2f', gap / 40) as ratio, round(gap * 25.4::double / 72, 6) as leading from m""")
def page_spacing(spark, d):
    """The usual distance of lines a page, as a ratio to a size of 40 points and in millimetres."""
    found = layout.line_spacing(lines(spark, d).withColumn("size", F.lit(40.0)), ["k", "page"])
    ratio = layout.spacing_ratio(F.col("spacing"), F.lit(40.0))
    return found.select("k", "page", "spacing", text.ratio_shown(ratio).alias("ratio"), F.round(layout.leading_mm(ratio, F.lit(40.0)), 6).alias("leading"))


_MM = "round(coalesce({} * 25.4::double / 72, 0), 6) as {}"


@query(f"""
with {_LINES}, b as (select k, page, min(x0) filter (trim(text) <> '') as a, min(y0) filter (trim(text) <> '') as b,
  max(x1) filter (trim(text) <> '') as c, max(y1) filter (trim(text) <> '') as d from l group by k, page)
select k, page, {_MM.format("a", "margin_left")}, {_MM.format("(600 - c)", "margin_right")}, {_MM.format("b", "margin_top")},
  {_MM.format("(1100 - d)", "margin_bottom")} from b""")
def page_margins(spark, d):
    found = layout.margins(lines(spark, d).withColumn("page_h", F.lit(1100.0)), ["k", "page"])
    return found.select("k", "page", *[F.round(f"margin_{side}", 6).alias(f"margin_{side}") for side in ("left", "right", "top", "bottom")])


_SIZED = f"{_LINES}, z as (select *, case when o % 5 < 2 then 10.0 else 12.0 end as size, length(trim(text)) as w from l)"


@query(f"""
with {_SIZED}, b as (select k, size from (select k, size, sum(w) as n, min(o) as p from z where w > 0 group by 1, 2)
  qualify row_number() over (partition by k order by n desc, p) = 1)
select k, o as ord from z join b using (k, size) where w > 0""")
def body_text(spark, d):
    """Spans of the size of most characters, whatever lies behind its tenth."""
    spans = lines(spark, d).withColumn("size", F.when(F.col("ord") % 5 < 2, 9.96).otherwise(12.04))
    return layout.body_spans(spans, ["k"]).select("k", "ord")


_BOUNDS = f"""{_LINES},
s as (select k, page, y1 from l where text = 'Referências' qualify row_number() over (partition by k order by page, y0) = 1),
e as (select l.k, l.page, l.y0 from l join s using (k) where text = '2. Apêndices' and (l.page > s.page or l.page = s.page and l.y0 > s.y1)
  qualify row_number() over (partition by l.k order by l.page, l.y0) = 1),
b as (select s.k, s.page as start_page, s.y1 as start_y, coalesce(e.page, m.page) as end_page, e.y0 as end_y
  from s join (select k, max(page) as page from l group by k) m on s.k = m.k left join e on s.k = e.k)"""


@query(f"with {_BOUNDS} select * from b")
def reference_limits(spark, d):
    return layout.reference_bounds(lines(spark, d), "k")


@query(rf"""
with {_BOUNDS} select k, o as ord from l join b using (k) where page between start_page and end_page and not (page = start_page and y0 <= start_y)
  and not coalesce(page = end_page and y0 >= end_y, false) and not regexp_matches(trim(text), '^\d+$')""")
def reference_lines(spark, d):
    rows = lines(spark, d)
    return layout.lines_within(rows, layout.reference_bounds(rows, "k"), "k").select("k", "ord")


@query("""
with f as (select c_custkey as k, c_custkey % 3 <> 0 as a, c_custkey % 4 <> 0 as b, (c_custkey % 7) * 0.5 as s from customer)
select k, 'secao_localizada' as criterion, case when a then 'sim' else 'não' end as expected, case when b then 'sim' else 'não' end as found, a = b as passed from f where not (a and b)
union all select k, 'familia_fonte', 'Times-Roman', case when k % 5 = 0 then 'Arial' else 'TimesNewRomanPS' end, k % 5 <> 0 from f where a and b
union all select k, 'tamanho_fonte', '10.0 pt', printf('%.1f pt', 10 + s::double), s <= 0.7 from f where a and b
union all select k, 'alinhamento', 'justificado', case when k % 2 = 0 then 'justificado' else 'esquerda' end, k % 2 = 0 from f where a and b
union all select k, 'estilo_numeracao', 'numerica', case when k % 11 = 0 then 'colchetes' else 'numerica' end, k % 11 <> 0 from f where a and b""")
def reference_typography(spark, d):
    """The references of a template and of each article, of which either may lack them."""
    k = F.col("k")
    files = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    template = files.where(k % 3 != 0).select(
        "k", F.lit("Times-Roman").alias("font_family"), F.lit(10.0).alias("font_size"), F.lit("justificado").alias("text_alignment"),
        F.lit("numerica").alias("numbering_style"),
    )
    article = files.where(k % 4 != 0).select(
        "k", F.when(k % 5 == 0, "Arial").otherwise("TimesNewRomanPS").alias("font_family"), (10 + (k % 7) * 0.5).alias("font_size"),
        F.when(k % 2 == 0, "justificado").otherwise("esquerda").alias("text_alignment"), F.when(k % 11 == 0, "colchetes").otherwise("numerica").alias("numbering_style"),
    )
    return layout.reference_checks(files, template, article, ["k"])


@query("select conv_id, right(string_agg(text, chr(10) || chr(10) order by turn), 300) as text from conversations group by conv_id")
def whole_texts(spark, d):
    return text.whole_text(t(spark, d, "conversations"), "conv_id", "turn", cap=300)


_FOUND = """
select conv_id, turn // 2 as win, turn as ord, case when (conv_id + turn // 3) % 2 = 0 then case when turn % 2 = 0 then 'Intro' else 'INTRO' end else 'Method' end as section,
  role || turn as start_text, case when turn % 5 = 0 then 'end ' || turn end as end_text from conversations"""


@query(f"""
with f as ({_FOUND}), n as (select *, case when lower(lag(section) over w) = lower(section) and lag(end_text) over w is null then 0 else 1 end as new
  from f window w as (partition by conv_id order by win, ord)),
g as (select *, sum(new) over (partition by conv_id order by win, ord rows unbounded preceding) as g from n)
select conv_id, g as ord, first(section order by win, g.ord) as section, first(start_text order by win, g.ord) as start_text,
  list(end_text order by win, g.ord)[-1] as end_text from g group by conv_id, g""")
def merged_sections(spark, d):
    """Sections found window by window, those that go on merged."""
    turn = F.col("turn")
    name = F.when((F.col("conv_id") + F.floor(turn / 3)) % 2 == 0, F.when(turn % 2 == 0, "Intro").otherwise("INTRO")).otherwise("Method")
    found = t(spark, d, "conversations").select(
        "conv_id", F.floor(turn / 2).alias("win"), turn.alias("ord"), name.alias("section"), F.concat("role", turn.cast("string")).alias("start_text"),
        F.when(turn % 5 == 0, F.concat(F.lit("end "), turn.cast("string"))).alias("end_text"),
    )
    return text.merge_sections(found, "conv_id")


@query(r"""
with d as (select doc_id, trim(regexp_replace(replace(text, chr(0), ''), '\s+', ' ', 'g')) as text from documents),
f as (select *, strip_accents(lower(text)) as flat, string_split(strip_accents(lower(text)), ' ') as w from d where len(string_split(text, ' ')) > 40),
a as (select *, array_to_string(w[11:22], ' ') as a, array_to_string(w[31:40], ' ') as b from f),
p as (select *, strpos(flat, a) - 1 as i, strpos(flat, a) - 1 + length(a) as past from a),
q as (select *, strpos(substr(flat, past + 1), b) as j from p)
select doc_id, 0 as ord, 'first' as section, i as start, case when j = 0 then substr(text, i + 1) else substr(text, i + 1, past + j - 1 - i) end as text from q""")
def anchored_section(spark, d):
    """Texts cut from where their eleventh to twenty-second words stand first to where their thirty-first to fortieth stand
    next; case, accents and white space of the anchors don't count."""
    docs = t(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text")).withColumn("w", F.split("text", " ")).where(F.size("w") > 40)
    words = lambda first, n: F.translate(F.array_join(F.slice("w", first, n), "  "), ascii_lowercase, ascii_uppercase)
    marks = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("first").alias("section"), words(11, 12).alias("start_text"), words(31, 10).alias("end_text"))
    return text.section_split(docs.select("doc_id", "text"), marks)


@query("""
with b as (select o_custkey as root, o_orderkey as id, o_orderpriority as title from orders where o_orderkey % 5 <> 0),
m as (select distinct o_custkey as root, o_orderpriority as title from orders where o_custkey % 3 <> 0),
r as (select c_custkey as root, c_name as name from customer),
j as (select root, title, row_number() over (partition by root order by title) - 1 as j from m)
select name as root, -1 as j, -1 as k, name as line from r
union all select name, j, -1, '  ' || title from r join j using (root)
union all select name, j, row_number() over (partition by root, title order by id) - 1, '    ' || id from r join j using (root) join b using (root, title)""")
def tree_report(spark, d):
    """Customers, their priorities and orders as lines of a report, levels without children included."""
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    key = F.concat_ws("|", F.col("root").cast("string"), "priority").alias("mid")
    branches = orders.where("id % 5 <> 0").select(key, "id", F.col("id").cast("string").alias("title"))
    mids = orders.where("root % 3 <> 0").select("root", key, F.col("priority").alias("title")).distinct()
    mids = tree.nest(mids, branches, "mid", "mid", "id", "branches")
    roots = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tree.report_lines(tree.nest(roots, mids, "id", "root", "title", "taxonomies"))


@query("""
with r as (select l_orderkey as id, l_linenumber as n, l_quantity as a, l_tax as b, l_suppkey as s from lineitem)
select id, count(*) filter (s % 3 <> 0) as rects, round(sum(case when s % 3 <> 0 then a + b end), 4) as edges from r group by id""")
def cited_rects(spark, d):
    """Rectangles of four numbers; those of three are no rectangles."""
    a, b = F.col("l_quantity"), F.col("l_tax")
    box = F.when(F.col("l_suppkey") % 3 != 0, F.array(a, b, a + 1, b + 1)).otherwise(F.array(a, b, a))
    kept = vectors.rect_structs(F.col("boxes"))
    rows = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(box).alias("boxes"))
    edges = F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + r["x1"] + r["y1"])
    return rows.select("id", F.size(kept).cast("long").alias("rects"), F.when(F.size(kept) > 0, F.round(edges, 4)).alias("edges"))
