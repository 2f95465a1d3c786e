"""Page-layout metrics and compliance checks over spans, lines and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MM = 25.4 / 72  # a point in millimetres

# Tolerances and page sizes, in millimetres or points as named; labels; headings; page numbers.
TOLERANCES = [
    ("page_width", 5.0), ("page_height", 5.0), ("margin_left", 17.0), ("margin_right", 17.0), ("margin_top", 20.0),
    ("margin_bottom", 20.0), ("gutter", 4.0), ("font_size", 0.7), ("leading", 35.0),
]
PAGES = [("A4", 210.0, 297.0), ("Letter", 215.9, 279.4)]
UNKNOWN_PAGE = "Desconhecido"
PAGE_TOLERANCE = 6.0
SPACINGS = [("simples", 1.0), ("1.15", 1.15), ("1.5", 1.5), ("duplo", 2.0)]
UNDETERMINED = "indeterminado"
JUSTIFIED, CENTRED, LEFT = "justificado", "centralizado", "esquerda"
NO_COLOUR = "#000000"
PAGE_NUMBERS = [r"^\d+$", r"(?iu)^(p\.?|página|page)\s*\d+$", r"(?i)^\d+\s*(/|of|de)\s*\d+$", r"(?i)^[ivxlcdm]+$"]
PAGE_NUMBER_LENGTH = 20
NO_NUMBER = ("nenhuma", "nenhum")  # position and format of a page without one
FAMILY_NOISE = ["-", "_", "mt", "ps", "regular", "roman"]
HEADING = r"(?i)^(\d+\.?\s*)?(referencias(\s+bibliograficas)?|bibliografia|references|bibliography|works cited|literature cited)\.?$"
END_HEADING = r"(?i)^(\d+\.?\s*)?(apendice(s)?|anexo(s)?|appendix(es)?|supplementary material)\.?$"
HEADING_LENGTH = 60
NUMBERINGS = [("colchetes", r"^\[\d+\]"), ("numerica", r"^\d+\."), ("parenteses", r"^\(\d+\)")]
NO_NUMBERING = "sem numeracao"
BOLD, ITALIC = 4, 1  # bits of a span's flags


def first_mode(df: DataFrame, keys: Sequence[str], value: str, position: str, alias: str = "mode") -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first by position; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", F.negative("p").alias("p"))).alias(alias))


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: str, alias: str = "mode", position: str | None = None) -> DataFrame:
    """The value with the largest sum of weights; ties to the one seen first by ``position``, else to the smaller value."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("n"), F.min(position or value).alias("p"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", F.negative("p").alias("v"))).alias(alias))


def medians(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """(keys, new names): exact medians of columns, the mean of the middle two of an even number; nulls don't count."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(name) for name, c in columns.items()])


def body_size(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, body_size): the font size, to a tenth, of most characters."""
    sized = spans.withColumn("__s", F.bround("size", 1)).withColumn("__w", F.char_length(F.trim("text"))).where("__w > 0")
    return weighted_mode(sized, keys, "__s", "__w", "body_size", "ord" if "ord" in spans.columns else None)


def body_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = spans.join(body_size(spans, keys), list(keys))
    return out.where((F.bround("size", 1) == F.col("body_size")) & (F.trim("text") != ""))


def modal_arrays(df: DataFrame, keys: Sequence[str], column: str, order: str) -> DataFrame:
    """Element-wise medians over the arrays of the most frequent length (of ties, that seen first by ``order``); empty
    arrays don't count, and where all are empty so is the result."""
    sized = df.withColumn("__n", F.size(column)).where("__n > 0")
    modal = first_mode(sized, keys, "__n", order, "__n")
    cells = sized.join(modal, [*keys, "__n"]).select(*keys, F.posexplode(column).alias("i", "x"))
    med = cells.groupBy(*keys, "i").agg(F.median("x").alias("m"))
    items = F.array_sort(F.collect_list(F.struct("i", "m")))
    found = med.groupBy(*keys).agg(F.transform(items, lambda x: x["m"]).alias(column))
    none = F.array().cast("array<double>")
    return df.select(*keys).distinct().join(found, list(keys), "left").withColumn(column, F.coalesce(column, none))


def modal_struct(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The most frequent combination of ``columns`` of each key; ties go to the one seen first."""
    both = df.withColumn("__k", F.struct(*columns))
    out = first_mode(both, keys, "__k", order, "__k")
    return out.select(*keys, *[F.col(f"__k.{c}").alias(c) for c in columns])


def share_over_half(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")) > 0.5, F.lit(False))


def is_bold(spans_font: Column, flags: Column) -> Column:
    return flag(flags, BOLD) | F.lower(spans_font).contains("bold")


def is_italic(spans_font: Column, flags: Column) -> Column:
    return flag(flags, ITALIC) | F.lower(spans_font).contains("italic")


def alignment(justified: Column, centred: Column) -> Column:
    """By the shares of justified and centred lines; null where none was counted."""
    shares = F.when(justified >= 0.6, JUSTIFIED).when(centred >= 0.4, CENTRED).otherwise(LEFT)
    return F.when(justified.isNull(), UNDETERMINED).otherwise(shares)


def text_alignment(lines: DataFrame, columns: DataFrame, keys: Sequence[str], alias: str = "text_alignment") -> DataFrame:
    """(keys, alignment): a line that lies in a text column (with 2 points to spare) counts; it is justified if it ends
    within 3 % of the column's width of its right edge, else centred if its gaps are alike within 2 % and over 5 %."""
    c = columns.select(*keys, F.col("x0").alias("__l"), F.col("x1").alias("__r")).where("__r > __l")
    inside = lines.join(c, list(keys)).where((F.col("__l") - 2 <= F.col("x0")) & (F.col("x1") <= F.col("__r") + 2))
    span, left, right = F.col("__r") - F.col("__l"), F.col("x0") - F.col("__l"), F.col("__r") - F.col("x1")
    just = right <= 0.03 * span
    mid = ~just & (F.abs(left - right) <= 0.02 * span) & (left > 0.05 * span)
    shares = inside.groupBy(*keys).agg(F.avg(just.cast("double")).alias("j"), F.avg(mid.cast("double")).alias("c"))
    return lines.select(*keys).distinct().join(shares, list(keys), "left").select(*keys, alignment(F.col("j"), F.col("c")).alias(alias))


def margins(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text box and margins in millimetres of each page; a page without text has margins of zero."""
    text = F.trim("text") != ""
    box = spans.groupBy(*keys).agg(
        F.min(F.when(text, F.col("x0"))).alias("x0"), F.min(F.when(text, F.col("y0"))).alias("y0"),
        F.max(F.when(text, F.col("x1"))).alias("x1"), F.max(F.when(text, F.col("y1"))).alias("y1"),
        F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"),
    )
    mm = lambda c, n: F.coalesce(c * MM, F.lit(0.0)).alias(n)
    return box.select(
        *keys, "page_w", "page_h", mm(F.col("x0"), "margin_left"), mm(F.col("page_w") - F.col("x1"), "margin_right"),
        mm(F.col("y0"), "margin_top"), mm(F.col("page_h") - F.col("y1"), "margin_bottom"),
    )


def page_format(width_mm: Column, height_mm: Column) -> Column:
    out = F.lit(UNKNOWN_PAGE)
    for name, w, h in reversed(PAGES):
        out = F.when((F.abs(width_mm - w) <= PAGE_TOLERANCE) & (F.abs(height_mm - h) <= PAGE_TOLERANCE), name).otherwise(out)
    return out


def columns_of_page(lines: DataFrame, keys: Sequence[str], width: str = "page_w") -> DataFrame:
    """Text columns: line intervals merged at gaps of at most 10 points; those under 15 % of the page's width go."""
    from paperloom.operators.latest import islands

    found = islands(lines.select(*keys, width, "x0", "x1"), [*keys, width], "x0", "x1", 10.0)
    return found.where((F.col("x1") - F.col("x0")) >= 0.15 * F.col(width))


def line_spacing(lines: DataFrame, keys: Sequence[str], size: str = "size", alias: str = "spacing") -> DataFrame:
    """The most frequent distance between neighbouring line tops, to a tenth, of those over 0 and under three sizes."""
    w = Window.partitionBy(*keys).orderBy("y0")
    gap = F.col("y0") - F.lag("y0").over(w)
    gaps = lines.withColumn("__d", gap).withColumn("__p", F.row_number().over(w))
    near = gaps.where((F.col("__d") > 0) & (F.col("__d") < 3 * F.col(size))).withColumn("__g", F.bround("__d", 1))
    return first_mode(near, keys, "__g", "__p", alias)


def spacing_ratio(spacing: Column, size: Column) -> Column:
    """Null where either is missing or zero."""
    return F.nullif(spacing, F.lit(0.0)) / F.nullif(size, F.lit(0.0))


def spacing_label(ratio: Column) -> Column:
    """The nearest usual spacing; ties to the first."""
    near = [F.struct(F.abs(ratio - s).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("label")) for i, (n, s) in enumerate(SPACINGS)]
    return F.when(ratio.isNull(), UNDETERMINED).otherwise(F.array_min(F.array(*near))["label"])


def leading_mm(ratio: Column, size: Column) -> Column:
    return ratio * F.nullif(size, F.lit(0.0)) * MM


def gutter(columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean gap between neighbouring text columns in millimetres; 0 under two columns."""
    nxt = F.lead("x0").over(Window.partitionBy(*keys).orderBy("x0", "x1"))
    gaps = columns.withColumn("__g", nxt - F.col("x1")).groupBy(*keys).agg(F.avg("__g").alias("__g"))
    return gaps.select(*keys, F.coalesce(F.col("__g") * MM, F.lit(0.0)).alias("gutter"))


def first_line_indent(lines: DataFrame, columns: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """(keys, indent): per text column the usual distance, over 2 and under 40 points, of line starts to the right of the
    most frequent start; of the columns' distances the usual one; 0 where there is none. In points."""
    c = columns.select(*keys, F.col("x0").alias("__l"), F.col("x1").alias("__r"))
    inside = lines.join(c, list(keys)).where((F.col("__l") - 2 <= F.col("x0")) & (F.col("x0") <= F.col("__r")))
    inside = inside.withColumn("__x", F.bround("x0", 0))
    base = first_mode(inside, [*keys, "__l"], "__x", order, "__b")
    moved = inside.join(base, [*keys, "__l"]).withColumn("__d", F.col("__x") - F.col("__b"))
    each = first_mode(moved.where("__d > 2 and __d < 40"), [*keys, "__l"], "__d", order, "__i")
    found = first_mode(each, keys, "__i", "__l", "indent")
    return lines.select(*keys).distinct().join(found, list(keys), "left").withColumn("indent", F.coalesce("indent", F.lit(0.0)))


def clean_font(font: Column) -> Column:
    """A font's name without its subset prefix: what stands after the first plus sign."""
    return F.when(font.contains("+"), F.substring(font, F.locate("+", font) + 1, F.char_length(font))).otherwise(font)


def font_family(font: Column) -> Column:
    """A family name for comparison: lower case, without noise, letters only."""
    out = F.lower(font)
    for noise in FAMILY_NOISE:
        out = F.replace(out, F.lit(noise), F.lit(""))
    return F.regexp_replace(out, r"\P{L}", "")


def same_family(a: Column, b: Column) -> Column:
    """Whether one family name holds the other; an empty one matches nothing."""
    x, y = font_family(a), font_family(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def hex_colour(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(value.bitwiseAND(0xFFFFFF)), 6, "0"))


def flag(value: Column, bit: int) -> Column:
    return F.shiftright(value, bit).bitwiseAND(1) == 1


def body_lines(spans: DataFrame, keys: Sequence[str], line: Sequence[str] = ("block", "line"), order: str = "span") -> DataFrame:
    """(keys, line, x0, y0, x1, y1): lines whose most frequent size over spans with text (ties: first seen) is the body's."""
    at = [*keys, *line]
    sized = spans.where(F.trim("text") != "").withColumn("__s", F.bround("size", 1))
    modal = first_mode(sized, at, "__s", order, "__m")
    own = modal.join(body_size(spans, keys), list(keys)).where("__m = body_size").select(*at)
    boxes = spans.groupBy(*at).agg(*[f(c).alias(c[-2:]) for f, c in ((F.min, "line_x0"), (F.min, "line_y0"), (F.max, "line_x1"), (F.max, "line_y1"))])
    return boxes.join(own, at)


def _mode(xs: Column) -> Column:
    """The most frequent element of an array, of ties the first; null of an empty one."""
    each = F.array_distinct(xs)
    n = F.transform(each, lambda x: F.size(F.filter(xs, lambda y: y.eqNullSafe(x))))
    return F.get(each, F.array_position(n, F.array_max(n)).cast("int") - 1)


def _median(xs: Column) -> Column:
    """The median of an array's elements that are not null."""
    own = F.array_sort(F.array_compact(xs))
    n = F.size(own)
    return F.when(n > 0, (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2.0)


def _over_half(xs: Column, holds) -> Column:
    return F.size(F.filter(xs, holds)) * 2 > F.size(xs)


def main_font(spans: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """(keys, font_family, font_size, font_bold, font_italic, font_color) of each page's body: modes (ties: first seen by
    ``order``), shares over half; defaults where a page has no text. A page's spans meet in one row."""
    item = F.struct(
        order, F.bround("size", 1).alias("s"), F.char_length(F.trim("text")).alias("w"), clean_font(F.col("font")).alias("f"),
        F.coalesce("color", F.lit(0)).alias("c"), is_bold(F.col("font"), F.col("flags")).alias("b"), is_italic(F.col("font"), F.col("flags")).alias("i"),
    )
    out = spans.groupBy(*keys).agg(F.filter(F.array_sort(F.collect_list(item)), lambda x: x["w"] > 0).alias("__x"))
    out = out.withColumn("__sizes", F.array_distinct(F.transform("__x", lambda x: x["s"])))
    weight = lambda z: F.aggregate(F.filter("__x", lambda x: x["s"] == z), F.lit(0), lambda n, x: n + x["w"])
    out = out.withColumn("__n", F.transform("__sizes", weight))
    out = out.withColumn("__size", F.get("__sizes", F.array_position("__n", F.array_max("__n")).cast("int") - 1))
    out = out.withColumn("__x", F.filter("__x", lambda x: x["s"] == F.col("__size")))
    field = lambda n: F.transform("__x", lambda x: x[n])
    return out.select(
        *keys, F.coalesce(_mode(field("f")), F.lit(UNDETERMINED)).alias("font_family"), F.coalesce("__size", F.lit(0.0)).alias("font_size"),
        _over_half(F.col("__x"), lambda x: x["b"]).alias("font_bold"), _over_half(F.col("__x"), lambda x: x["i"]).alias("font_italic"),
        F.coalesce(hex_colour(_mode(field("c"))), F.lit(NO_COLOUR)).alias("font_color"),
    )


def is_page_number(text: Column) -> Column:
    found = F.lit(False)
    for p in PAGE_NUMBERS:
        found = found | F.trim(text).rlike(p)
    return F.char_length(F.trim(text)).between(1, PAGE_NUMBER_LENGTH) & found


def page_numbering(lines: DataFrame, keys: Sequence[str], order: Sequence[str] = ("y0", "x0")) -> DataFrame:
    """(keys, exists, position, format) of every page: of its first page-number line, by ``order``, in the footer (from 85 %
    of the height on) or header (up to 15 %)."""
    y = F.when(F.col("y0") > 0.85 * F.col("page_h"), "rodapé").when(F.col("y1") < 0.15 * F.col("page_h"), "cabeçalho")
    mid = (F.col("x0") + F.col("x1")) / 2
    x = F.when(mid < F.col("page_w") / 3, "esquerda").when(mid > 2 * F.col("page_w") / 3, "direita").otherwise("centro")
    hits = lines.withColumn("__y", y).where(is_page_number(F.col("text")) & F.col("__y").isNotNull())
    form = F.when(F.col("text").rlike(r"\d"), "arábico").otherwise("romano")
    found = F.struct(F.concat_ws("-", "__y", x).alias("position"), form.alias("format"))
    first = hits.groupBy(*keys).agg(F.min_by(found, F.struct(*order)).alias("__f"))
    out = lines.select(*keys).distinct().join(first, list(keys), "left")
    return out.select(
        *keys, F.col("__f").isNotNull().alias("exists"), F.coalesce("__f.position", F.lit(NO_NUMBER[0])).alias("position"),
        F.coalesce("__f.format", F.lit(NO_NUMBER[1])).alias("format"),
    )


def _merged_columns(lines: Column, width: Column) -> Column:
    """Text columns of a page's lines (structs with x0 and x1): intervals merged at gaps of 10 points, the wide ones."""
    own = F.array_sort(F.transform(lines, lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"))))

    def take(held: Column, x: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        wider = F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], x["x1"]).alias("x1"))
        joins = (F.size(held) > 0) & (x["x0"] <= last["x1"] + 10.0)
        return F.when(joins, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(held, F.array(x)))

    merged = F.aggregate(own, F.array().cast("array<struct<x0:double,x1:double>>"), take)
    return F.filter(merged, lambda c: (c["x1"] - c["x0"]) >= 0.15 * width)


def _indent(lines: Column, columns: Column) -> Column:
    """What first_line_indent() finds, of arrays."""

    def of_column(c: Column) -> Column:
        own = F.filter(lines, lambda x: (x["x0"] >= c["x0"] - 2) & (x["x0"] <= c["x1"]))
        xs = F.transform(own, lambda x: F.bround(x["x0"], 0))
        return _mode(F.filter(F.transform(xs, lambda x: x - _mode(xs)), lambda d: (d > 2) & (d < 40)))

    return F.coalesce(_mode(F.array_compact(F.transform(columns, of_column))), F.lit(0.0))


def _alignment(lines: Column, columns: Column) -> Column:
    """What text_alignment() finds, of arrays."""

    def of_column(c: Column) -> Column:
        span = c["x1"] - c["x0"]
        own = F.filter(lines, lambda x: (span > 0) & (c["x0"] - 2 <= x["x0"]) & (x["x1"] <= c["x1"] + 2))

        def kind(x: Column) -> Column:
            left, right = x["x0"] - c["x0"], c["x1"] - x["x1"]
            centred = (F.abs(left - right) <= 0.02 * span) & (left > 0.05 * span)
            return F.when(right <= 0.03 * span, 1).when(centred, 2).otherwise(0)

        return F.transform(own, kind)

    kinds = F.flatten(F.transform(columns, of_column))
    share = lambda k: F.try_divide(F.size(F.filter(kinds, lambda x: x == k)), F.size(kinds))
    return alignment(share(1), share(2))


def page_metrics(spans: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics of each page (the last of ``keys`` numbers it): ``spans`` with their lines' boxes and an ``ord`` in
    reading order, ``lines`` with their text. Millimetres but for sizes in points. A page's body lines meet in one row, and
    what is measured of them is measured there."""
    font = main_font(spans, keys)
    line = spans.groupBy(*keys, "block", "line").agg(
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("span", F.bround("size", 1).alias("s"), F.trim("text").alias("t")))), lambda x: x["t"] != ""), lambda x: x["s"]).alias("__z"),
        F.min("line_x0").alias("x0"), F.min("line_y0").alias("y0"), F.max("line_x1").alias("x1"), F.max("line_y1").alias("y1"),
    )
    items = F.array_sort(F.collect_list(F.struct("block", "line", "x0", "y0", "x1", _mode(F.col("__z")).alias("s"))))
    page = margins(spans, keys).join(font, list(keys)).join(line.groupBy(*keys).agg(items.alias("__all")), list(keys))
    page = page.withColumn("__l", F.filter("__all", lambda x: x["s"] == F.col("font_size")))
    page = page.withColumn("__c", _merged_columns(F.col("__l"), F.col("page_w")))
    tops = F.array_sort(F.transform("__l", lambda x: x["y0"]))
    page = page.withColumn("__y", tops)
    gaps = F.transform(F.slice("__y", F.lit(2), F.greatest(F.size("__y"), F.lit(1))), lambda y, i: y - F.get("__y", i))
    near = F.filter(gaps, lambda g: (g > 0) & (g < 3 * F.col("font_size")))
    page = page.withColumn("spacing_ratio", spacing_ratio(_mode(F.transform(near, lambda g: F.bround(g, 1))), F.col("font_size")))
    between = F.transform(F.slice("__c", F.lit(2), F.greatest(F.size("__c"), F.lit(1))), lambda c, i: c["x0"] - F.get("__c", i)["x1"])
    mean = F.try_divide(F.aggregate(between, F.lit(0.0), lambda n, x: n + x), F.size(between))
    out = page.select(
        *keys, page_format(F.col("page_w") * MM, F.col("page_h") * MM).alias("page_format"), (F.col("page_w") * MM).alias("page_width"),
        (F.col("page_h") * MM).alias("page_height"), "margin_left", "margin_right", "margin_top", "margin_bottom",
        F.size("__c").alias("column_count"), F.transform("__c", lambda c: (c["x1"] - c["x0"]) * MM).alias("column_widths"),
        F.when(F.size("__c") > 1, mean * MM).otherwise(0.0).alias("gutter"), "font_family", "font_size", "font_bold", "font_italic", "font_color",
        "spacing_ratio", spacing_label(F.col("spacing_ratio")).alias("spacing_mode"), leading_mm(F.col("spacing_ratio"), F.col("font_size")).alias("leading"),
        (_indent(F.col("__l"), F.col("__c")) * MM).alias("first_line_indent"), _alignment(F.col("__l"), F.col("__c")).alias("text_alignment"),
    )
    return out.join(page_numbering(lines, keys), list(keys), "left")


MODES = ("page_format", "font_family", "font_bold", "font_italic", "font_color", "spacing_mode", "text_alignment")
MEDIANS = ("page_width", "page_height", "margin_left", "margin_right", "margin_top", "margin_bottom", "font_size", "spacing_ratio", "first_line_indent")


def aggregated_pages(pages: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """One profile of many pages of each key: modes (ties: the first page), medians, and the columns and gutter of those
    pages that have the usual number of columns. The pages of a document meet in one row."""
    rest = [c for c in pages.columns if c not in (*keys, page)]
    out = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(page, *rest))).alias("__p"))
    of = lambda xs, c: F.transform(xs, lambda x: x[c])
    out = out.withColumn("column_count", _mode(of(F.col("__p"), "column_count")))
    out = out.withColumn("__same", F.filter("__p", lambda x: x["column_count"] == F.col("column_count")))
    widths = F.filter(of(F.col("__same"), "column_widths"), lambda w: F.size(w) > 0)
    out = out.withColumn("__w", widths)
    out = out.withColumn("__n", F.coalesce(_mode(F.transform("__w", lambda w: F.size(w))), F.lit(0)))
    places = F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array().cast("array<int>"))
    usual = F.filter("__w", lambda w: F.size(w) == F.col("__n"))
    number = _mode(F.transform("__p", lambda x: F.struct(*[x[c].alias(c) for c in ("exists", "position", "format")])))
    out = out.withColumn("__number", number)
    return out.select(
        *keys, "column_count", F.transform(places, lambda i: _median(F.transform(usual, lambda w: F.get(w, i)))).alias("column_widths"),
        _median(of(F.col("__same"), "gutter")).alias("gutter"), *[_mode(of(F.col("__p"), c)).alias(c) for c in MODES],
        *[_median(of(F.col("__p"), c)).alias(c) for c in MEDIANS],
        *[F.col("__number")[c].alias(c) for c in ("exists", "position", "format")],
    ).withColumn("leading", leading_mm(F.col("spacing_ratio"), F.col("font_size")))


def heading_text(text: Column) -> Column:
    from paperloom.functions.text import accents_stripped

    return F.trim(accents_stripped(F.trim(text)))


def reference_bounds(lines: DataFrame, key: str, toc: DataFrame | None = None, order: Sequence[str] = ("page", "y0")) -> DataFrame:
    """(key, start_page, start_y, end_page, end_y): from below the first heading of references, by ``order``, to the first
    end heading after it, else through the last page (``end_y`` is null). Headings are read without accents.

    ``toc`` (key, title, page), if there is one, names the page to search from; without a heading there or after, the whole
    document is searched."""
    named = lines.withColumn("__t", heading_text(F.col("text"))).where(F.char_length("__t").between(1, HEADING_LENGTH))
    place = F.struct(F.struct(*order).alias("o"), "page", "y0", "y1")
    heads = named.where(F.col("__t").rlike(HEADING))
    start = heads.groupBy(key).agg(F.min(place).alias("s"))
    if toc is not None:
        told = toc.where(heading_text(F.col("title")).rlike(HEADING)).groupBy(key).agg(F.min("page").alias("__p"))
        later = heads.join(told, key).where(F.col("page") >= F.col("__p")).groupBy(key).agg(F.min(place).alias("l"))
        start = start.join(later, key, "left").select(key, F.coalesce("l", "s").alias("s"))
    last = lines.groupBy(key).agg(F.max("page").alias("l"))
    ends = named.where(F.col("__t").rlike(END_HEADING)).join(start, key)
    after = (F.col("page") > F.col("s.page")) | ((F.col("page") == F.col("s.page")) & (F.col("y0") > F.col("s.y1")))
    ends = ends.where(after).groupBy(key).agg(F.min(place).alias("e"))
    out = start.join(last, key).join(ends, key, "left")
    return out.select(
        key, F.col("s.page").alias("start_page"), F.col("s.y1").alias("start_y"), F.coalesce("e.page", "l").alias("end_page"),
        F.col("e.y0").alias("end_y"),
    )


def first_page_bounds(bounds: DataFrame) -> DataFrame:
    """Bounds that end with the page they start on: a template counts by its first reference page only."""
    return bounds.withColumns({"end_page": F.col("start_page"), "end_y": F.lit(None).cast(bounds.schema["end_y"].dataType)})


def both_bounds(template: DataFrame, article: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Bounds of the references in both files' lines, those of the template on its first page only."""
    return first_page_bounds(reference_bounds(template, key)), reference_bounds(article, key)


def lines_within(lines: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Lines below the start and above the end; bare numbers go."""
    out = lines.join(bounds, key).where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    above = (F.col("page") == F.col("start_page")) & (F.col("y0") <= F.col("start_y"))
    below = (F.col("page") == F.col("end_page")) & F.col("end_y").isNotNull() & (F.col("y0") >= F.col("end_y"))
    return out.where(~above & ~F.coalesce(below, F.lit(False)) & ~F.trim("text").rlike(r"^\d+$")).select(*lines.columns)


def reference_metrics(lines: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, font_family, font_size, font_bold, spacing_mode, text_alignment, hanging_indent, numbering_style) of the
    reference lines (with ``ord``) and their spans, over one column that spans all lines."""
    column = lines.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    font = main_font(spans, keys).select(*keys, "font_family", "font_size", "font_bold")
    spaced = line_spacing(lines.join(font.select(*keys, F.col("font_size").alias("size")), list(keys)), keys)
    out = lines.select(*keys).distinct().join(font, list(keys), "left").join(spaced, list(keys), "left")
    out = out.join(text_alignment(lines, column, keys), list(keys), "left").join(hanging_indent(lines, keys), list(keys), "left")
    out = out.join(numbering_style(lines, keys), list(keys), "left")
    return out.select(
        *keys, F.coalesce("font_family", F.lit(UNDETERMINED)).alias("font_family"), F.coalesce("font_size", F.lit(0.0)).alias("font_size"),
        F.coalesce("font_bold", F.lit(False)).alias("font_bold"), spacing_label(spacing_ratio(F.col("spacing"), F.col("font_size"))).alias("spacing_mode"),
        "text_alignment", F.coalesce(F.col("indent") * MM, F.lit(0.0)).alias("hanging_indent"), "numbering_style",
    )


def _left_edges(lines: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The two most frequent left edges of each key (ties: first seen)."""
    edges = lines.groupBy(*keys, F.bround("x0", 0).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "p")
    return edges.withColumn("rn", F.row_number().over(w)).where("rn <= 2")


def hanging_indent(lines: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """(keys, marker_x, indent): the distance of the two most frequent left edges, if over 2 and under 40 points, else 0."""
    two = _left_edges(lines, keys, order).groupBy(*keys).agg(F.min("x").alias("marker_x"), (F.max("x") - F.min("x")).alias("d"))
    return two.select(*keys, "marker_x", F.when((F.col("d") > 2) & (F.col("d") < 40), F.col("d")).otherwise(0.0).alias("indent"))


def numbering_style(lines: DataFrame, keys: Sequence[str], patterns: Sequence[tuple[str, str]] = tuple(NUMBERINGS), order: str = "ord") -> DataFrame:
    """(keys, numbering_style): the first pattern, in order, that at least half of the lines at the leftmost of the two
    most frequent edges match (within a point)."""
    marker = _left_edges(lines, keys, order).groupBy(*keys).agg(F.min("x").alias("__x"))
    own = lines.join(marker, list(keys)).where(F.abs(F.bround("x0", 0) - F.col("__x")) <= 1)
    shares = [F.avg(F.trim("text").rlike(p).cast("double")).alias(f"__{i}") for i, (_, p) in enumerate(patterns)]
    out = own.groupBy(*keys).agg(*shares)
    style = F.coalesce(*[F.when(F.col(f"__{i}") >= 0.5, F.lit(n)) for i, (n, _) in enumerate(patterns)], F.lit(NO_NUMBERING))
    return out.select(*keys, style.alias("numbering_style"))


def tolerance_checks(template: DataFrame, article: DataFrame, keys: Sequence[str], tolerances=tuple(TOLERANCES)) -> DataFrame:
    """(keys, criterion, expected, found, passed): metrics compared within their tolerance; a null on one side fails, on
    both passes. Only metrics that both tables have are compared."""
    use = [(c, t) for c, t in tolerances if c in template.columns and c in article.columns]
    a = template.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c, _ in use])
    b = article.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c, _ in use])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"a_{c}").alias("expected"), F.col(f"b_{c}").alias("found"), F.lit(t).alias("t")) for c, t in use]))
    out = a.join(b, list(keys)).select(*keys, rows.alias("r")).select(*keys, "r.*")
    near = F.abs(F.col("expected") - F.col("found")) <= F.col("t")
    both = F.col("expected").isNull() & F.col("found").isNull()
    return out.select(*keys, "criterion", "expected", "found", (both | F.coalesce(near, F.lit(False))).alias("passed"))


# The names of the checks of a references section.
LOCATED, FAMILY, SIZE, ALIGNMENT, NUMBERING = "secao_localizada", "familia_fonte", "tamanho_fonte", "alinhamento", "estilo_numeracao"


def reference_checks(files: DataFrame, template: DataFrame, article: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, criterion, expected, found, passed): how the references of each of ``files`` (keys) are set in template and
    article, both as reference_metrics() gives them.

    Where a side has no references there is one check, whether both have or lack them; else families of one name, sizes
    within tolerance, equal alignment and numbering; a missing value passes nothing. Values are shown as reports show them.
    A join for each side, four rows a file at most. Keys of template and article are unique."""
    from paperloom.functions.text import measure_shown, truth_shown

    own = ("font_family", "font_size", "text_alignment", "numbering_style")
    side = lambda df, n: df.select(*keys, F.struct(*own).alias(n))
    both = files.select(*keys).join(side(template, "a"), list(keys), "left").join(side(article, "b"), list(keys), "left")
    a, b = F.col("a"), F.col("b")

    def check(name: str, expected: Column, found: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("criterion"), expected.alias("expected"), found.alias("found"), F.coalesce(passed, F.lit(False)).alias("passed"))

    near = F.abs(a["font_size"] - b["font_size"]) <= dict(TOLERANCES)["font_size"]
    typography = F.array(
        check(FAMILY, a["font_family"], b["font_family"], same_family(a["font_family"], b["font_family"])),
        check(SIZE, measure_shown(a["font_size"], "pt"), measure_shown(b["font_size"], "pt"), near),
        check(ALIGNMENT, a["text_alignment"], b["text_alignment"], a["text_alignment"] == b["text_alignment"]),
        check(NUMBERING, a["numbering_style"], b["numbering_style"], a["numbering_style"] == b["numbering_style"]),
    )
    there = check(LOCATED, truth_shown(a.isNotNull()), truth_shown(b.isNotNull()), a.isNotNull() == b.isNotNull())
    rows = F.when(a.isNull() | b.isNull(), F.array(there)).otherwise(typography)
    return both.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def visual_verdict(skipped: Column, rendered: Column, failed: Column, verdict: Column) -> Column:
    """Skipped passes; a page that can't be rendered and a model's error fail; else the verdict."""
    return F.when(skipped, True).when(~rendered, False).when(failed, False).otherwise(F.coalesce(verdict, F.lit(False)))


def with_visual(checks: DataFrame, visuals: DataFrame, keys: Sequence[str], section: str = "section", name: str = "visual") -> DataFrame:
    """Checks (keys, section, passed) and, as one more of section ``name``, the visual verdict of each of ``visuals`` (keys,
    skipped, rendered, failed, verdict): sections() and summary() then count it like any other."""
    own = visual_verdict(*[F.coalesce(F.col(c), F.lit(c == "rendered")) for c in ("skipped", "rendered", "failed")], F.col("verdict"))
    return checks.select(*keys, section, "passed").unionByName(visuals.select(*keys, F.lit(name).alias(section), own.alias("passed")))


def sections(checks: DataFrame, all_sections: DataFrame, keys: Sequence[str], section: str = "section") -> DataFrame:
    """Each section's verdict: all its checks pass; a section without checks does not."""
    own = checks.groupBy(*keys, section).agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("n"))
    out = all_sections.select(*keys, section).distinct().join(own, [*keys, section], "left")
    return out.withColumns({"passed": F.coalesce("passed", F.lit(False)), "n": F.coalesce("n", F.lit(0))})


def summary(rows: DataFrame, keys: Sequence[str], need_rows: bool = False) -> DataFrame:
    """(keys, total, passed, compliant) of verdicts."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
    good = F.col("total") == F.col("passed")
    return out.withColumn("compliant", good & (F.col("total") > 0) if need_rows else good)


def page_range(first: Column, last: Column, excluded: Column) -> Column:
    """Pages of a range without the excluded ones; if none is left, page min(2, last)."""
    pages = F.array_except(F.sequence(first, last), excluded)
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(F.least(F.lit(2), last)))


# The criteria of a page and the metrics that each compares; the first page leaves its margins out.
PAGE_CRITERIA = {
    "page_size": ("page_width", "page_height"), "columns": ("gutter",), "margins": ("margin_top", "margin_bottom", "margin_left", "margin_right"),
    "main_font": ("font_size",), "line_spacing": ("leading",),
}
EQUAL = {"page_size": ("page_format",), "columns": ("column_count",), "main_font": ("font_bold", "font_color")}
FIRST_PAGE = ("page_size", "columns", "main_font", "line_spacing")


def page_criteria(template: DataFrame, article: DataFrame, keys: Sequence[str], criteria: Sequence[str] = tuple(PAGE_CRITERIA)) -> DataFrame:
    """(keys, criterion, passed) of two profiles of each key: metrics within tolerance (a missing one fails), labels equal,
    families of one name."""
    limit = dict(TOLERANCES)
    a = template.select(*keys, F.struct(*[c for c in template.columns if c not in keys]).alias("a"))
    b = article.select(*keys, F.struct(*[c for c in article.columns if c not in keys]).alias("b"))
    tests = []
    for name in criteria:
        own = [F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= limit[c], F.lit(False)) for c in PAGE_CRITERIA[name]]
        own += [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in EQUAL.get(name, ())]
        own += [same_family(F.col("a.font_family"), F.col("b.font_family"))] if name == "main_font" else []
        tests.append(F.struct(F.lit(name).alias("criterion"), F.forall(F.array(*own), lambda x: x).alias("passed")))
    return a.join(b, list(keys)).select(*keys, F.explode(F.array(*tests)).alias("t")).select(*keys, "t.*")


def body_profile(pages: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """The profile of an article's body: all its pages but the first and those of its references; if none is left, page 2
    or the last."""
    b = bounds.select(key, "start_page", "end_page")
    last = pages.groupBy(key).agg(F.max("page").alias("__last"))
    marked = pages.join(b, key, "left").join(last, key)
    out = (F.col("page") == 1) | F.coalesce(F.col("page").between(F.col("start_page"), F.col("end_page")), F.lit(False))
    marked = marked.withColumn("__in", ~out)
    some = marked.groupBy(key).agg(F.bool_or("__in").alias("__some"))
    kept = marked.join(some, key).where(F.when(F.col("__some"), F.col("__in")).otherwise(F.col("page") == F.least(F.lit(2), F.col("__last"))))
    return aggregated_pages(kept.select(*pages.columns), [key])
