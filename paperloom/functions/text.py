"""Cleaning, chunking, sections and small scalar functions."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 500, 50
WINDOW = 3000
SEPARATORS = ("\n\n", "\n", " ", "")
TEXT_CAP = 80_000
# Words of reports.
YES, NO, NO_RATIO = "sim", "não", "indeterminado"
SLICE = 256  # texts of which the chunks are held at once


def clean(text: Column) -> Column:
    """Without NUL, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"\s+", " "))


# Fixed value: the header of a chunk that belongs to a section.
HEADER = "SECTION: %s\n\n%s"


def with_header(text: Column, title: Column) -> Column:
    name = F.trim(F.coalesce(title, F.lit("")))
    return F.when(name != "", F.format_string(HEADER, name, text)).otherwise(text)


def fixed_windows(df: DataFrame, key: str, text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, ord, part): slices of ``size`` characters without overlap; an empty text has none."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = df.select(key, F.col(text).alias("__t"), F.explode(starts).alias("ord"))
    return parts.select(key, "ord", F.substring(F.col("__t"), F.col("ord") * size + 1, F.lit(size)).alias("part"))


def tail(text: Column, cap: int = TEXT_CAP) -> Column:
    """The last ``cap`` characters."""
    return F.right(text, F.lit(cap))


def whole_text(pages: DataFrame, key: str, order: str = "page", text: str = "text", cap: int = TEXT_CAP) -> DataFrame:
    """Pages joined by a blank line in order, of which the last ``cap`` characters stay."""
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return pages.groupBy(key).agg(tail(F.array_join(F.transform(items, lambda x: x[text]), "\n\n"), cap).alias("text"))


def coordinate_chunks(words: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, page, n, chunk_id, chunk_index, text, rects): lines of words gathered into chunks.

    Words of the same block and line that follow each other are a line (its box: minima and maxima). A line that would take
    the chunk over ``size`` (counting a blank after each line) begins a new one; a longer line stays whole. Pages are from 0,
    chunk ids count per page, ``chunk_index`` counts a document's non-empty chunks."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    here = F.struct("block_no", "line_no")
    turn = F.when(here != F.lag(here).over(w), 1).otherwise(0)
    marked = words.withColumn("__t", turn).withColumn("__l", F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct("ord", "text")))
    lines = marked.groupBy("doc_id", "page", "__l").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"),
        F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("rect"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("__l", "text", "rect")))
    pages = lines.groupBy("doc_id", "page").agg(ordered.alias("lines"))
    kind = "struct<n:int,size:int,of:array<int>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("of")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        length = F.char_length(line["text"])
        full = (acc["size"] > 0) & (acc["size"] + length + 1 > size)
        n = F.when(full, acc["n"] + 1).otherwise(acc["n"])
        used = F.when(full, length + 1).otherwise(acc["size"] + length + 1)
        return F.struct(n.alias("n"), used.alias("size"), F.concat(acc["of"], F.array(n)).alias("of")).cast(kind)

    dealt = pages.withColumn("of", F.aggregate("lines", start, step)["of"])
    flat = dealt.select("doc_id", "page", F.explode(F.arrays_zip("lines", "of")).alias("z"))
    flat = flat.select("doc_id", "page", F.col("z.of").alias("n"), F.col("z.lines").alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("line.__l", "line.text", "line.rect")))
    out = flat.groupBy("doc_id", "page", "n").agg(parts.alias("p"))
    out = out.select(
        "doc_id", "page", "n", F.concat_ws("_", F.lit("chunk"), F.col("page").cast("string"), F.col("n").cast("string")).alias("chunk_id"),
        clean(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"), F.transform("p", lambda x: x["rect"]).alias("rects"),
    ).where("text != ''")
    return out.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n")) - 1)


def split_recursive(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut before the coarsest separator that the text has, finer ones for what is not
    shorter than ``size``; neighbours share up to ``overlap`` characters of whole parts.

    A part keeps the separator that it begins with, and its length counts it; pieces are trimmed last. Parts of one level
    lie side by side, so a piece is a stretch of the text and only places are kept, in time that follows the length."""
    out: list[str] = []

    def parts(a: int, b: int, sep: str) -> Iterator[tuple[int, int]]:
        if not sep:
            yield from ((i, i + 1) for i in range(a, b))
            return
        at = text.find(sep, a, b)
        while at >= 0:
            if at > a:
                yield a, at
            a, at = at, text.find(sep, at + len(sep), b)
        yield a, b

    def cut(a: int, b: int, seps: tuple[str, ...]) -> None:
        own = next((i for i, s in enumerate(seps) if not s or text.find(s, a, b) >= 0), None)
        sep, finer = ("", ()) if own is None else (seps[own], seps[own + 1 :])
        held: deque[int] = deque()  # where the parts of the open piece begin
        end = a

        def close() -> None:
            if held and (piece := text[held[0] : end].strip()):
                out.append(piece)

        for p, q in parts(a, b, sep) if b > a else ():
            if q - p >= size and (finer or q - p > size):
                close()
                held.clear()
                cut(p, q, finer)
                continue
            if held and q - held[0] > size:
                close()
                while held and (p - held[0] > overlap or q - held[0] > size):
                    held.popleft()
            held.append(p)
            end = q
        close()

    cut(0, len(text), separators)
    return out


def recursive_chunks(df: DataFrame, key: str, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_id, page, text) of each whole text; null and blank texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                cut = [split_recursive(x.as_py() or "", size, overlap) for x in part.column(1)]
                at = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
                own = [re.sub(r"\s+", " ", x.replace("\x00", "")).strip() for c in cut for x in c]
                ordinals = pa.array([i for c in cut for i in range(len(c))], pa.int32())
                columns = [part.column(0).take(at), ordinals, pa.array(own, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk_index", "text"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_index int, text string")
    return out.select(key, "chunk_index", F.concat(F.lit("chunk_fallback_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit(0).alias("page"), "text")


class _Normal(dict):
    """Code points to their normal character, each worked out once: a blank for white space, NUL for what goes."""

    def __missing__(self, point: int) -> str:
        base = next((d for d in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(d)), "")
        self[point] = " " if base.isspace() else base.lower()[:1] if base and base.isprintable() else "\x00"
        return self[point]


_NORMAL = _Normal()


def normal_with_map(text: str) -> tuple[str, Sequence[int]]:
    """The text without accents, in lower case, white space collapsed, unprintable characters gone, and where each of its
    characters stands in the original."""
    same = text.translate(_NORMAL)
    flat = re.sub(" +", " ", same.replace("\x00", ""))
    if len(flat) == len(text):
        return flat, range(len(text))
    index: list[int] = []
    before = ""
    for i, c in enumerate(same):
        if c != "\x00" and not c == before == " ":
            index.append(i)
            before = c
    return flat, index


def _bases() -> tuple[str, str]:
    """Characters whose compatibility form is one character without its combining marks, and these."""
    pairs = []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _bases()
# Fixed value: letters that stand for loose accents in some extracted texts; they go, as combining marks do.
MODIFIERS = r"[\u02c6\u02c7\u02c8\u02ca-\u02cf\u02d8-\u02df\u02e0-\u02e7\u02ec-\u02ef]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def accents_stripped(text: Column) -> Column:
    """The text without accents: letters of Latin and Greek blocks give their base, combining and modifier marks go."""
    out = F.translate(F.regexp_replace(text, MODIFIERS, ""), ACCENTED, PLAIN)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{M}", "")


def split_sections(text: str, marks: list[dict]) -> list[dict]:
    """(section, start, text) of the marks (section, start_text, end_text) that are found, in order.

    Anchors are sought in normal form from the last match on, else from the beginning. A section runs to where its end
    anchor begins, else to the next section, else to the end. No anchor found: the whole text under no title."""
    flat, index = normal_with_map(text)
    cursor, found = 0, []
    for m in marks:
        want = normal_with_map(m.get("start_text") or "")[0].strip()
        at = -1
        if want:
            at = flat.find(want, cursor)
            at = flat.find(want) if at < 0 else at
        if at < 0:
            continue
        cursor = at
        end_want = normal_with_map(m.get("end_text") or "")[0].strip()
        end = flat.find(end_want, at + len(want)) if end_want else -1
        found.append((at, end, m["section"]))
    out = []
    for i, (at, end, name) in enumerate(found):
        if end < 0:
            end = min((x[0] for x in found[i + 1 :] if x[0] > at), default=len(flat))
        a, b = index[at], index[end] if end < len(index) else len(text)
        out.append({"section": name, "start": a, "text": text[a:b]})
    return out or [{"section": None, "start": 0, "text": text}]


def section_split(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, ord, section, start, text) of each document (doc_id, text) by its marks (doc_id, ord, section, start_text,
    end_text)."""
    items = F.array_sort(F.collect_list(F.struct("ord", "section", "start_text", "end_text")))
    both = docs.select("doc_id", "text").join(marks.groupBy("doc_id").agg(items.alias("marks")), "doc_id", "left")

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                texts, marked = part.column(1).to_pylist(), part.column(2).to_pylist()
                found = [split_sections(x or "", m or []) for x, m in zip(texts, marked, strict=True)]
                at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
                flat = [s for own in found for s in own]
                ordinals = pa.array([i for own in found for i in range(len(own))], pa.int32())
                named = [pa.array([s[c] for s in flat], t) for c, t in (("section", pa.string()), ("start", pa.int64()), ("text", pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), ordinals, *named], names=["doc_id", "ord", "section", "start", "text"])

    return both.mapInArrow(run, f"doc_id {kind}, ord int, section string, start long, text string")


def merge_sections(found: DataFrame, key: str) -> DataFrame:
    """Sections found window by window (key, win, ord, section, start_text, end_text) as one list: a section that is still
    open when the next one found has its name (in any case) is closed by that one's end instead of repeated."""
    w = Window.partitionBy(key).orderBy("win", "ord")
    same = (F.lower(F.lag("section").over(w)) == F.lower("section")) & F.lag("end_text").over(w).isNull()
    marked = found.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("win", "ord")
    out = marked.groupBy(key, "__g").agg(
        F.min_by("section", place).alias("section"), F.min_by("start_text", place).alias("start_text"),
        F.max_by("end_text", place).alias("end_text"),
    )
    return out.withColumnRenamed("__g", "ord")


# -- scalars -----------------------------------------------------------------------------------------------------------


def phone_normal(phone: Column) -> Column:
    """Digits with the country code 55 in front; empty: null."""
    d = F.regexp_replace(phone, r"\D", "")
    return F.when(d == "", F.lit(None)).when(d.startswith("55"), d).otherwise(F.concat(F.lit("55"), d))


def phone_valid(phone: Column) -> Column:
    """The phone without blanks and dashes if it is 55 and 10 or 11 digits, else null."""
    p = F.regexp_replace(phone, r"[\s-]", "")
    return F.when(p.rlike("^55[0-9]{10,11}$"), p)


def password_ok(password: Column) -> Column:
    return (F.char_length(password) >= 8) & password.rlike("[a-z]") & password.rlike("[A-Z]") & password.rlike("[0-9]")


def date_part(iso: Column) -> Column:
    return F.split(iso, "T")[0]


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(png|jpe?g|gif|webp)$")


def expired(at: Column, now: Column) -> Column:
    return now > at


def expires(now: Column, minutes: int = 15) -> Column:
    return now + F.make_dt_interval(mins=F.lit(minutes))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def unique_name(content: Column, name: Column) -> Column:
    """A name that repeats for the same content only."""
    return F.concat_ws("_", F.substring(F.sha2(content, 256), 1, 16), name)


def safe_id(text: Column) -> Column:
    """Letters, digits, - and _ only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def _decimals(value: Column, n: int) -> Column:
    """A number with n decimals; halves go to the even digit."""
    return F.format_string(f"%.{n}f", F.bround(value.cast("double"), n))


def number_shown(value: Column) -> Column:
    return _decimals(value, 1)


def truth_shown(value: Column) -> Column:
    """Yes and no as reports show them; null: null."""
    return F.when(value, YES).when(~value, NO)


def measure_shown(value: Column, unit: str) -> Column:
    """One decimal and the unit (mm, pt)."""
    return F.concat(_decimals(value, 1), F.lit(f" {unit}"))


def ratio_shown(value: Column) -> Column:
    """Two decimals; null: no ratio could be told."""
    return F.when(value.isNull(), NO_RATIO).otherwise(_decimals(value, 2))
