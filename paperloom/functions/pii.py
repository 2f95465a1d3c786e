"""Pseudonyms for personal data: patterns, spans, stable placeholders and the way back."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.stored import stored

# The institutions that are hidden by name.
INSTITUTIONS = [
    "FIOCRUZ",
    "Fundação Oswaldo Cruz",
    "Instituto  Nacional  de  Saúde  da  Mulher,  da  Criança  e  do Adolescente Fernandes Figueira",
    "Ministério da Saúde/ANVISA",
    "Fiocruz",
    "fiocruz",
]


def institutions(names: list[str]) -> tuple[str, str]:
    """A pattern for a list of names, each taken literally, between characters that are no letters, digits or _."""
    return "INSTITUTION", r"(?:^|(?<=\W))(?:" + "|".join(map(re.escape, names)) + r")(?:(?=\W)|$)"


# Entity kinds in order of registration, with their patterns. They are read in any case, with Unicode classes.
PATTERNS = [
    ("PHONE_NUMBER_BR", r"\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}-?\d{4}\b"),
    ("CPF", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"),
    ("CNPJ", r"\b\d{2}\.?\d{3}\.?\d{3}/\d{4}-\d{2}\b"),
    ("RG", r"\b\d{2}\.?\d{3}\.?\d{3}-?\d{1,2}\b"),
    institutions(INSTITUTIONS),
    ("MONEY", r"R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}"),
    ("PROCESS_NUMBER", r"\b\d+\.\d+/\d{4}-\d{2}\b"),
    ("EDITAL_NUMBER", r"\b\d{2,5}/\d{4}\b"),
    ("EMAIL_ADDRESS", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("DATE", r"\b(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/\d{4}\b"),
    ("TIME", r"\b([01]\d|2[0-3]):[0-5]\d\b"),
    ("ZIP_CODE", r"\b\d{5}-?\d{3}\b"),
]
#: a character without which a kind has no match: most texts are done without trying its pattern
NEEDS = {"CNPJ": "/", "MONEY": "$", "PROCESS_NUMBER": "/", "EDITAL_NUMBER": "/", "EMAIL_ADDRESS": "@", "DATE": "/", "TIME": ":"}
#: two digits side by side, without which these patterns have no match
TWO_DIGITS = re.compile(r"\d\d")
WITH_DIGITS = [(k, p) for k, p in PATTERNS if k in ("PHONE_NUMBER_BR", "CPF", "RG", "ZIP_CODE")]


def counts(text: Column, patterns=tuple(PATTERNS)) -> list[Column]:
    """One column of each kind: how often its pattern matches (null for a null text)."""

    def count(kind: str, pattern: str) -> Column:
        n = F.regexp_count(text, F.lit(f"(?iU){pattern}")).cast("long")
        return F.when(~text.contains(NEEDS[kind]), 0).otherwise(n) if kind in NEEDS else n

    return [count(k, p).alias(k.lower()) for k, p in patterns]


def _kept(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, kind's number) by start that cover all characters of ``spans``.

    The longest span is kept first, then that of the kind registered first; one that overlaps a kept span is lost, and only
    kept spans make others lose. Then what is still uncovered of a lost span is kept too, as a part of its kind."""
    kept: list[tuple[int, int, int]] = []
    lost = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[2], s[0])):
        i = bisect_left(kept, s)
        over = i and kept[i - 1][1] > s[0] or i < len(kept) and kept[i][0] < s[1]
        lost.append(s) if over else kept.insert(i, s)
    for a, b, k in lost:
        i = max(bisect_left(kept, (a, a, k)) - 1, 0)
        parts = []
        while a < b:
            while i < len(kept) and kept[i][1] <= a:
                i += 1
            if i < len(kept) and kept[i][0] <= a:
                a = kept[i][1]
            else:
                end = min(b, kept[i][0]) if i < len(kept) else b
                parts.append((a, end, k))
                a = end
        for part in parts:
            insort(kept, part)
    return kept


def entities(df: DataFrame, key: str, order: str = "chunk_index", text: str = "text", patterns=tuple(PATTERNS)) -> DataFrame:
    """(key, order, kind, entity, start): matches of all patterns, each where it stands (from 1); of overlapping ones the
    longest stays, then the kind registered first; of another what sticks out stays as an entity of its kind, so every
    matched character is part of one. One pass over the texts where they are; work in a row follows its length and number
    of matches, since matches of one kind don't overlap."""
    found = df.select(key, order, F.col(text).alias("__text"))
    compiled = [(re.compile(p, re.DOTALL | re.MULTILINE | re.IGNORECASE), NEEDS.get(k, ""), (k, p) in WITH_DIGITS) for k, p in patterns]
    two_digits = TWO_DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i in range(b.num_rows):
                t = b.column(2)[i].as_py() or ""
                two = two_digits.search(t) is not None
                able = [(k, p) for k, (p, need, digits) in enumerate(compiled) if need in t and (two or not digits)]
                own = [(m.start(), m.end(), k) for k, p in able for m in p.finditer(t)]
                own = [(c + 1, k, t[c:d]) for c, d, k in _kept(own)] if own else own
                at += [i] * len(own)
                out += own
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array([patterns[s[1]][0] for s in out], pa.string()),
                 pa.array([s[2] for s in out], pa.string()), pa.array([s[0] for s in out], pa.int32())],
                names=[key, order, "kind", "entity", "start"],
            )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:2])
    return found.mapInArrow(run, f"{own}, kind string, entity string, start int")


#: what stands for an entity, from its kind, its number in the document (from 0, by first occurrence) and itself
Naming = Callable[[Column, Column, Column], Column]


def counted(kind: Column, n: Column, entity: Column) -> Column:
    """``<KIND_n>``: one for each entity of a document, so restore() finds the way back."""
    return F.format_string("<%s_%d>", kind, n)


def redacted(kind: Column, n: Column, entity: Column) -> Column:
    """``<KIND>``: all entities of a kind alike; there is no way back."""
    return F.format_string("<%s>", kind)


def numbers(found: DataFrame, key: str, order: str = "chunk_index", held: DataFrame | None = None) -> DataFrame:
    """(key, kind, entity, n, new): numbers from 0 that count a document's entities of a kind by first occurrence.

    ``held`` (key, kind, entity, n) are numbers of earlier runs: they stay, and new entities go on from the largest, so runs
    over parts of a document in their order number as one run over all of it does."""
    first = found.groupBy(key, "kind", "entity").agg(F.min(F.struct(order, "start")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(key, "kind").orderBy("f", "entity")) - 1
    if held is None:
        return first.select(key, "kind", "entity", rank.cast("long").alias("n"), F.lit(True).alias("new"))
    known = held.select(key, "kind", "entity", F.col("n").cast("long").alias("n"))
    least = known.groupBy(key, "kind").agg((F.max("n") + 1).alias("__from"))
    fresh = first.join(known, [key, "kind", "entity"], "left_anti").withColumn("__r", rank).join(least, [key, "kind"], "left")
    n = (F.col("__r") + F.coalesce("__from", F.lit(0))).cast("long").alias("n")
    old = first.select(key, "kind", "entity").join(known, [key, "kind", "entity"])
    return old.withColumn("new", F.lit(False)).unionByName(fresh.select(key, "kind", "entity", n, F.lit(True).alias("new")))


def placeholders(found: DataFrame, key: str, order: str = "chunk_index", naming: Naming = counted, held: DataFrame | None = None) -> DataFrame:
    """(key, kind, entity, placeholder), named by ``naming``; numbers and ``held`` as in numbers()."""
    named = naming(F.col("kind"), F.col("n"), F.col("entity")).alias("placeholder")
    return numbers(found, key, order, held).select(key, "kind", "entity", named)


def anonymise(
    df: DataFrame, key: str, order: str = "chunk_index", text: str = "text", patterns=tuple(PATTERNS), naming: Naming = counted,
    held: DataFrame | None = None,
) -> DataFrame:
    """The chunks (one row for each key and order) with placeholders where an entity was matched, and ``pii_map``: kind ->
    entity -> placeholder of the document, those of ``held`` (numbers()) included. Only spans travel, looked for once and
    kept as a table; a text meets those of its own chunk."""
    found = stored(entities(df, key, order, text, patterns), "entities")
    names = placeholders(found, key, order, naming, held)
    placed = found.join(names, [key, "kind", "entity"])
    if held is not None:
        known = held.select(key, "kind", "entity", naming(F.col("kind"), F.col("n"), F.col("entity")).alias("placeholder"))
        known = known.join(df.select(key), key, "left_semi")
        names = names.unionByName(known).distinct()
    item = F.struct("start", F.char_length("entity").alias("n"), "placeholder")
    own = placed.groupBy(key, order).agg(F.array_sort(F.collect_list(item)).alias("__m"))
    kinds = names.groupBy(key, "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "placeholder")))).alias("m"))
    maps = kinds.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.map_entries("m").alias("m"))))).alias("__p"))
    maps = maps.select(key, F.transform_values("__p", lambda _, v: F.map_from_entries(v)).alias("pii_map"))
    out = df.join(own, [key, order], "left").join(maps, key, "left")
    whole = F.col(text)
    until = lambda i: F.when(i == F.size("__m"), F.char_length(whole) + 1).otherwise(F.get("__m", i)["start"])
    after = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get("__m", i - 1)["start"] + F.get("__m", i - 1)["n"])
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("__m")),
        lambda i: F.concat(F.substring(whole, after(i), until(i) - after(i)), F.coalesce(F.get("__m", i)["placeholder"], F.lit(""))),
    )
    return out.withColumn(text, F.when(F.col("__m").isNull(), whole).otherwise(F.array_join(pieces, ""))).drop("__m")


def restore(text: Column, pii_map: Column) -> Column:
    """The text with each placeholder's entity in its place."""
    pairs = F.flatten(F.transform(F.map_values(pii_map), lambda m: F.map_entries(m)))
    out = F.aggregate(pairs, text, lambda acc, e: F.replace(acc, e["value"], e["key"]))
    return F.when(pii_map.isNull(), text).otherwise(out)
