"""Spans in texts: the columns that the secret and personal-data scans share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, released, strings

#: (kind, start, end, from the base rules, score); code points, end exclusive
Span = tuple[str, int, int, bool, float]
SPAN_SQL = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]
    )
)


def scan(docs: DataFrame, find: Callable[[str], list[Span]], kinds: list[str], name: str) -> DataFrame:
    """Add the array ``name`` of the spans that ``find`` gives for each whole text (null: empty text), by start, then kind."""
    order = {k: i for i, k in enumerate(kinds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in strings(b.column(b.schema.get_field_index("text")), 64):
                got = sorted(find(t), key=lambda s: (s[1], order[s[0]], s[2])) if t else []
                out.append([dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in got])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _ARROW)], names=[*b.schema.names, name])
        released()

    return arrow_map(docs, run, f"`{name}` {SPAN_SQL}", drop=(name,))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, kinds: list[str], name: str = "spans") -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, all spans as text, how many there are in all."""
    base = F.filter(F.col(name), lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(name)).alias("spans"),
        F.size(name).cast("long").alias("n_spans"),
    )
