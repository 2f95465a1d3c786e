"""Evaluation of branch payloads by a pluggable model, in Arrow batches with retries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS = 3
WORD = re.compile(r"\w+")
CHUNK = re.compile(r"\[FONTE\] chunk_id: (.*)\n((?:(?!\[FONTE\] chunk_id: )[\s\S])*)")
RESULT = "branch_id string, feedback string, fulfilled boolean, score int, cited array<string>, attempts int"


class Evaluator(Protocol):
    """Judges a batch of payloads; one result dict (feedback, fulfilled, score, cited) for each, in order."""

    def __call__(self, payloads: list[dict]) -> list[dict]: ...


def keyword_evaluator(payloads: list[dict]) -> list[dict]:
    """A deterministic stand-in for a model: the share of the requirement's words that the context holds, out of ten;
    fulfilled from six on; cited are the chunks (of a context as context() writes it) that hold one of the words."""
    out = []
    for p in payloads:
        need = set(WORD.findall((p.get("requirement") or "").lower()))
        chunks = [(m[1], set(WORD.findall(m[2].lower()))) for m in CHUNK.finditer(p.get("context") or "")]
        have = set(WORD.findall((p.get("context") or "").lower()))
        share = len(need & have) / len(need) if need else 0.0
        cited = [i for i, words in chunks if need & words]
        out.append({"feedback": f"{share:.0%} of terms found", "fulfilled": round(10 * share) >= 6, "score": round(10 * share), "cited": cited})
    return out


PART = 32  # payloads of one call


def _reply(evaluator: Callable[[list[dict]], list[dict]], part: list[dict]) -> list[dict]:
    """The evaluator's reply to ``part``: as long, and in its order where it tells ordinals."""
    got = evaluator(part)
    if not isinstance(got, list) or len(got) != len(part):
        raise ValueError(f"a reply of {len(got) if isinstance(got, list) else type(got).__name__} for {len(part)} payloads")
    for p, r in zip(part, got, strict=True):
        if r.get("ordinal", p["ordinal"]) != p["ordinal"]:
            raise ValueError(f"a reply to payload {r['ordinal']} where {p['ordinal']} was asked")
    return got


def judged(rows: list[dict], evaluator: Callable[[list[dict]], list[dict]], attempts: int = ATTEMPTS, size: int = PART) -> list[dict]:
    """A result for each of ``rows``, with the number of calls that it was part of.

    Payloads go out ``size`` at a time, numbered (``ordinal``). A part that raises, or gets no sound reply, is tried again,
    ``attempts`` times in all; then it is halved, so that good payloads are judged without the bad one beside them; a
    single payload that fails so often gets no verdict and says why."""
    out: list[dict | None] = [None] * len(rows)
    parts = [(list(range(i, min(i + size, len(rows)))), 0) for i in range(0, len(rows), size)]
    while parts:
        own, calls = parts.pop()
        part, why, got = [rows[i] | {"ordinal": i} for i in own], "", None
        for _ in range(attempts):
            calls += 1
            try:
                got = _reply(evaluator, part)
                break
            except Exception as e:  # noqa: BLE001  a model may raise anything
                why = str(e)
        if got is None and len(own) > 1:
            half = len(own) // 2
            parts += [(own[:half], calls), (own[half:], calls)]
            continue
        got = got or [{"feedback": f"not evaluated: {why}", "fulfilled": None, "score": None, "cited": []}]
        for i, r in zip(own, got, strict=True):
            out[i] = {k: r.get(k) for k in ("feedback", "fulfilled", "score", "cited")} | {"attempts": calls}
    return out


def evaluate(
    payloads: DataFrame, evaluator: Callable[[list[dict]], list[dict]] = keyword_evaluator, attempts: int = ATTEMPTS, size: int = PART
) -> DataFrame:
    """Results of the payloads (branch_id, requirement, context), judged ``size`` at a time where they are; judged() says
    what becomes of calls that fail. One Arrow batch is in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(judged(pdf.to_dict("records"), evaluator, attempts, size), columns=["feedback", "fulfilled", "score", "cited", "attempts"])
            out.insert(0, "branch_id", pdf["branch_id"].to_numpy())
            out["score"] = out["score"].astype("Int32")
            out["fulfilled"] = out["fulfilled"].astype("boolean")
            yield out

    return payloads.select("branch_id", "requirement", "context").mapInPandas(run, RESULT)
