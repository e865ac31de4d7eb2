"""Restoring originals in a reply: exactly, by the words of a surrogate, and by likeness.

All passes run in one Arrow function: the later ones need expressions and windows that depend on the row, and a text that was
made by detection is read once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.batches import list_array, with_columns

SNIPPET = 120
FAILURE = "array<struct<surrogate:string,original:string,failure_type:string,context_snippet:string>>"


def likeness(query: str, window: str) -> float:
    """0 to 100: the best normalised indel similarity of `query` to a stretch of `window` of its length (or shorter, at the ends)."""
    if not query or not window:
        return 0.0
    if query in window:
        return 100.0
    short, long = (query, window) if len(query) <= len(window) else (window, query)
    n, best = len(short), 0.0
    letters = set(short)
    for a in range(1 - n, len(long)):
        lo, hi = max(0, a), min(len(long), a + n)
        # A best stretch starts or ends with a letter of the query.
        if hi <= lo or not (long[lo] in letters or long[hi - 1] in letters):
            continue
        part = long[lo:hi]
        if 200.0 * min(n, len(part)) / (n + len(part)) <= best:
            continue
        best = max(best, 200.0 * _common(short, part) / (n + len(part)))
    return best


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def best_span(text: str, query: str, least: float = 0.0) -> tuple[float, int, int]:
    """(likeness, start, end): windows of twice the query's length at steps of an eighth; the first best one. The span has the query's length from the window's start.

    Windows that can't reach `least` are left out: the letters that they share with the query, counted for all windows at once, bound
    the likeness.
    """
    if not text or not query:
        return 0.0, -1, -1
    low, q = text.lower(), query.lower()
    n = len(q)
    starts = np.arange(0, max(1, len(text) - len(query) + 1), max(1, len(query) // 8))
    ends = np.minimum(starts + 2 * len(query), len(low))
    letters = np.array([ord(c) for c in low], np.uint32)
    common = np.zeros(len(starts), np.int64)
    for c in set(q):
        upto = np.concatenate([[0], np.cumsum(letters == ord(c))])
        common += np.minimum(upto[ends] - upto[np.minimum(starts, ends)], q.count(c))
    bound = 200.0 * common / np.maximum(np.minimum(n, ends - starts) + common, 1)
    found = (0.0, -1, -1)
    for a, most in zip(starts[bound >= least].tolist(), bound[bound >= least].tolist()):
        if most > found[0] and (score := likeness(q, low[a : a + 2 * len(query)])) > found[0]:
            found = score, a, a + len(query)
            if score == 100:
                break
    return found


def resolve_text(reply: str | None, pairs: list[tuple[str, str]], threshold: float = 85.0) -> tuple[str | None, list[tuple[str, str, str, str]]]:
    """The restored reply, and (surrogate, original, failure, snippet) of each surrogate that wasn't there as it is.

    A surrogate that was found by its words or by likeness is a fuzzy_hit; one that wasn't leaves an exact_miss and a fuzzy_miss.
    """
    if reply is None or not pairs:
        return reply, []
    text, log, missing = reply, [], []
    for s, o in dict(pairs).items():
        if s in text:
            text = text.replace(s, o)
        else:
            missing.append(len(log))
            log.append([s, o, "exact_miss", reply[:SNIPPET]])
    left = []
    for i in missing:
        s, o = log[i][:2]
        hit = False
        if len(s.split()) > 1:
            for a, b in zip(s.split(), o.split()):
                text, n = re.subn(rf"\b{re.escape(a)}\b", lambda _, b=b: b, text)
                hit = hit or n > 0
        if hit:
            log[i][2] = "fuzzy_hit"
        else:
            left.append(i)
    for i in left[:]:
        s, o = log[i][:2]
        score, a, b = best_span(text, s, threshold)
        if score >= threshold and a >= 0:
            text, log[i][2] = text[:a] + o + text[b:], "fuzzy_hit"
            left.remove(i)
    log += [[log[i][0], log[i][1], "fuzzy_miss", text[:SNIPPET]] for i in left]
    return text, [tuple(x) for x in log]


def resolve(df: DataFrame, reply: str = "reply", pairs: str = "pairs", out: str = "resolved", failures: str | None = None, threshold: float = 85.0) -> DataFrame:
    """Adds the reply with its originals, and what failed if `failures` names a column for it; `pairs` is an array of (original, surrogate) in the order
    in which they are restored.

    A null reply stays null; without pairs the reply is as it was. A session's pairs travel with each of its replies.
    """
    kind = pa.struct([(x, pa.string()) for x in ("surrogate", "original", "failure_type", "context_snippet")])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        done = [resolve_text(r, [(p["surrogate"], p["original"]) for p in ps or ()], threshold) for r, ps in zip(batch.column(reply).to_pylist(), batch.column(pairs).to_pylist())]
        texts = pa.array([x[0] for x in done], pa.string())
        return [texts, list_array([x[1] for x in done], kind)] if failures else [texts]

    return with_columns(df, {out: "string"} | ({failures: FAILURE} if failures else {}), run)


def failure_summary(resolved: DataFrame) -> DataFrame:
    """(failure_type, n) of all three kinds, those that didn't occur included."""
    kinds = resolved.sparkSession.createDataFrame([("exact_miss",), ("fuzzy_hit",), ("fuzzy_miss",)], "failure_type string")
    counts = resolved.select(F.explode("failures.failure_type").alias("failure_type")).groupBy("failure_type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(counts, "failure_type", "left").select("failure_type", F.coalesce("n", F.lit(0)).alias("n"))
