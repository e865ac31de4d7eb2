"""Texts and pairs as columns: binding, replacing and restoring without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_first(pairs: Column) -> Column:
    """Pairs by falling length of the original; those of one length keep their order."""
    ranked = F.transform(pairs, lambda p, i: F.struct((-F.length(p["original"])).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(ranked), lambda r: r["p"])


def replace_pairs(text: Column, pairs: Column) -> Column:
    """Each original replaced by its surrogate, one pair after the other, longest original first."""
    return F.aggregate(longest_first(pairs), text, lambda t, p: F.replace(t, p["original"], p["surrogate"]))


def restore_pairs(text: Column, pairs: Column) -> Column:
    """Each surrogate replaced by its original, in the order of the pairs."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["surrogate"], p["original"]))
