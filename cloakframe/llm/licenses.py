"""Fuzzy search for short license notices.

A notice may be found with up to k edits. Cut into k + 1 pieces, at least one piece stands unchanged in
each such copy (the pigeonhole principle), so all occurrences of the pieces, located by one Aho-Corasick
automaton, lead to all copies. Around them the `regex` library's bounded-error matching verifies the
edits and gives the span.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import map_batches, table

#: license, short notice.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "under the terms of the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Edits (inserted, deleted or replaced characters) that are allowed for each so many characters.
CHARACTERS_PER_EDIT = 12


def edits_of(notice: str, per_edit: int = CHARACTERS_PER_EDIT) -> int:
    return len(notice) // per_edit


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): the notice in k + 1 pieces of lengths as equal as can be."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Letters whose lower case has another length or is an ASCII letter are left alone, so that
#: positions in the folded text are those of the text.
_KEEP = {0x130: "\u0130", 0x212A: "\u212a"}


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if len(low) == len(text) and "\u212a" not in text else "".join(_KEEP.get(ord(c)) or c.lower() for c in text)


def near(places: dict[str, int], size: int, window: str, k: int) -> bool:
    """Whether some stretch of `window` is within k edits of a text (bit-parallel edit distances).

    `places` has the bits of each character's places in the text. The regex library takes milliseconds to find that
    there is no match; this takes microseconds.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    for c in window:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
            if distance <= k:
                return True
        more, less = more << 1, less << 1
        up, down = full & (less | ~(same | down | more)), full & more & (same | down)
    return False


class Finder:
    """Seeds and verifying expressions of all notices; built once in each Python worker."""

    def __init__(self, notices: list[tuple[str, str]], per_edit: int = CHARACTERS_PER_EDIT):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (name, notice) in enumerate(notices):
            low, k = fold(notice), edits_of(notice, per_edit)
            exact = regex.escape(low, literal_spaces=True)
            places: dict[str, int] = {}
            for i, c in enumerate(low):
                places[c] = places.get(c, 0) | 1 << i
            self.notices.append((name, low, k, regex.compile(f"(?b)(?:{exact}){{e<={k}}}"), places))
            for at, piece in pieces(low, k):
                seeds.setdefault(piece, []).append((number, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, stop, edits) of the copies in one text, in order of notice and start.

        Each place that a seed points to has a window that a copy there fits into.
        """
        low = fold(text)
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.seeds.iter(low):
            for number, at in where:
                places.setdefault(number, set()).add(end - size + 1 - at)
        return [x for number, own in sorted(places.items()) for x in sorted(self._settle(number, own, low))]

    def _settle(self, number: int, places: set[int], low: str) -> list[tuple[int, int, int, int]]:
        """Copies that don't overlap: the fewest edits first, then the first in the text.

        The best match of each window waits in a heap. One that meets a copy taken before gives way to the best
        matches in what that copy leaves of its window; a window meets few copies, so time is linear in the windows.
        """
        _, notice, k, verify, bits = self.notices[number]
        size, heap, starts, stops, out = len(notice), [], [], [], []

        def look(a: int, b: int) -> None:
            if b - a >= size - k and near(bits, size, low[a:b], k) and (m := verify.search(low, a, b)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for at in places:
            a, b = max(0, at - k), min(len(low), at + size + k)
            if at >= 0 and low.startswith(notice, at):
                heapq.heappush(heap, (0, at, at + size, a, b))
            else:
                look(a, b)
        while heap:
            edits, start, stop, a, b = heapq.heappop(heap)
            i = bisect_right(stops, start)
            if i == len(starts) or starts[i] >= stop:
                starts.insert(i, start)
                stops.insert(i, stop)
                out.append((number, start, stop, edits))
                continue
            i = bisect_right(stops, a)
            while i < len(starts) and starts[i] < b:
                look(a, starts[i])
                a, i = stops[i], i + 1
            look(a, b)
        return out


_finders: dict[tuple, Finder] = {}


def finder(notices: list[tuple[str, str]], per_edit: int) -> Finder:
    key = (tuple(notices), per_edit)
    if key not in _finders:
        _finders[key] = Finder(notices, per_edit)
    return _finders[key]


def licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, per_edit: int = CHARACTERS_PER_EDIT) -> DataFrame:
    """(doc_id, license, notice, start, stop, edits): copies of the notices, case ignored.

    `notice` is its number in the list; start counts characters from 0, stop is exclusive. A notice of
    n characters may have n // per_edit edits. Copies of one notice don't overlap (fewest edits first, of
    equals the first in the text), those of several notices may. Null and empty texts have none; a null doc_id
    stays null; repeated rows give repeated results; an empty table gives an empty result. Very long texts
    take time in proportion to their seeds. Other columns than doc_id and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = finder(notices, per_edit)
        out = [(i, *x) for i, t in enumerate(batch.column("text").to_pylist()) if t for x in f.find(t)]
        ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([x[0] for x in out], pa.int64()))
        whole = lambda k: pa.array([x[k] for x in out], pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array([f.notices[x[1]][0] for x in out], pa.string()), whole(1), whole(2), whole(3), whole(4)], ["doc_id", "license", "notice", "start", "stop", "edits"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, license string, notice int, start int, stop int, edits int", "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`licenses` over the whole table `documents`, all NOTICES; no shuffle."""
    return licenses(table(spark, sf_dir, "documents"))
