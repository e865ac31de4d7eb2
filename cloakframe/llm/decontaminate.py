"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All word n-grams of the test items are seeds, however many documents hold them: copies themselves make
the n-grams that survive an edit frequent. Training passages that share a seed with an item, and enough
of its words for a copy, are aligned with it, word by word; the score is that of the best local alignment over the
one that a verbatim copy would get, so edited, shortened and paraphrased copies score in between. The items go to
every task in blocks of bounded size, and a text is searched and aligned where it lies: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import keep_rows, map_batches, splitmix, table, words

#: Words of a seed, and least score of a copy.
NGRAM, THRESHOLD = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words on either side of a seed that are aligned, as a multiple of the item's words.
MARGIN = 1.5
#: Words of test items that are sent to every task at once (about 40 bytes each with their n-grams); more items
#: make more blocks, and the texts are read once for each.
BLOCK_WORDS = 4_000_000
#: Seeds that are sorted at once.
SEEDS = 1 << 20


def grams(h: np.ndarray, first: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and number of the first word of each n-gram; a row of fewer words is one gram."""
    count = np.diff(first)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), sizes)
    start = np.zeros(len(count), np.int64)
    np.cumsum(sizes[:-1], out=start[1:])
    word = np.arange(len(row)) - start[row] if len(row) else np.zeros(0, np.int64)
    at = first[:-1][row] + word
    value, end = np.zeros(len(row), np.uint64), first[1:][row]
    for j in range(n):
        inside = at + j < end
        value = value * np.uint64(0x100000001B3) + np.where(inside, h[np.minimum(at + j, max(len(h) - 1, 0))], np.uint64(7)) if len(h) else value
    return splitmix(value), row, word


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Score of the best local alignment of two arrays of words (linear gaps)."""
    best, h = 0, np.zeros(len(text) + 1, np.int64)
    gaps = np.arange(len(text) + 1) * -GAP
    for w in item:
        up = h + GAP
        up[1:] = np.maximum(up[1:], h[:-1] + np.where(text == w, MATCH, MISMATCH))
        up[0] = 0
        # Gaps in the item: a running maximum after the linear cost is taken out.
        h = np.maximum(np.maximum.accumulate(np.maximum(up, 0) + gaps) - gaps, 0)
        best = max(best, int(h.max()))
    return best


def shared(item: np.ndarray, text: np.ndarray) -> int:
    """Words of `item` that `text` holds, each as often as both have it: no alignment matches more."""
    words_, n = np.unique(item, return_counts=True)
    at = np.searchsorted(words_, text)
    at[at == len(words_)] = 0
    return int(np.minimum(n, np.bincount(at[words_[at] == text], minlength=len(words_))).sum()) if len(words_) else 0


def regions(starts: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """The stretches of words within `reach` of a seed, overlapping ones as one."""
    out: list[list[int]] = []
    for s in np.sort(starts).tolist():
        a, b = max(0, s - reach), min(n, s + NGRAM + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Items:
    """Test items with an index of their n-grams and words."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray):
        self.ids, self.h, self.first = ids, h, first
        g, row, _ = grams(h, first)
        self.gram, run = np.unique(g, return_inverse=True)
        # The items of each n-gram: its number and the item's as one ascending key.
        self.held = np.unique(run.astype(np.int64) << 32 | row)
        self.count = np.bincount(self.held >> 32, minlength=len(self.gram))
        self.vocabulary, self.word = np.unique(h, return_inverse=True)

    def seeds(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, first word) of the seeds, all those of a pair together and ascending.

        Texts go on until they have SEEDS seeds, a text with more goes on its own, by ranges of items: an n-gram
        that many items share takes time, not memory.
        """
        g, row, word = grams(h, first)
        run = np.searchsorted(self.gram, g)
        at = np.flatnonzero(self.gram[np.minimum(run, len(self.gram) - 1)] == g)
        run, row, word = run[at].astype(np.int64), row[at], word[at]
        total = np.cumsum(self.count[run])
        i = 0
        while i < len(row):
            before = total[i - 1] if i else 0
            j = int(np.searchsorted(total, before + SEEDS, "right"))
            if j < len(row):
                j = max(int(np.searchsorted(row, row[j])), int(np.searchsorted(row, row[i], "right")))
            parts = max(1, -(-int(total[j - 1] - before) // SEEDS))
            for p in range(parts):
                key = run[i:j] << 32
                low = np.searchsorted(self.held, key | len(self.ids) * p // parts)
                many = np.searchsorted(self.held, key | len(self.ids) * (p + 1) // parts) - low
                hit = np.repeat(np.arange(j - i), many)
                item = self.held[low[hit] + np.arange(len(hit)) - (np.cumsum(many) - many)[hit]] & 0xFFFFFFFF
                order = np.lexsort((item, row[i:j][hit]))
                yield row[i:j][hit][order], item[order], word[i:j][hit][order]
            i = j

    def scores(self, col: pa.Array, threshold: float) -> list[tuple[int, int, float]]:
        """(number of the text, item_id, score) of each pair with a score of `threshold` or more."""
        h, first = words(col)
        out, there = [], np.zeros(len(self.vocabulary), bool)
        for row, item, word in self.seeds(h, first) if len(self.gram) else ():
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]])) if len(row) else np.zeros(1, np.int64)
            pair_row, pair_item = row[cut[:-1]], item[cut[:-1]]
            for i, a, b in _runs(pair_row):
                own = h[first[i] : first[i + 1]]
                known = np.searchsorted(self.vocabulary, own)
                known[known == len(there)] = 0
                known = known[self.vocabulary[known] == own]
                there[known] = True
                for k in a + np.flatnonzero(self._possible(pair_item[a:b], there, threshold)):
                    it = self.h[self.first[pair_item[k]] : self.first[pair_item[k] + 1]]
                    parts = [own[x:y] for x, y in regions(word[cut[k] : cut[k + 1]], int(len(it) * MARGIN) + 1, len(own))]
                    best = max((align(it, part) for part in parts if shared(it, part) >= threshold * len(it)), default=0)
                    score = best / (MATCH * max(1, len(it)))
                    if score >= threshold:
                        out.append((int(i), int(self.ids[pair_item[k]]), score))
                there[known] = False
        return out

    def _possible(self, items: np.ndarray, there: np.ndarray, threshold: float) -> np.ndarray:
        """Whether a text has enough of each item's words; no alignment matches more."""
        sizes = self.first[items + 1] - self.first[items]
        ends = np.cumsum(sizes)
        at = np.repeat(self.first[items] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.add.reduceat(there[self.word[at]].astype(np.int64), ends - sizes) >= threshold * sizes


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield x[a], a, b


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items, each one once, in blocks of about BLOCK_WORDS words; a longer item is a block of its own."""
    named = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = words(batch.column("text"))
        own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("item_id"), own], ["item_id", "words"])

    ids, parts, total = [], [], 0
    for r in map_batches(named, ["item_id", "text"], run, "item_id long, words array<long>", "text").toLocalIterator():
        if total and total + len(r.words) > BLOCK_WORDS:
            yield _block(ids, parts)
            ids, parts, total = [], [], 0
        if r.words:
            ids.append(r.item_id)
            parts.append(np.array(r.words, np.int64).view(np.uint64))
            total += len(r.words)
    if ids:
        yield _block(ids, parts)


def _block(ids: list[int], parts: list[np.ndarray]) -> Items:
    return Items(np.array(ids, np.int64), np.concatenate(parts), np.cumsum([0, *map(len, parts)]))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score): documents that hold a copy of a test item, with the best score.

    The score is 1 for a verbatim copy (case and punctuation aside). Rows with a null id, and null or
    wordless texts, have no part on either side. Items of fewer than NGRAM words are one seed, found
    only where a text is no longer than they are. Rows that repeat a doc_id (or item_id) are one: the
    best score counts. Whole texts are searched, however long. Other columns than the ids and texts are not read.
    Without items or documents the result is empty.
    """
    named = docs.filter("doc_id is not null and text is not null")
    kind, found = "doc_id long, item_id long, score double", None
    for block in blocks(items):
        shared_block = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, held=shared_block) -> pa.RecordBatch:
            out = held.value.scores(batch.column("text"), threshold)
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([x[0] for x in out], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["doc_id", "item_id", "score"])

        own = map_batches(named, ["doc_id", "text"], run, kind, "text")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], kind)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that hold no copy of a test item, with all their columns; a null doc_id stays.

    Nulls, ties, repeated rows, long texts and empty tables are as in `contaminated`; columns of any names are kept.
    """
    return keep_rows(docs, contaminated(docs, items, threshold).select("doc_id"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`contaminated` over the whole tables `documents` and `benchmark`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
