"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed greedily into the longest
phrases that occur in a language's text; phrases times log2(length of the labelled text) over the
number of symbols estimates the cross entropy in bits a symbol. The language of the least wins.

The greedy parse is a finite transducer: an automaton's state and a symbol give the next state and
whether a phrase begins. It runs as one table over many texts and all languages in step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import CHUNK_BYTES, buffers, map_batches, table

#: Bounds of the labelled sample: bytes of text for a language (it ends with the row that reaches
#: them), rows looked at for a language, and the characters of one row, so that no single row fills it.
TRAIN_BYTES, TRAIN_ROWS, ROW_CHARACTERS = 24_000, 200, 4_000
#: A text of at least REJECT_SYMBOLS symbols whose best language needs more bits a symbol than equal
#: odds for 64 characters is no text of any of the languages. Prose of one language needs 2 to 3,
#: prose that mixes two 4 to 5, encoded bytes 6 and more.
REJECT_BITS, REJECT_SYMBOLS = 6.0, 40
#: Bits a symbol that a label must cost more than the language found, for the label to be changed.
RELABEL_BITS = 0.5
BATCH_BYTES = 24 << 20

# Letters keep their (folded) byte, everything else is a space.
_SYMBOL = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(128, 256)):
    _SYMBOL[_b] = _b
for _b in range(65, 91):
    _SYMBOL[_b] = _b + 32


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of other characters as one space, and the offsets of each text in them."""
    if not len(data):
        return data, np.zeros(len(offsets), np.int64)
    s = _SYMBOL[data]
    latin = np.flatnonzero(s == 0xC3)
    latin = latin[latin + 1 < len(s)]
    upper = latin[(s[latin + 1] >= 0x80) & (s[latin + 1] <= 0x9E)] + 1
    s[upper] += 32
    space = s == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = True
    inner = offsets[(offsets > 0) & (offsets < len(s))]
    keep[inner] = True
    # A space at a text's ends tells nothing.
    keep[inner[space[inner]]] = False
    if space[0]:
        keep[0] = False
    before = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return s[keep], before[offsets]


def all_symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`symbols` of a column, about CHUNK_BYTES at a time, so that its masks and sums stay small."""
    data, offsets = buffers(col)
    parts, sizes, i, n = [], [np.zeros(1, np.int64)], 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
        own, ends = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(own)
        sizes.append(np.diff(ends))
        i = j
    return np.concatenate([*parts, data[:0]]), np.cumsum(np.concatenate(sizes))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all factors of `text`; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The transducer of all languages; `labelled` maps a language to its normalised text."""

    def __init__(self, labelled: dict[str, bytes]):
        self.languages = sorted(labelled)
        self.log_size = np.array([math.log2(max(2, len(labelled[x]))) for x in self.languages])
        seen = sorted(set(b"".join(labelled.values())))
        self.codes = np.zeros(256, np.uint8 if len(seen) < 256 else np.uint16)
        self.codes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        kind = np.int32 if sum(2 * len(x) + 2 for x in labelled.values()) * width < 1 << 30 else np.int64
        tables, self.roots, base = [], [], 0
        for name in self.languages:
            nxt = suffix_automaton(labelled[name])
            root = np.full(width, base, kind)
            for c, q in nxt[0].items():
                root[self.codes[c]] = base + q * width
            t = np.tile(root << 1 | 1, (len(nxt), 1))
            at = [(p, self.codes[c], q) for p, row in enumerate(nxt) if p for c, q in row.items()]
            if at:
                p, c, q = np.array(at, np.int64).T
                t[p, c] = (base + q * width) << 1
            tables.append(t.ravel())
            self.roots.append(base)
            base += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, kind)

    def phrases(self, syms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases of each text in each language (languages x texts)."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        start, n = offsets[:-1][order], len(order)
        active = n - np.searchsorted(lengths[order][::-1], np.arange(int(lengths.max()) if n else 0), "right")
        codes = self.codes[syms]
        state = np.tile(np.array(self.roots, self.table.dtype)[:, None], (1, n))
        count = np.zeros((len(self.roots), n), self.table.dtype)
        done = 0
        for t, a in enumerate(active):
            if a != done:
                state, count_now, done = np.ascontiguousarray(state[:, :a]), count[:, :a], a
            v = self.table[state + codes[start[:a] + t]]
            count_now += v & 1
            v >>= 1
            state = v
        out = np.empty_like(count)
        out[:, order] = count
        return out


def sample(docs: DataFrame) -> dict[str, bytes]:
    """The labelled text of each language: rows in the order of a hash of doc_id, up to TRAIN_BYTES.

    Of a longer row the first ROW_CHARACTERS are taken, so a language of long rows alone is learned as well.
    """
    near = docs.filter("lang is not null and trim(lang) != '' and text is not null and text != '' and doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= TRAIN_ROWS)
    picked = {(x.lang, x.doc_id): x.r for x in ranked.collect()}
    if not picked:
        return {}
    rows = docs.filter(F.col("doc_id").isin(sorted({k[1] for k in picked}))).select("lang", "doc_id", F.substring("text", 1, ROW_CHARACTERS).alias("text")).filter("text is not null").dropDuplicates().collect()
    out: dict[str, bytes] = {}
    for x in sorted((x for x in rows if (x.lang, x.doc_id) in picked), key=lambda x: (x.lang, picked[x.lang, x.doc_id], x.text)):
        if len(out.get(x.lang, b"")) < TRAIN_BYTES:
            data, offsets = buffers(pa.array([x.text]))
            out[x.lang] = out.get(x.lang, b"") + b" " + symbols(data, offsets)[0].tobytes()
    return out


_parsers: dict[tuple, Parser] = {}


def parser(labelled: dict[str, bytes]) -> Parser:
    """The parser of a sample, built once in each Python worker."""
    key = tuple(sorted(labelled.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(labelled)
    return _parsers[key]


def costs(col: pa.Array, labelled: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text, and its bits a symbol in each language (languages x texts)."""
    syms, offsets = all_symbols(col)
    n = np.diff(offsets)
    p = parser(labelled)
    return n, p.phrases(syms, offsets) * p.log_size[:, None] / np.maximum(n, 1)


def verdicts(n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language (-1: none), its bits a symbol, and whether the text is rejected."""
    if not len(bits):
        return np.full(len(n), -1), np.full(len(n), np.nan), n == 0
    best = np.argmin(bits, axis=0) if len(n) else np.zeros(0, np.int64)
    least = bits[best, np.arange(len(n))]
    rejected = (n == 0) | ((n >= REJECT_SYMBOLS) & (least > REJECT_BITS))
    return np.where(rejected, -1, best), np.where(n == 0, np.nan, least), rejected


def classify(col: pa.Array, labelled: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return verdicts(*costs(col, labelled))


def identify(docs: DataFrame, labelled: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, language, bits): one row for each row of `docs`.

    `language` is null where the text is rejected: null, empty and letterless texts, and texts of
    REJECT_SYMBOLS symbols or more whose best language needs more than REJECT_BITS a symbol. Ties go to
    the language first in the alphabet. Without labelled rows every language is null. A null doc_id stays
    null; repeated rows give repeated results; an empty table gives an empty result. Whole texts are parsed,
    however long. Other columns than doc_id, lang and text are not read.
    """
    labelled = sample(docs) if labelled is None else labelled
    names = sorted(labelled)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, bits, _ = classify(batch.column("text"), labelled)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array(bits, pa.float64(), from_pandas=True)], ["doc_id", "language", "bits"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, language string, bits double", "text", BATCH_BYTES)


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns.

    `lang` gets the language that was found where it is null or blank, and where a text of REJECT_SYMBOLS or more needs
    RELABEL_BITS a symbol more in the language that it names. Null, empty and letterless texts are rejected; ties,
    repeated rows, null ids and long texts are as in `identify`. Without labelled rows only texts without a letter are
    rejected. An empty table gives an empty result; columns of any names are kept as they are.
    """
    labelled = sample(docs)
    names = np.array([*sorted(labelled), None], object)
    k = docs.columns.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, bits = costs(batch.column("text"), labelled)
        best, least, rejected = verdicts(n, bits)
        lang = batch.column(k)
        wrong = pc.fill_null(pc.equal(pc.utf8_trim_whitespace(lang), ""), True).to_numpy(zero_copy_only=False)
        if len(labelled):
            own = pc.fill_null(pc.index_in(lang, pa.array(names[:-1], lang.type)), -1).to_numpy(zero_copy_only=False)
            wrong = wrong | ((own >= 0) & (n >= REJECT_SYMBOLS) & (bits[own, np.arange(len(n))] - least >= RELABEL_BITS))
        if wrong.any():
            batch = batch.set_column(k, batch.schema.field(k), pc.if_else(pa.array(wrong), pa.array(names[best], lang.type), lang))
        return batch.filter(pa.array(~rejected))

    return map_batches(docs, docs.columns, run, docs.schema, "text", BATCH_BYTES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`identify` over the whole table `documents`, learned from its labelled rows; texts are not shuffled."""
    return identify(table(spark, sf_dir, "documents"))
