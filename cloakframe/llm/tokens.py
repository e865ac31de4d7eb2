"""Token counts by byte-pair merging with a heap and a linked list.

The adjacent pair of lowest rank is merged again and again: pairs wait in a heap, symbols form a
doubly linked list, so n symbols take O(n log n). A piece's count is its bytes minus the merges; no
identifiers are made. Pieces repeat a lot, so each worker remembers the counts of those it has met.
"""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import map_batches, table

#: A vocabulary as lines of "base64 rank"; read where the query is built and sent to the workers.
VOCABULARY = os.environ.get("CLOAKFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The largest vocabulary file that is sent along with the tasks.
MOST_VOCABULARY = 64 << 20
#: Pieces that a worker remembers; at this bound it starts afresh, which changes no count.
MOST_PIECES = 1_000_000
#: The public pre-tokenisation rule of byte-level BPE vocabularies of this kind.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def count_piece(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: its bytes less the merges."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        # Stale: the left symbol is gone or has grown, or the right one isn't what it was.
        if end[i] < 0 or j >= n or end[j] != stop:
            continue
        merges += 1
        end[i], end[j] = stop, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return n - merges


class Counter(dict):
    """Piece -> tokens, filled as pieces turn up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.split = ranks, regex.compile(PIECES).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = count_piece(piece.encode(), self.ranks)
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.split(text))) if text else 0


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each row of `docs`.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows give repeated results.
    Bytes that the vocabulary lacks count one token each. Of equal ranks the leftmost pair is merged first. Long
    texts are counted whole; an empty table gives an empty result. Other columns than doc_id and text are not read.
    """
    if os.path.getsize(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"{vocabulary} has more than {MOST_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = shared.value
        if id(ranks) not in _counters:
            _counters.clear()
            _counters[id(ranks)] = Counter(ranks)
        counter = _counters[id(ranks)]
        n = [counter.count(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long", "text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`token_counts` over the whole table `documents`, by VOCABULARY; no shuffle."""
    return token_counts(table(spark, sf_dir, "documents"))
