"""Packet tables of Matroska media columns.

A file is a tree of EBML elements: an identifier and a size, both of variable length, then the data.
`Parser` walks the segment's tracks, clusters (blocks, block groups, all lacings) and cues, and lists
the frames with their times, tracks and byte ranges. Elements of unknown size end where an element of
their own or a higher level begins, as in live streams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import map_batches, table

EBML, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, ENTRY, NUMBER, TYPE, CODEC, DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS}
#: Numbers and times beyond this are damage.
MOST = (1 << 63) - 1
LACINGS = ("none", "xiph", "fixed", "ebml")

#: track, codec, timestamp in ns, keyframe, lacing, first byte, bytes, and whether a cue leads to it.
Packet = tuple[int, str | None, int, bool, str, int, int, bool]


class Broken(ValueError):
    """The data ends, or can't be an element."""


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """An element's identifier (with its length mark) and where it ends."""
    if at >= end or not data[at]:
        raise Broken("no identifier")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise Broken("identifier")
    return int.from_bytes(data[at : at + n]), at + n


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """A size without its length mark (None: unknown) and where it ends."""
    if at >= end or not data[at]:
        raise Broken("no size")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Broken("size")
    value = int.from_bytes(data[at : at + n]) & ((1 << 7 * n) - 1)
    return None if value == (1 << 7 * n) - 1 else value, at + n


def _number(data: bytes, a: int, b: int) -> int:
    """An unsigned number of at most 63 bits; no time, track or duration needs more."""
    value = int.from_bytes(data[a:b]) if b - a <= 8 else MOST + 1
    if value > MOST:
        raise Broken("number")
    return value


class Parser:
    def __init__(self, data: bytes):
        self.data = data
        self.scale, self.tracks = 1_000_000, {}
        self.packets: list[list] = []
        self.cues: set[tuple[int, int]] = set()
        self.segment = 0

    def children(self, at: int, end: int, stop: set[int] = frozenset()):
        """(identifier, first byte of the element, of its data, end) of each element; ends before one in `stop`."""
        while at < end:
            name, p = read_id(self.data, at, end)
            if name in stop:
                return
            size, p = read_size(self.data, p, end)
            last = self.unknown_end(name, p, end) if size is None else p + size
            if last > end:
                # A container that was cut off still holds whole elements; a block doesn't.
                if name not in (SEGMENT, *TOP, GROUP):
                    raise Broken("cut off")
                last = end
            yield name, at, p, last
            at = last

    def unknown_end(self, name: int, at: int, end: int) -> int:
        if name == SEGMENT:
            return end
        if name != CLUSTER:
            raise Broken("unknown size")
        while at < end:
            inner, p = read_id(self.data, at, end)
            if inner in TOP or inner in (SEGMENT, EBML):
                return at
            size, p = read_size(self.data, p, end)
            if size is None:
                raise Broken("unknown size")
            at = min(end, p + size)
        return end

    def parse(self) -> list[Packet]:
        """All frames in file order; what follows a break in the file is left out."""
        try:
            for name, _, a, b in self.children(0, len(self.data)):
                if name == SEGMENT:
                    self.segment = a
                    for inner, at, c, d in self.children(a, b):
                        self.top(inner, at, c, d)
        except Broken:
            pass
        out = []
        for track, time, key, lacing, lace, at, size, cluster in self.packets:
            codec, step = self.tracks.get(track, (None, 0))
            ns = time * self.scale + lace * step
            if not -MOST <= ns <= MOST:
                break
            out.append((track, codec, ns, key, lacing, at, size, (time, track, cluster) in self.cues))
        return out

    def top(self, name: int, at: int, a: int, b: int) -> None:
        if name == CLUSTER:
            self.cluster(at, a, b)
        elif name == INFO:
            for inner, _, c, d in self.children(a, b):
                if inner == SCALE:
                    self.scale = _number(self.data, c, d)
        elif name == TRACKS:
            for inner, _, c, d in self.children(a, b):
                if inner == ENTRY:
                    own = {n: (e, f) for n, _, e, f in self.children(c, d)}
                    if NUMBER in own:
                        codec = self.data[slice(*own[CODEC])].rstrip(b"\0").decode("ascii", "replace") if CODEC in own else None
                        self.tracks[_number(self.data, *own[NUMBER])] = codec, _number(self.data, *own[DURATION]) if DURATION in own else 0
        elif name == CUES:
            for inner, _, c, d in self.children(a, b):
                if inner == POINT:
                    time = 0
                    for n, _, e, f in self.children(c, d):
                        if n == CUE_TIME:
                            time = _number(self.data, e, f)
                        elif n == POSITIONS:
                            own = {m: _number(self.data, g, h) for m, _, g, h in self.children(e, f) if m in (CUE_TRACK, CUE_CLUSTER)}
                            self.cues.add((time, own.get(CUE_TRACK, 0), self.segment + own.get(CUE_CLUSTER, 0)))

    def cluster(self, at: int, a: int, b: int) -> None:
        base = 0
        for name, _, c, d in self.children(a, b):
            if name == TIME:
                base = _number(self.data, c, d)
            elif name == SIMPLE:
                self.block(base, c, d, at, None)
            elif name == GROUP:
                own = {n: (e, f) for n, _, e, f in self.children(c, d)}
                if BLOCK in own:
                    self.block(base, *own[BLOCK], at, REFERENCE not in own)

    def block(self, base: int, a: int, b: int, cluster: int, key: bool | None) -> None:
        """The frames of one block; `key` is known for a block of a group, else a flag tells."""
        track, p = read_size(self.data, a, b)
        if track is None or p + 3 > b:
            raise Broken("block")
        time = base + int.from_bytes(self.data[p : p + 2], signed=True)
        flags = self.data[p + 2]
        lacing = (flags >> 1) & 3
        key = bool(flags & 0x80) if key is None else key
        at, sizes = self.laces(lacing, p + 3, b)
        for i, size in enumerate(sizes):
            self.packets.append([track, time, key, LACINGS[lacing], i, at, size, cluster])
            at += size

    def laces(self, lacing: int, at: int, end: int) -> tuple[int, list[int]]:
        if not lacing:
            return at, [end - at]
        data = self.data
        if at >= end:
            raise Broken("lacing")
        count, at = data[at] + 1, at + 1
        sizes: list[int] = []
        if lacing == 1:
            for _ in range(count - 1):
                size = 0
                while True:
                    if at >= end:
                        raise Broken("lacing")
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
                sizes.append(size)
        elif lacing == 3:
            for i in range(count - 1):
                n = 9 - data[at].bit_length() if at < end else 9
                if n > 8 or at + n > end:
                    raise Broken("lacing")
                value, at = int.from_bytes(data[at : at + n]) & ((1 << 7 * n) - 1), at + n
                # The first size is as it is, the others are signed differences.
                sizes.append(sizes[-1] + value - ((1 << (7 * n - 1)) - 1) if i else value)
        else:
            if (end - at) % count:
                raise Broken("lacing")
            return at, [(end - at) // count] * count
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken("lacing")
        return at, sizes


# --- writing: texts as subtitle files, for tables without a media column ---------------------------


def size_of(n: int, least: int = 1) -> bytes:
    k = least
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k)


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8) + size_of(len(data)) + data


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The data of a block after its flags."""
    if not lacing:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        for i, f in enumerate(frames[:-1]):
            if not i:
                head += size_of(len(f))
            else:
                diff, k = len(f) - len(frames[i - 1]), 1
                while abs(diff) > (1 << (7 * k - 1)) - 1:
                    k += 1
                head += (diff + (1 << (7 * k - 1)) - 1 | 1 << 7 * k).to_bytes(k)
    return head + b"".join(frames)


LINES_PER_CLUSTER, LACE, STEP_MS = 16, 4, 1000


def write(frames: list[bytes], tracks: int = 2) -> bytes:
    """A file with one frame a second: clusters of LINES_PER_CLUSTER frames go to the tracks in turn.

    Clusters use no lacing, Xiph, fixed-size (where frames are of one size) and EBML lacing in turn; the
    unlaced ones hold a block group at their end; every cluster has a cue; each third has an unknown size.
    """
    entries = b"".join(element(ENTRY, number(NUMBER, t + 1) + number(TYPE, 17) + element(CODEC, b"S_TEXT/UTF8") + number(DURATION, STEP_MS * 1_000_000)) for t in range(tracks))
    body, cues = element(INFO, number(SCALE, 1_000_000)) + element(TRACKS, entries), []
    parts, length = [body], len(body)
    for c, first in enumerate(range(0, len(frames), LINES_PER_CLUSTER)):
        own, track, kind = frames[first : first + LINES_PER_CLUSTER], c % tracks + 1, c % 4
        start, blocks = first * STEP_MS, []
        step = LACE if kind else 1
        for i in range(0, len(own), step):
            group = own[i : i + step]
            k = 3 if kind == 2 and len({len(f) for f in group}) > 1 else kind
            last = not kind and i == len(own) - 1
            data = size_of(track) + (i * STEP_MS).to_bytes(2) + bytes([(0 if last else 0x80) | k << 1]) + lace(group, k)
            blocks.append(element(GROUP, element(BLOCK, data) + element(REFERENCE, b"\xff")) if last else element(SIMPLE, data))
        data = number(TIME, start) + b"".join(blocks)
        cues.append(element(POINT, number(CUE_TIME, start) + element(POSITIONS, number(CUE_TRACK, track) + number(CUE_CLUSTER, length))))
        parts.append(CLUSTER.to_bytes(4) + (b"\x01" + b"\xff" * 7 if c % 3 == 2 else size_of(len(data))) + data)
        length += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(0x4282, b"matroska")) + element(SEGMENT, b"".join(parts))


def subtitles(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a Matroska file with its lines as frames; a null text has null media."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [None if t is None else write(t.encode().split(b"\n")) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, media binary", "text")


def packets(files: DataFrame) -> DataFrame:
    """(doc_id, packet, track, codec, timestamp_ns, keyframe, lacing, start, size, cued): all frames of
    the files in `media`.

    `packet` counts the frames of a file from 0, start and size are the frame's byte range in it. A
    laced frame's time is its block's plus its place in the lace times the track's default duration (0
    without one). A track that isn't described has a null codec. Numbers and times beyond 63 bits are damage. `cued` tells whether a cue has the time, track
    and cluster of the frame's block. Null, empty and foreign data have no packets; a damaged file has those
    before the damage. A null doc_id stays null; repeated rows give repeated results; an empty table gives an
    empty result. Other columns than doc_id and media are not read.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                if media:
                    rows += [(doc, i, *p) for i, p in enumerate(Parser(media).parse())]
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, packet int, track long, codec string, timestamp_ns long, keyframe boolean, lacing string, start long, size long, cued boolean")


_TYPES = {"doc_id": pa.int64(), "packet": pa.int32(), "track": pa.int64(), "codec": pa.string(), "timestamp_ns": pa.int64(), "keyframe": pa.bool_(), "lacing": pa.string(), "start": pa.int64(), "size": pa.int64(), "cued": pa.bool_()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES.values())], list(_TYPES))


def op4_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media; the texts of `documents`, written as subtitle files, stand in for it."""
    return packets(subtitles(table(spark, sf_dir, "documents")))
