"""SimHash near-duplicate search by the generalised pigeonhole principle.

Each text gets a 64-bit SimHash over the set of its words. Two texts are near duplicates when their
hashes differ in at most `radius` bits. Bits that go together in the corpus are put side by side,
the 64 bits are cut into partitions of unequal width, and each partition i gets its own threshold
t_i with sum(t_i + 1) = radius + 1: two hashes within the radius then differ in at most t_i bits of
some partition. Widths and thresholds come from a dynamic programme over estimated candidate
counts, so a larger corpus gets wider partitions. Each hash is a probe for all the values within
ceil(t_i / 2) flips of its own in partition i, so hashes within t_i meet at a value; those that meet
are verified by their whole hashes. The search is exact for the hashes. Documents go in the order of their
ids: those that no earlier one meets stay, and only pairs of theirs are compared by their words, round by round; a
document goes if it matches one that stays. Where many hashes meet at a value, only those that no earlier one is near to there
give their pairs, so a group of near copies gives as many pairs as it has members; what that leaves undecided is searched again.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import buffers, checkpoint, fresh, keep_rows, map_batches, shuffle_partitions, small, splitmix, table, words

RADIUS = 10
#: Least Jaccard index of the words of two texts that match.
SHARE = 0.5
BITS = 64
#: Bits of one atom; a partition is a run of atoms.
ATOM = 8
#: Relative costs, as measured, of one probe row (explode, shuffle, sort) and of one candidate (an XOR
#: and a bit count in numpy).
PROBE_COST, CANDIDATE_COST = 1.0, 0.003
#: Groups of at most so many rows are compared by shifts of the whole column and give all their pairs, larger ones by matrices
#: of at most MATRIX cells.
SMALL_GROUP, MATRIX = 32, 1 << 21


def distinct_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (44 bits) of each text's distinct words in ascending order, one text after the other, and where each text's begin.

    A text with bytes but without words counts as one word; a null or empty one has none.
    """
    data, offsets = buffers(col)
    n = len(offsets) - 1
    h, first = words(col)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    bare = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(first) == 0)).astype(np.uint64)
    if len(bare):
        whole = splitmix(np.array([hash_bytes(data[offsets[i] : offsets[i + 1]]) for i in bare], np.uint64))
        row, h = np.concatenate([row, bare]), np.concatenate([h, whole])
    key = np.sort((row << np.uint64(44)) | (h >> np.uint64(20)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    return key & np.uint64((1 << 44) - 1), at


def hashes(col: pa.Array, sets: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each text, and whether it has one (a text without any byte has none). Each distinct word weighs 1."""
    key, at = sets or distinct_words(col)
    out = np.zeros(len(at) - 1, np.uint64)
    bits = np.unpackbits(splitmix(key + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in range(len(out)):
        a, b = at[i], at[i + 1]
        if a < b:
            out[i] = weights[2 * np.add.reduce(bits[a:b], axis=0, dtype=np.int32) > b - a].sum(dtype=np.uint64)
    return out, np.diff(at) > 0


def bags(sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each text's set of words."""
    key, at = sets
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(key + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def hash_bytes(data: np.ndarray) -> int:
    value = 1469598103934665603
    for x in data.tobytes():
        value = ((value ^ x) * 1099511628211) & ((1 << 64) - 1)
    return value


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, bag) of each row with a doc_id and a text of at least one byte; `bag` is a hash of the set of words.

    A text without words has its bytes as its one word. Texts of the same words have the same `sig` and `bag`.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = distinct_words(batch.column("text"))
        sig, has = hashes(batch.column("text"), sets)
        out = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sig.view(np.int64)), pa.array(bags(sets).view(np.int64))], ["doc_id", "sig", "bag"])
        return out.filter(pa.array(has))

    return map_batches(docs.filter("doc_id is not null and text is not null"), ["doc_id", "text"], run, "doc_id long, sig long, bag long", "text")


# --- the plan: bit order, partitions, thresholds -------------------------------------------------


def _bits(sig: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each hash; column j is bit j."""
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def permute(sig: np.ndarray, order: list[int]) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(_bits(sig)[:, order], axis=1, bitorder="little")).view(np.uint64).ravel()


def bit_moments(sigs: DataFrame) -> np.ndarray:
    """Sums of products of all pairs of bits (65 x 65, the last for the constant 1), over all hashes."""
    side = BITS + 1

    def run(batches):
        total = np.zeros((side, side))
        for batch in batches:
            sig = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(sig), 1 << 16):
                x = np.hstack([_bits(sig[i : i + (1 << 16)]), np.ones((len(sig[i : i + (1 << 16)]), 1), np.uint8)]).astype(np.float32)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(side * side, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(side * side)
    for r in sigs.select("sig").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(side, side)


def bit_order(moments: np.ndarray) -> list[int]:
    """Bits ordered so that correlated ones share an atom: each atom starts with the free bit of the
    highest remaining correlation and takes the free bits closest to those it has."""
    n = max(moments[-1, -1], 1)
    mean = moments[-1, :BITS] / n
    cov = moments[:BITS, :BITS] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(std, std))
    np.fill_diagonal(corr, 0)
    free, order = set(range(BITS)), []
    while free:
        rest = sorted(free)
        own = [max(rest, key=lambda j: (corr[j, rest].max(), -j))]
        free.discard(own[0])
        while len(own) < ATOM:
            nxt = max(sorted(free), key=lambda j: (corr[j, own].sum(), -j))
            own.append(nxt)
            free.discard(nxt)
        order += own
    return order


def atom_distances(sigs: DataFrame) -> list[np.ndarray]:
    """For each atom of the permuted hashes, the share of all ordered pairs at distance 0..8, from the
    histogram of its 256 values over all hashes."""
    atoms = BITS // ATOM
    cells = sigs.select(F.explode(F.array(*[F.lit(a << 8) + F.shiftright("psig", a * ATOM).bitwiseAND(F.lit(255)).cast("int") for a in range(atoms)])).alias("cell")).groupBy("cell").count().collect()
    h = np.zeros((atoms, 1 << ATOM))
    for r in cells:
        h[r[0] >> 8, r[0] & 255] = r[1]
    weight = np.array([bin(x).count("1") for x in range(1 << ATOM)])
    out = []
    for x in h:
        x = x / max(x.sum(), 1)
        pair = np.array([np.dot(x, x[np.arange(1 << ATOM) ^ d]) for d in range(1 << ATOM)])
        out.append(np.bincount(weight, pair, ATOM + 1))
    return out


def flip_radius(t: int) -> int:
    """Flips of each hash for threshold t: two hashes t apart meet at a value within this of both."""
    return t - t // 2


def spread(width: int, t: int) -> int:
    """Rows of one hash in a partition."""
    return sum(comb(width, j) for j in range(flip_radius(t) + 1))


def allot(atoms: list[np.ndarray], n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, width, threshold) of each partition, of least estimated cost.

    best[a][s]: least cost of covering the first a atoms with sum(t + 1) = s.
    """
    # No hashes at all would make every plan free, those with millions of flips included.
    n, count, need = max(n, 1), len(atoms), radius + 1
    best = [[np.inf] * (need + 1) for _ in range(count + 1)]
    back: list[list[tuple | None]] = [[None] * (need + 1) for _ in range(count + 1)]
    best[0][0] = 0.0
    for a in range(count):
        near = np.ones(1)
        for b in range(a + 1, count + 1):
            near = np.convolve(near, atoms[b - 1])
            within, width = np.cumsum(near), (b - a) * ATOM
            for t in range(-1, min(width, radius) + 1):
                cost = 0.0 if t < 0 else n * PROBE_COST * spread(width, t) + n * n / 2 * within[t] * CANDIDATE_COST
                for s in range(need - t):
                    if best[a][s] + cost < best[b][s + t + 1]:
                        best[b][s + t + 1] = best[a][s] + cost
                        back[b][s + t + 1] = (a, s, t)
    parts, b, s = [], count, need
    while b:
        a, s, t = back[b][s]
        if t >= 0:
            parts.append((a * ATOM, (b - a) * ATOM, t))
        b = a
    return parts[::-1]


def flips(width: int, radius: int) -> list[int]:
    return [sum(1 << j for j in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def meet(key: np.ndarray, sig: np.ndarray, ids: np.ndarray, inner: np.ndarray, radius: int, star: bool) -> list[np.ndarray]:
    """Pairs of rows within `radius` that share a key, as (a_id, a_sig, b_id, b_sig), the earlier one (by id, then hash) first; `key` is sorted.

    A pair counts if one of its rows is `inner`. With `star`, only some rows of a large group give their pairs: those that are near
    to no earlier one that does. Each other row that is near to such a row gives a pair with itself, as a mark that pairs of it may be missing.
    """
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    small_rows = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    k, s, e = key[small_rows], sig[small_rows], inner[small_rows]
    for d in range(1, SMALL_GROUP):
        same = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else ()
        if not len(same):
            break
        near = same[(np.bitwise_count(s[same] ^ s[same + d]) <= radius) & (e[same] | e[same + d])]
        left.append(small_rows[near])
        right.append(small_rows[near + d])
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        order = start + np.lexsort((sig[start : start + size], ids[start : start + size]))
        s, e = sig[order], inner[order]
        covered, step = np.zeros(size, bool), max(1, MATRIX // size)
        for i in range(0, size, step):
            rows = i + np.flatnonzero(~covered[i : i + step])
            cols = np.concatenate([np.flatnonzero(covered[:i]), np.arange(i, size)])
            near = (np.bitwise_count(s[rows, None] ^ s[None, cols]) <= radius) & (e[rows, None] | e[None, cols])
            near &= rows[:, None] != cols[None, :]
            if not star:
                r, c = np.nonzero(near)
                later = cols[c] > rows[r]
                left.append(order[rows[r[later]]])
                right.append(order[cols[c[later]]])
                continue
            for r in np.flatnonzero(near.any(1)):
                if not covered[rows[r]]:
                    hit = cols[near[r]]
                    left.append(np.full(len(hit), order[rows[r]]))
                    right.append(order[hit])
                    covered[hit[hit > rows[r]]] = True
        left.append(order[covered])
        right.append(order[covered])
    i, j = np.concatenate(left or [starts[:0]]), np.concatenate(right or [starts[:0]])
    swap = (ids[i] > ids[j]) | (ids[i] == ids[j]) & (sig[i] > sig[j])
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return [ids[i], sig[i].view(np.int64), ids[j], sig[j].view(np.int64)]


EDGE = ["a_id", "a_sig", "b_id", "b_sig"]


def near_pairs(nodes: DataFrame, radius: int = RADIUS, star: bool = False) -> DataFrame:
    """(a_id, a_sig, b_id, b_sig): pairs of `nodes` (id, psig; distinct) within the radius, the earlier one first.

    All pairs, each once; with `star` see `meet`. The hashes came from `planned`.
    """
    parts = allot(atom_distances(nodes), nodes.count(), radius)

    def keyed(p: int, own):
        return lambda m: own.bitwiseXOR(m).bitwiseOR(F.lit(p << 56))

    per_part, inner = [], []
    for p, (at, width, t) in enumerate(parts):
        own = F.shiftrightunsigned("psig", at)
        if width < 64:
            own = own.bitwiseAND(F.lit((1 << width) - 1))
        masks = flips(width, flip_radius(t))
        within = len(flips(width, t // 2))
        per_part.append(F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), keyed(p, own)))
        inner += [i < within for i in range(len(masks))]
    spread_out = nodes.select("id", "psig").repartition(shuffle_partitions(nodes.sparkSession))
    rows = spread_out.select("id", "psig", F.posexplode(F.concat(*per_part)).alias("pos", "key"))
    keys = rows.select("key", "psig", "pos", "id").repartition("key").sortWithinPartitions("key")
    flag = np.array(inner)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def settle(whole: list[tuple[np.ndarray, ...]]):
            k, s, e, ids = (np.concatenate(x) for x in zip(*whole))
            found = meet(k, s, ids, e, radius, star)
            for i in range(0, len(found[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in found], EDGE)

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            s = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            e = flag[batch.column(2).to_numpy(zero_copy_only=False)]
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            # The last key may go on in the next batch.
            if len(k) and (cut or held and held[-1][0][-1] != k[0]):
                yield from settle([*held, (k[:cut], s[:cut], e[:cut], ids[:cut])])
                held = []
            if len(k):
                held.append((k[cut:], s[cut:], e[cut:], ids[cut:]))
        if held:
            yield from settle(held)

    return keys.mapInArrow(run, ", ".join(f"{c} long" for c in EDGE)).distinct()


def planned(sigs: DataFrame) -> DataFrame:
    """`sigs` with `psig` for `sig`: the hash with correlated bits side by side."""
    order = bit_order(bit_moments(sigs))
    rest = [c for c in sigs.columns if c != "sig"]

    def run(batches):
        for batch in batches:
            psig = permute(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), order)
            yield pa.RecordBatch.from_arrays([pa.array(psig.view(np.int64)), *batch.columns[1:]], ["psig", *rest])

    return sigs.select("sig", *rest).mapInArrow(run, ", ".join(["psig long", *(f"{c} {dict(sigs.dtypes)[c]}" for c in rest)]))


def word_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, bag, words): the distinct words of each text; see `signatures`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, at = sets = distinct_words(batch.column("text"))
        own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(bags(sets).view(np.int64)), own], ["doc_id", "bag", "words"])

    return map_batches(docs.filter("doc_id is not null and text != ''"), ["doc_id", "text"], run, "doc_id long, bag long, words array<long>", "text")


def alike(pairs: DataFrame) -> DataFrame:
    """The rows of `pairs` (a, b, a_words, b_words) whose sets have a Jaccard index of SHARE or more, without the sets."""
    kept = [c for c in pairs.columns if c not in ("a_words", "b_words")]

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("a_words"), batch.column("b_words")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= SHARE * (len(x) + len(y) - both))
            yield batch.select(kept).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in kept))


def _on(df: DataFrame, side: str, others: DataFrame, how: str) -> DataFrame:
    """`df` joined with nodes (id, sig) on one side of its edges."""
    named = others.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), *[c for c in others.columns if c not in ("id", "sig")])
    return df.join(named, (F.col(f"{side}_id") == F.col("__id")) & (F.col(f"{side}_sig") == F.col("__sig")), how).drop("__id", "__sig")


def _side(edges: DataFrame, side: str) -> DataFrame:
    return edges.select(F.col(f"{side}_id").alias("id"), F.col(f"{side}_sig").alias("sig"))


def leaders(edges: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, sig, kept) of the nodes that go, each with the least id of the nodes that stay and match it; and (id, sig) of the nodes that
    can't be told yet.

    `edges` are those of `near_pairs`, `sets` (id, sig, words) has the words of all their nodes. In each round, nodes without an open
    edge to them, and without a mark, stay; their edges are compared by words, the nodes that match go, and the edges of both are settled. Edges between
    nodes that go are never compared. What is left in the end hangs on nodes with marks.
    """
    same = (F.col("a_id") == F.col("b_id")) & (F.col("a_sig") == F.col("b_sig"))
    marked, left, out = checkpoint(_side(edges.filter(same), "a")), checkpoint(edges.filter(~same)), None
    while True:
        blocked = _side(left, "b").unionByName(marked).distinct()
        tried = checkpoint(_on(left, "a", blocked, "left_anti"))
        if tried.isEmpty():
            break
        # The sets of this round's nodes alone are moved: the edges go to their later nodes, and those with their sets to the earlier ones.
        first = sets.join(small(_side(tried, "a").distinct()), ["id", "sig"], "left_semi")
        later = small(tried)
        held = sets.withColumnRenamed("words", "b_words").join(later, (F.col("id") == F.col("b_id")) & (F.col("sig") == F.col("b_sig"))).drop("id", "sig")
        paired = _on(held, "a", first.withColumnRenamed("words", "a_words"), "inner")
        gone = checkpoint(alike(paired).groupBy(F.col("b_id").alias("id"), F.col("b_sig").alias("sig")).agg(F.min("a_id").alias("kept")))
        out = gone if out is None else out.unionByName(gone)
        left = left.join(tried, EDGE, "left_anti")
        done = gone.select("id", "sig")
        left = checkpoint(_on(_on(left, "a", done, "left_anti"), "b", done, "left_anti"))
        marked = checkpoint(marked.join(done, ["id", "sig"], "left_anti"))
    undecided = _side(left, "a").unionByName(_side(left, "b")).unionByName(marked).distinct()
    return (_side(edges, "a").limit(0).withColumn("kept", F.lit(0).cast("long")) if out is None else out), undecided


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, duplicate_of): each document that repeats another, with the one that stays.

    Two texts match if their hashes are within `radius` and the Jaccard index of their words is SHARE or
    more. In the order of doc_id, a document stays unless it matches one that stays. Rows with
    a null doc_id or a null or empty text take no part. Repeated rows of one doc_id count once. Texts
    without words are compared by their bytes. Whole texts count, however long. Columns besides doc_id and text are not
    read. An empty table gives an empty result.
    """
    rows = checkpoint(planned(checkpoint(signatures(docs))))
    # Texts of the same words are one node, named by its least doc_id and its hash.
    nodes = checkpoint(rows.groupBy("bag").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first("psig").alias("sig")))
    open_, gone, sets = checkpoint(nodes.select("id", F.col("sig").alias("psig")).distinct()), None, None
    while True:
        edges = checkpoint(near_pairs(open_, radius, star=True))
        if edges.isEmpty():
            break
        if sets is None:
            # Words are made for the nodes that met others alone; what a later round meets met in the first.
            asked = checkpoint(_side(edges, "a").unionByName(_side(edges, "b")).distinct().join(nodes.groupBy("id", "sig").agg(F.min("bag").alias("bag")), ["id", "sig"]))
            own = docs.join(small(asked.select(F.col("id").alias("__id")).distinct()), F.col("doc_id") == F.col("__id"), "left_semi")
            made = word_sets(own.select("doc_id", "text")).withColumnRenamed("bag", "__bag")
            sets = checkpoint(made.join(small(asked), (F.col("doc_id") == F.col("id")) & (F.col("__bag") == F.col("bag"))).select("id", "sig", "words"))
            if sets.count() > asked.count():
                # Rows that repeat a doc_id.
                sets = checkpoint(sets.dropDuplicates(["id", "sig"]))
        more, undecided = leaders(edges, sets)
        gone = more if gone is None else gone.unionByName(more)
        open_ = checkpoint(undecided.withColumnRenamed("sig", "psig"))
        if open_.isEmpty():
            break
    if gone is None:
        kept = nodes.filter("last > id").select("bag", F.col("id").alias("duplicate_of"))
    else:
        kept = nodes.join(gone, ["id", "sig"], "left").filter("kept IS NOT NULL OR last > id").select("bag", F.coalesce("kept", "id").alias("duplicate_of"))
    return rows.join(small(kept), "bag").filter(F.col("doc_id") != F.col("duplicate_of")).select("doc_id", "duplicate_of").distinct()


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: one document of each group, and one row of each repeated doc_id.

    Rows that take no part in the search (null doc_id, no text) stay as they are. All columns are kept, whatever
    their names. Ties, long texts and empty tables are as in `duplicates`.
    """
    kept = keep_rows(docs, duplicates(docs, radius).select("doc_id"))
    rep = fresh(docs, "__rep")
    repeated = small(docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(rep)))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, F.col("doc_id") == F.col(rep), "left_anti")
    again = kept.join(repeated, F.col("doc_id") == F.col(rep), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`duplicates` over the whole table `documents`."""
    return duplicates(table(spark, sf_dir, "documents"))
