"""Operator 5: exact n-gram Jaccard join by T-occurrence search with DivideSkip.

Every document is the set of its distinct word shingles, every shingle has an inverted
list of documents. A document y links to x when it occurs on at least T lists of x.
DivideSkip splits x's lists into short and long ones: y must occur on a short one often
enough, so only short lists are merged, and long ones are probed for what is left.

* Across the cluster the long lists of x are its T - 1 most frequent shingles. They are
  never written; only the other n - T + 1 short lists are dealt out and merged (every
  occurrence counts). Frequency comes from a sketch of fixed size over all documents; any
  order is exact, this one keeps shared passages and boilerplate on the long side.
* Each merged list names candidates. Bitmaps of the sets' parities, as many bits as
  shingles, bound the difference of two sets from below; they drop most candidates that
  only share a passage, and nothing else.
* What is left is looked up in whole sets. A query's candidates meet its whole set in a bounded
  task, where the inverted lists over these candidates are divided again: short ones are
  merged as sorted runs, candidates below T - L drop out, and the L long ones are probed by
  binary search.

Equal sets are one entry from the start. Groups of near copies cost their size, not its
square: first each list links its members to a few pivots, the links' components are
found, and only then pairs of one list that are still in different components are tested.
Components are exact; the links that come with them are a spanning subset, as pairs over the
threshold whose ends are already in one component are not tested. `join` tests these too: all
links between different sets, and each document's number of links. Its work and output grow
with the links, so with the square of a group of different near copies.

Sets are told apart by 128 bits of hash. What is dealt to a task is bounded by TASK_BYTES of
postings and TASK_ROWS of rows on average, so tasks grow in number and not in size.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle are one shingle; repeated rows are equal sets; texts
are read whole; an empty table gives an empty table; other columns are not read. A null
id keeps its row; as a component's smallest id it counts last.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.components import components
from orrery.llm.shingles import GOLDEN, mix, shingle_hashes
from orrery.llm.words import release
from orrery.runtime import materialize, shuffle_partitions, table

#: Counters of the frequency sketch and bits of the candidate filter: fixed sizes, broadcast.
COUNTERS, FILTER_BITS, CHUNKS, FAN_IN = 1 << 22, 1 << 27, 64, 256
#: Bytes of postings, and rows of pairs or of blocks, that a task is dealt.
TASK_BYTES, TASK_ROWS = 64_000_000, 100_000
#: Candidates that one task tests against one query's set at a time.
BLOCK = 256
#: Members of each list that all others are paired with at first; members from which on a list's remaining pairs are searched in blocks.
PIVOTS, LONG = 8, 64


def sets(texts: pa.Array, size: int, clash: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes ascending and distinct within each text, bounds, name of each set, further 64 bits of it).

    Sets are named by 64 bits; where a name is among those that unequal sets share (`clash`,
    ascending) the further bits are folded in.
    """
    for first, h, bounds in shingle_hashes(texts, size):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[bounds[:-1][bounds[:-1] < len(h)]] = True
        bounds = np.concatenate([[0], np.cumsum(new)])[bounds]
        h = h[new]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
        more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + GOLDEN))])
        fp = mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
        other = mix(more[bounds[1:]] - more[bounds[:-1]]).view(np.int64)
        if clash is not None and len(clash):
            fp = np.where(np.isin(fp, clash), fp ^ other, fp)
        yield first, h, bounds, fp, other


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of the ranges of a numpy array."""
    offsets = pa.array(bounds * data.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def parities(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A bitmap of each set, of the first power of two of bits from its size on: a bit is the parity of the hashes that fall on it."""
    n = np.maximum(64, np.diff(bounds))
    width = (1 << np.ceil(np.log2(n)).astype(np.int64)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    row = np.repeat(np.arange(len(width)), np.diff(bounds))
    at = base[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    return blobs(np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(bool)), base // 8)


def apart(x: bytes, y: bytes) -> int:
    """The number of bits in which two parity bitmaps differ, the larger one folded: at most the size of the symmetric difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)))
    elif len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)))
    return int(np.bitwise_count(a ^ b).sum())


def near(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose parities leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(k)) for k in (2, 4))
            room = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
            keep = [apart(x, y) <= r for x, y, r in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), room.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(one.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = with_a.join(one.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    return both.select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(run, "a long, b long")


def block_pairs(members: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components, of long lists' members (token, fp, root), that share a list and whose parities leave room for a link.

    Lists that share members are one cluster. Its largest component is one side, all others
    the other: the latter meet each other and the former, in blocks of BLOCK documents, so
    what is dealt grows with the cluster times the blocks that are not linked yet. Within a
    pair of blocks one matrix product tells which documents share a list, and only those are
    compared; no pair is written that the bitmaps rule out.
    """
    # a list is a node of its own beside its members, so no list's members are joined by it
    clusters = components(members.select(F.col("token").alias("a"), F.col("fp").alias("b")))
    docs = members.groupBy("fp", "root").agg(F.collect_set("token").alias("tokens")).join(clusters.select(F.col("node").alias("fp"), F.col("root").alias("k")), "fp")
    docs = materialize(docs.join(one.select("fp", "n", "bits"), "fp"), "cluster")
    sizes = docs.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.groupBy("k").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all")).select("k", F.col("top.root").alias("major"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("n_major"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("n_minor")).where("n_minor > 0")
    each = docs.join(shape, "k").withColumn("is_major", F.col("root") == F.col("major"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("is_major"), F.col("n_major")).otherwise(F.col("n_minor"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    against = F.transform(upto("n_minor"), lambda m: at(1, m, F.col("own"), F.lit(1)))
    among = F.transform(upto("n_minor"), lambda m: at(0, F.least(m, F.col("own")), F.greatest(m, F.col("own")), F.col("own") > m))
    over = F.transform(upto("n_major"), lambda m: at(1, F.col("own"), m, F.lit(0)))
    keys = F.when(F.col("is_major"), against).otherwise(F.concat(among, over))
    rows = each.withColumn("own", own).withColumn("key", F.explode(keys)).select("k", "key.kind", "key.i", "key.j", "key.side", "fp", "root", "n", "bits", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> list[tuple[int, int]]:
            if key is None:
                return []
            inside = key[1] == 0 and key[2] == key[3]
            left = held if inside else [h for h in held if h[0] == 0]
            right = held if inside else [h for h in held if h[0] == 1]
            out = meeting(left, right, inside, percent) if left and right else []
            held.clear()
            return out

        for batch in batches:
            out = []
            for k, kind, i, j, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, kind, i, j) != key:
                    out += flush()
                    key = k, kind, i, j
                held.append(doc)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        if out := flush():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    # a pair of blocks is about BLOCK rows, more in clusters of one block
    parts = max(shuffle_partitions(members.sparkSession), -(-docs.count() // TASK_ROWS))
    return rows.repartition(parts, "k", "kind", "i", "j").sortWithinPartitions("k", "kind", "i", "j", "side", "fp").mapInArrow(run, "a long, b long")


def meeting(left: list, right: list, inside: bool, percent: int) -> list[tuple[int, int]]:
    """Those pairs of documents (side, fp, root, n, bits, tokens) in different components that share a token and may link."""
    tokens = {t: k for k, t in enumerate(sorted({t for d in left for t in d[5]} & {t for d in right for t in d[5]}))}

    def matrix(docs: list) -> np.ndarray:
        out = np.zeros((len(docs), len(tokens)), np.float32)
        for r, d in enumerate(docs):
            out[r, [tokens[t] for t in d[5] if t in tokens]] = 1
        return out

    n, m = (np.array([d[3] for d in side], np.int64) for side in (left, right))
    ok = matrix(left) @ matrix(right).T > 0
    ok &= np.array([d[2] for d in left])[:, None] != np.array([d[2] for d in right])[None, :]
    ok &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    if inside:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    if not len(x):
        return []
    both = n[x] + m[y]
    room = both - 2 * -(-percent * both // (100 + percent))
    # bitmaps of one width at a time: the wider of a pair is folded to it
    a_bits, b_bits = ([np.frombuffer(d[4], np.uint64) for d in side] for side in (left, right))
    width = np.minimum(np.array([len(b) for b in a_bits])[x], np.array([len(b) for b in b_bits])[y])
    keep = np.zeros(len(x), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        rows, x_at = np.unique(x[at], return_inverse=True)
        cols, y_at = np.unique(y[at], return_inverse=True)
        a = np.stack([np.bitwise_xor.reduce(a_bits[r].reshape(-1, w)) for r in rows])
        b = np.stack([np.bitwise_xor.reduce(b_bits[c].reshape(-1, w)) for c in cols])
        step = max(1, 4_000_000 // w)
        for k in range(0, len(at), step):
            part = slice(k, k + step)
            keep[at[part]] = np.bitwise_count(a[x_at[part]] ^ b[y_at[part]]).sum(axis=1) <= room[at[part]]
    return [(min(left[i][1], right[j][1]), max(left[i][1], right[j][1])) for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True)]


def profile(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, fp and other of the set, parities in blob) of every document, and per task the compressed counters of its shingles (chunk >= 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["id", "n", "fp", "other", "chunk", "blob"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for first, h, bounds, fp, other in sets(batch.column(1), size):
                np.add.at(counts, (h >> np.uint64(42)).astype(np.int64), np.uint32(1))
                k = len(fp)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k), pa.array(np.diff(bounds)), pa.array(fp), pa.array(other), pa.array(np.full(k, -1, np.int32)), parities(h, bounds)], names)
        if kind is not None:
            each = COUNTERS // CHUNKS
            made = [zlib.compress(counts[c * each : (c + 1) * each].tobytes(), 1) for c in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, kind), *(pa.nulls(CHUNKS, pa.int64()) for _ in range(3)), pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(made, pa.binary())], names)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, fp long, other long, chunk int, blob binary")


def frequency(profiled: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters, as a 12-bit logarithm: COUNTERS numbers, however large the corpus.

    The tasks' counters are added as a tree: no task adds more than about FAN_IN of a chunk.
    """
    each = COUNTERS // CHUNKS

    def adder(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if c not in sums:
                        sums[c] = np.zeros(each, np.uint64)
                    sums[c] += np.frombuffer(zlib.decompress(blob), np.uint32)
            for c, s in sums.items():
                q = np.minimum(4095, np.round(120 * np.log2(1 + s.astype(float)))).astype(np.uint16) if last else np.minimum(s, 2**32 - 1).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(q.tobytes(), 1)], pa.binary())], ["chunk", "blob"])

        return run

    counted = profiled.where("chunk >= 0").select("chunk", "blob")
    many = -(-counted.count() // CHUNKS)  # of each chunk
    while many > FAN_IN:
        many = -(-many // FAN_IN)
        dealt = counted.withColumn("group", F.pmod(F.xxhash64("blob"), F.lit(many))).repartition(CHUNKS * many, "chunk", "group").select("chunk", "blob")
        counted = materialize(dealt.mapInArrow(adder(False), "chunk int, blob binary"), "counters")
    out = np.zeros(COUNTERS, np.uint16)
    for c, blob in counted.repartition("chunk").mapInArrow(adder(True), "chunk int, blob binary").collect():
        out[c * each : (c + 1) * each] = np.frombuffer(zlib.decompress(blob), np.uint16)
    return out


POSTING = np.dtype([("token", "<u8"), ("fp", "<i8"), ("n", "<i4"), ("at", "<i4")])


def postings(docs: DataFrame, size: int, percent: int, seen: Broadcast, clash: Broadcast, parts: int) -> DataFrame:
    """The short lists' entries, packed: (part, blob of POSTING). Equal sets of a slice are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = seen.value
        for batch in batches:
            for _, h, bounds, fp, _ in sets(batch.column(1), size, clash.value):
                token = (rank[(h >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
                n = np.diff(bounds)
                first = np.zeros(len(n), bool)
                first[np.unique(fp, return_index=True)[1]] = True
                rows = np.flatnonzero(first & (n > 0))
                if not len(rows):
                    continue
                for r in rows.tolist():
                    token[bounds[r] : bounds[r + 1]].sort()
                short = n[rows] + (-percent * n[rows]) // 100 + 1  # n - T + 1, T = ceil(percent * n / 100)
                at = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
                out = np.zeros(len(at), POSTING)
                out["token"] = token[np.repeat(bounds[rows], short) + at]
                out["fp"], out["n"], out["at"] = np.repeat(fp[rows], short), np.repeat(n[rows], short), at
                part = (mix(out["token"]) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                out, part = out[order], part[order]
                to = np.searchsorted(part, np.arange(parts + 1))
                kept = np.flatnonzero(np.diff(to))
                yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), blobs(out, to).take(pa.array(kept))], ["part", "blob"])

    return docs.mapInArrow(run, "part int, blob binary")


def lists(dealt: DataFrame, percent: int) -> DataFrame:
    """Inverted lists of at least two different sets, one row (token, fp, n, at) a member; and rows (fp, mid) of candidate pairs.

    Each list pairs its members with PIVOTS of them, those of the smallest hash of their
    fingerprint under different seeds, so lists of one group of near copies mostly agree on
    them and the pairs grow with the members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "fp", "n", "at", "mid"]
        raw = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not raw:
            return
        p = np.frombuffer(b"".join(raw), POSTING)
        del raw
        release()
        p = p[np.argsort(p["token"], kind="stable")]
        same = p["token"][1:] == p["token"][:-1]
        both = np.zeros(len(p), bool)
        both[1:] |= same
        both[:-1] |= same
        p = p[both]
        p = p[np.lexsort((p["fp"], p["token"]))]
        new = np.ones(len(p), bool)
        new[1:] = (p["token"][1:] != p["token"][:-1]) | (p["fp"][1:] != p["fp"][:-1])
        p = p[new]
        starts = np.flatnonzero(np.concatenate([[True], p["token"][1:] != p["token"][:-1]])) if len(p) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(p)))
        p = p[np.repeat(sizes > 1, sizes)]
        sizes = sizes[sizes > 1]
        if not len(p):
            return
        starts, which = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(p), 50_000):
            q = p[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (q["token"].view(np.int64).copy(), q["fp"], q["n"], q["at"])), pa.nulls(len(q), pa.int64())], names)
        found = np.zeros((0, 2), np.int64)
        for r in range(PIVOTS):
            seed = np.uint64(((r + 1) * int(GOLDEN)) % 2**64)
            order = np.lexsort((mix(p["fp"].view(np.uint64) + seed), which))
            m = p[np.repeat(order[starts], sizes)]
            n1, n2 = p["n"].astype(np.int64), m["n"].astype(np.int64)
            rest = np.minimum(n1 - p["at"], n2 - m["at"])
            ok = (p["fp"] != m["fp"]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * rest >= percent * (n1 + n2))
            pairs = np.stack([np.minimum(p["fp"][ok], m["fp"][ok]), np.maximum(p["fp"][ok], m["fp"][ok])], axis=1)
            found = np.unique(np.concatenate([found, pairs]), axis=0)
            del seed, order, m, n1, n2, rest, ok, pairs
        for a in range(0, len(found), 50_000):
            q = found[a : a + 50_000]
            none = pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(q[:, 0]), pa.nulls(len(q), pa.int32()), pa.nulls(len(q), pa.int32()), pa.array(q[:, 1])], names)
        del p, starts, sizes, which, found
        release()

    return dealt.mapInArrow(run, "token long, fp long, n int, at int, mid long")


def may_link(percent: int, n1: str, at1: str, n2: str, at2: str):
    """Whether two members of one list can reach the overlap, were this the first list they share."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    rest = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return (100 * least >= percent * most) & ((100 + percent) * rest >= percent * (F.col(n1) + F.col(n2)))


def divide_skip(query: np.ndarray, found: list[np.ndarray], percent: int) -> np.ndarray:
    """Of the sets `found` (ascending hashes), those whose Jaccard similarity with `query` is at least percent / 100."""
    sizes = np.array([len(f) for f in found])
    need = -(-percent * (len(query) + sizes) // (100 + percent))  # T for each candidate
    least = int(need.min())
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    slot = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    on = query[slot] == flat
    order = np.argsort(slot[on], kind="stable")  # the inverted lists of the query's shingles, members ascending
    member = owner[on][order]
    length = np.bincount(slot[on], minlength=len(query))
    start = np.cumsum(length) - length
    longest = max(2, int(length.max(initial=0)))
    n_long = min(least - 1, int(least / (np.log2(longest) + 1)))
    by_length = np.argsort(length, kind="stable")
    is_long = np.zeros(len(query), bool)
    is_long[by_length[len(query) - n_long :]] = True
    short = np.repeat(~is_long, length)
    merged = np.sort(member[short], kind="stable")  # a merge of sorted runs
    count = np.bincount(merged, minlength=len(found))
    left = np.flatnonzero(count >= need - n_long)
    for k in np.flatnonzero(is_long):
        if not len(left):
            break
        own = member[start[k] : start[k] + length[k]]
        if len(own):
            place = np.minimum(np.searchsorted(own, left), len(own) - 1)
            count[left[own[place] == left]] += 1
    return left[count[left] >= need[left]]


def verify(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct candidate pairs (a, b) that link, through their whole sets (fp, blob)."""
    blocks = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).select("a", F.ceil(F.col("k") / BLOCK).cast("int").alias("k"))
    queries = blocks.join(whole, blocks["a"] == whole["fp"]).select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "blob")
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "k").cast("int").alias("block"))
    members = dealt.join(whole, dealt["b"] == whole["fp"]).select("a", "block", "b", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, held = None, None, []

        def flush() -> list[tuple[int, int]]:
            hit = divide_skip(query, [h[1] for h in held], percent) if query is not None and held else []
            out = [(key[0], held[i][0]) for i in hit]
            held.clear()
            return out

        for batch in batches:
            out = []
            for a, block, b, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, block) != key:
                    out += flush()
                    key, query = (a, block), None
                if b is None:
                    query = np.frombuffer(blob, np.uint64)
                else:
                    held.append((b, np.frombuffer(blob, np.uint64)))
                    if len(held) == BLOCK:
                        out += flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        if out := flush():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    both = queries.union(members.select("a", "block", "b", "blob"))
    parts = max(shuffle_partitions(pairs.sparkSession), -(-pairs.count() // TASK_ROWS))
    return both.repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, needed: DataFrame, size: int, clash: Broadcast) -> DataFrame:
    """(fp, blob) of each needed set. A filter of fixed size passes over the texts; an exact join follows."""
    spark, words = docs.sparkSession, FILTER_BITS // 64
    each = words // CHUNKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            row = np.asarray(batch.column(0)).view(np.uint64) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(packed, (row >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (row & np.uint64(7)).astype(np.uint8))
        packed = packed.reshape(CHUNKS, -1)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(packed[c].tobytes(), 1) for c in used], pa.binary())], ["chunk", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, np.zeros(8 * each, np.uint8)) | np.frombuffer(zlib.decompress(blob), np.uint8)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(s.tobytes(), 1)], pa.binary())], ["chunk", "blob"])

    packed = np.zeros((CHUNKS, 8 * each), np.uint8)
    marks = needed.select(F.col("row")).coalesce(max(1, min(64, shuffle_partitions(spark) // 4))).mapInArrow(mark, "chunk int, blob binary")
    for c, blob in marks.repartition(CHUNKS, "chunk").mapInArrow(merge, "chunk int, blob binary").collect():
        packed[c] = np.frombuffer(zlib.decompress(blob), np.uint8)
    seen = spark.sparkContext.broadcast(packed.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in batches:
            row = np.asarray(batch.column(2)).view(np.uint64) % np.uint64(FILTER_BITS)
            hit = (bits[(row >> np.uint64(3)).astype(np.int64)] >> (7 - (row & np.uint64(7))).astype(np.uint8)) & 1
            if hit.any():
                for _, h, bounds, fp, _ in sets(batch.column(1).filter(pa.array(hit.astype(bool))), size, clash.value):
                    yield pa.RecordBatch.from_arrays([pa.array(fp), blobs(h, bounds)], ["fp", "blob"])

    made = docs.mapInArrow(run, "fp long, blob binary")
    return made.join(needed.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def links_and_classes(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents with id_col, n_shingles, fp (of the set), component_id; links (a, b) between sets by fp.

    The links are a spanning subset of the join: copies are not expanded, and pairs of one
    component that are linked already are not tested unless `complete`.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("row"))
    profiled = materialize(profile(read.select("id", "text"), size), "profile")
    rows = profiled.where("chunk < 0").select("id", "n", "fp", "other")
    named_once = rows.where("n > 0").groupBy("fp").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("fp")
    # names that unequal sets share: about the square of the sets' number over 2^65, so a handful however large the corpus
    shared = sorted(r["fp"] for r in named_once.collect())
    clash = spark.sparkContext.broadcast(np.array(shared, np.int64))
    real = F.when(F.col("fp").isin(shared), F.col("fp").bitwiseXOR(F.col("other"))).otherwise(F.col("fp")) if shared else F.col("fp")
    rows = rows.withColumn("fp", real).drop("other")
    one = profiled.where("chunk < 0 and n > 0").withColumn("fp", real).groupBy("fp").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("blob").alias("bits"))
    one = materialize(one, "one")
    short = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-int(short) * POSTING.itemsize // TASK_BYTES))
    seen = spark.sparkContext.broadcast(frequency(profiled))
    made = materialize(lists(postings(read.select("id", "text"), size, percent, seen, clash, parts).repartitionById(parts, F.col("part")), percent), "lists")
    found = made.where("mid IS NULL").drop("mid")

    def linked(left: DataFrame) -> DataFrame:
        """Those of the pairs that link, by their whole sets."""
        ends = left.select(F.col("a").alias("fp")).union(left.select(F.col("b").alias("fp"))).distinct()
        needed = materialize(ends.join(one, "fp").select("fp", F.xxhash64("id").alias("row")), "needed")
        return materialize(verify(left, materialize(whole_sets(read, needed, size, clash), "sets"), percent), "links")

    none = spark.createDataFrame([], "a long, b long")
    first = none if complete else materialize(made.where("mid IS NOT NULL").select(F.col("fp").alias("a"), F.col("mid").alias("b")).distinct(), "first")
    links = none if complete else linked(materialize(near(first, one, percent), "near"))
    known = materialize(components(links), "known")

    # lists with members that are in different components after that
    member = found.join(known.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "at", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    mixed = member.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")).where((F.col("lo") != F.col("hi")) & (F.col("k") > (1 if complete else 2))).select("token", "k")
    open_ = materialize(member.join(mixed, "token"), "open")
    short = open_.where(F.col("k") <= LONG)
    left, right = short.alias("x"), short.alias("y")
    cross = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")))
    cross = cross.where(may_link(percent, "x.n", "x.at", "y.n", "y.at")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    dense = block_pairs(open_.where(F.col("k") > LONG).select("token", "fp", "root"), one, percent)
    untested = lambda pairs: pairs if complete else pairs.join(first, ["a", "b"], "left_anti")
    second = materialize(near(untested(cross), one, percent).union(untested(dense)).distinct(), "second")
    links = links.union(linked(second))
    known = materialize(components(links), "known")

    named = one.select("fp", "id").join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    out = rows.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "fp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out, links


def join(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): the documents of `links_and_classes` with n_links, and all links (a, b) between different sets by fp.

    n_links counts the other documents at the threshold or above, copies of the document included.
    """
    out, links = links_and_classes(docs, size, percent, id_col, text_col, complete=True)
    out, links = materialize(out, "documents"), links.distinct()
    copies = out.where("n_shingles > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    both = links.union(links.select("b", "a"))
    others = both.join(copies, both["b"] == copies["fp"]).groupBy("a").agg(F.sum("copies").alias("others"))
    counted = copies.join(others, copies["fp"] == others["a"], "left").select("fp", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return out.join(counted, "fp", "left").withColumn("n_links", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0)), links


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = links_and_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE: dict[str, str] = {}
