"""Operator 3: exact top-k inner products over norm-sorted blocks.

Vectors are dealt to ranges of descending length and packed into blocks. Queries are
packed into blocks as well; a query set is stated by the caller. Every query block first
meets the block of the longest vectors, which gives each query a result (score, id) to beat; by
Cauchy-Schwarz no block whose longest vector times the query's length stays below it can
hold a result, so only the blocks before that one are joined. They are dealt to groups of
about GROUP blocks, each in descending order of length: what a group has found raises
its result to beat, and an equal score needs a smaller id. Inside a block, vectors are
rotated by the singular vectors of all vectors' second moments: the first coordinates hold
most of a product, and |rest of q| * |rest of x| bounds the others. Survivors are scored
exactly. A block is bounded, so is a group's work.

Components are turned to integers, floor(scale * x); sums of products are exact in double
precision below 2^53 and in 64 bits beyond, up to 2^63. Vectors of a table are meant to have one
length: shorter ones are filled up to the longest. Defined results: vectors that are null or hold a null or non-finite component
take no part; rows that repeat an id count once, with the smallest vector; a missing
component counts as 0; ties go to the smaller id; fewer than k candidates are all
returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.runtime import materialize, shuffle_partitions, table

#: Vectors in a block of candidates and of queries; rotated coordinates in the partial sums.
BLOCK, QUERIES_A_BLOCK, HEAD = 2048, 512, 16
#: Blocks that one group of a query block meets one after another.
GROUP = 32


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, norm) of every vector that takes part."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    clean = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(clean & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    one = rows.groupBy("id").agg(F.min("v").alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))


def padded(rows: pa.Array, width: int) -> np.ndarray:
    """The lists as a matrix of doubles, short ones filled with 0."""
    bounds = np.asarray(rows.offsets, np.int64)
    flat = np.asarray(rows.values.slice(bounds[0], bounds[-1] - bounds[0])).astype(float)
    sizes = np.diff(bounds)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], sizes)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from width x width sums of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = padded(batch.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("v").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((width, width))
    for i, j, x in sums:
        gram[i, j] = x
    return np.linalg.svd(gram)[2]


def blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows packed in descending order of length: (block, most, ids binary, vectors binary); block ids ascend as lengths descend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, ids, vs, k = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            v = np.concatenate(vs)
            most = float(np.sqrt((v * v).sum(1).max(initial=0)))
            return pa.RecordBatch.from_arrays([pa.array([at + k]), pa.array([most]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["block", "most", "ids", "vs"])

        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                i, v = np.asarray(part.column(0)), padded(part.column(1), width)
                room = size - sum(map(len, ids))
                ids.append(i[:room])
                vs.append(v[:room])
                if len(i) >= room:
                    yield out()
                    k, ids, vs = k + 1, [i[room:]], [v[room:]]
        if sum(map(len, ids)):
            yield out()

    parts = max(1, min(shuffle_partitions(rows.sparkSession), -(-rows.count() // size)))
    dealt = rows.repartitionByRange(parts, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
    return dealt.select("id", "v").mapInArrow(run, "block long, most double, ids binary, vs binary")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def scored(pairs: DataFrame, width: int, k: int, turn: np.ndarray) -> DataFrame:
    """Each query's best k of the blocks of its group, of those better than its result to beat: (query_id, vec_id, score).

    Rows (q_block, part, block, q_ids, q_vs, q_beat, q_beat_id, ids, vs) are sorted by the first
    three. A group (q_block, part) meets its blocks in descending order of length, and what it
    has found so far raises the result to beat for the blocks after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            if best:
                found = [(np.full(len(i), q), i, s) for q, (s, i) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for q_block, part, _, q_ids, q_vs, q_beat, q_beat_id, ids, vs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q_block, part) != key:
                    yield from out()
                    key, best = (q_block, part), {}
                    qi, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vs).reshape(-1, width)
                    beat = np.frombuffer(q_beat).copy() if q_beat is not None else np.full(len(qi), -np.inf)
                    beat_id = np.frombuffer(q_beat_id, np.int64).copy() if q_beat_id is not None else np.full(len(qi), np.iinfo(np.int64).max)
                    qr = q @ turn.T
                    q_rest, q_most = np.sqrt((qr[:, HEAD:] ** 2).sum(1)), np.abs(q).max(initial=0)
                ci, c = np.frombuffer(ids, np.int64), np.frombuffer(vs).reshape(-1, width)
                cr = c @ turn.T
                bound = qr[:, :HEAD] @ cr[:, :HEAD].T + np.outer(q_rest, np.sqrt((cr[:, HEAD:] ** 2).sum(1)))
                live = bound + 1e-6 * (1 + np.abs(bound)) >= beat[:, None]
                live &= qi[:, None] != ci[None, :]
                # sums of products are whole numbers: exact in doubles below 2**53, in 64 bits beyond
                whole = q_most * np.abs(c).max(initial=0) * width >= 2**52
                for r in np.flatnonzero(live.any(axis=1)):
                    at = np.flatnonzero(live[r])
                    s = c[at].astype(np.int64) @ q[r].astype(np.int64) if whole else (c[at] @ q[r]).astype(np.int64)
                    ok = (s > beat[r]) | ((s == beat[r]) & (ci[at] < beat_id[r]))
                    s, i = s[ok], ci[at[ok]]
                    if not len(s):
                        continue
                    query = int(qi[r])
                    if query in best:
                        s, i = np.concatenate([best[query][0], s]), np.concatenate([best[query][1], i])
                    top = best_of(s, i, k)
                    best[query] = s[top], i[top]
                    if len(top) == k:
                        beat[r], beat_id[r] = s[top[-1]], i[top[-1]]
        yield from out()

    return pairs.select("q_block", "part", "block", "q_ids", "q_vs", "q_beat", "q_beat_id", "ids", "vs").mapInArrow(run, "query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score: each query's k highest integer inner products among all other vectors.

    `queries` is a condition on id_col, written for a column named id_col.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, id_col, vector_col, scale), "vectors")
    width = max(HEAD, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    turn = rotation(rows, width)
    packed = materialize(blocks(rows, width, BLOCK), "blocks")
    asked = rows.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    q = materialize(blocks(asked, width, QUERIES_A_BLOCK), "queries").select(F.col("block").alias("q_block"), F.col("most").alias("q_most"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    first = packed.agg(F.min("block")).first()[0]
    if first is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    # one block of a bounded size against every query block
    start = packed.where(F.col("block") == first).select("block", "ids", "vs")
    none = F.lit(None)
    met = q.withColumn("block", F.lit(first)).join(F.broadcast(start), "block").select("*", F.lit(0).alias("part"), none.cast("binary").alias("q_beat"), none.cast("binary").alias("q_beat_id"))
    begun = materialize(scored(met.repartition("q_block").sortWithinPartitions("q_block"), width, k, turn), "begun")
    # the k-th result so far: a later one needs a higher score, or the same and a smaller id
    kth = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("back"))).alias("m")).where(F.col("n") >= k).select("query_id", F.col("m.score").alias("least"), (-F.col("m.back")).alias("least_id"))

    def with_beat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for block, ids, vs, query, least, least_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids is not None:
                    held.setdefault(block, [None, {}])[0] = (ids, vs)
                else:
                    held.setdefault(block, [None, {}])[1][query] = (least, least_id)
        for block, (own, beat) in held.items():
            ids = np.frombuffer(own[0], np.int64)
            v = np.frombuffer(own[1]).reshape(-1, width)
            most = np.iinfo(np.int64).max
            least = np.array([beat.get(i, (-np.inf, most))[0] for i in ids.tolist()], float)
            least_id = np.array([beat.get(i, (-np.inf, most))[1] for i in ids.tolist()], np.int64)
            size = np.sqrt((v * v).sum(1))
            # the shortest a vector may be to reach the score of one of the block's queries
            need = np.where(least > 0, least / np.maximum(size, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([float(need.min())]), *(pa.array([x], pa.binary()) for x in (own[0], own[1], least.tobytes(), least_id.tobytes()))], ["q_block", "need", "q_ids", "q_vs", "q_beat", "q_beat_id"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i)], ["q_block", "query_id"])

    where = q.select("q_block", "q_ids").mapInArrow(unpack, "q_block long, query_id long").join(kth, "query_id")
    both = q.select("q_block", "q_ids", "q_vs", none.cast("long").alias("query_id"), none.cast("long").alias("least"), none.cast("long").alias("least_id")).union(where.select("q_block", none.cast("binary"), none.cast("binary"), "query_id", "least", "least_id"))
    ready = materialize(both.repartition("q_block").mapInArrow(with_beat, "q_block long, need double, q_ids binary, q_vs binary, q_beat binary, q_beat_id binary"), "ready")
    # pairs of block names first: a query block and the blocks whose longest vector is long enough,
    # dealt to groups of GROUP blocks of nearly the same lengths as the first ones
    names = ready.select("q_block", "need").join(packed.where(F.col("block") != first).select("block", "most"), F.col("most") * (1 + 1e-9) >= F.col("need"))
    n_blocks = packed.count()
    names = names.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // GROUP))).cast("int"))
    pairs = names.join(packed.select("block", "ids", "vs"), "block").join(ready.select("q_block", "q_ids", "q_vs", "q_beat", "q_beat_id"), "q_block")
    parts = max(shuffle_partitions(spark), -(-n_blocks * ready.count() // GROUP // 4))
    found = begun.union(scored(pairs.repartition(parts, "q_block", "part").sortWithinPartitions("q_block", "part", "block"), width, k, turn))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op3_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_top_inner_products": op3_top_inner_products}
ORACLE = {
    "op3_top_inner_products": """
WITH flat AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM flat WHERE e IS NULL OR isnan(e) OR isinf(e)),
v AS (SELECT vec_id, i, floor(64 * CAST(e AS DOUBLE))::BIGINT AS q FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, sum(a.q * b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
