"""Operator 7: bounded-space online best-fit packing of token pieces into fixed-length sequences.

Pieces arrive in order. A fixed number of bins is open; a bitset has bit f set while
an open bin has f free places, so the fullest bin that still takes a piece is the
lowest set bit at or above its length. When no bin takes it and all are open, the
fullest closes first. Each packing task takes a bounded share of the pieces (dealt by a
hash, so no source or key can fill one task) and wastes at most its open bins.

Defined results: a null or empty text is its end token alone; longer documents are cut
into pieces of the full length; repeated rows are packed each for itself; an empty table
gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.words import PieceCache, slices
from orrery.runtime import materialize, table

#: Pieces that one packing task takes, and the bins it keeps open.
PIECES_A_TASK, OPEN_BINS = 250_000, 2048
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 4_000_000


@lru_cache(maxsize=4)
def cache(path: str) -> PieceCache:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def encode(words: list[str]) -> list[list[int]]:
        """In small batches: an encoding takes far more memory than its ids."""
        return [e.ids for at in range(0, len(words), 4096) for e in t.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]

    return PieceCache(encode)


def pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most `length`.

    Returns id_col, piece int, start long, length long, ids_crc32 long (of the ids as
    little-endian unsigned 32-bit numbers) and, if asked for, ids array<int>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache(path)
        for batch in batches:
            for first, part in slices(batch.column(1), TEXT_BYTES):
                ids, bounds = known.tokens(part)
                sizes = np.diff(bounds) + 1
                flat = np.full(int(sizes.sum()), end_id, "<u4")
                ends = np.cumsum(sizes)
                body = np.ones(len(flat), bool)
                body[ends - 1] = False
                flat[body] = ids
                n = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(length, sizes[row] - start)
                at = (ends - sizes)[row] + start
                raw = memoryview(flat).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + s)]) for a, s in zip(at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
                columns = [batch.column(0).slice(first, len(part)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)]
                if with_ids:  # the pieces follow each other in `flat`
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {read.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class BestFit:
    """Online best-fit with at most `most` open bins of `capacity` places."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # the bitset
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `size` <= capacity."""
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            to = self.take(room)
        else:
            if self.open == self.most:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            room, to = self.capacity, self.made
            self.made += 1
        if room > size:
            self.bins[room - size].append(to)
            self.free |= 1 << (room - size)
            self.open += 1
        return to, self.capacity - room

    def take(self, room: int) -> int:
        to = self.bins[room].pop()
        if not self.bins[room]:
            self.free ^= 1 << room
        self.open -= 1
        return to


def pack(found: DataFrame, length: int = 2048, id_col: str = "doc_id", open_bins: int = OPEN_BINS, task: int = PIECES_A_TASK) -> DataFrame:
    """Place pieces (id_col, piece, length, ...) of at most `length` into sequences.

    Adds sequence_id long and offset long, in place of columns of these names. `found` is counted
    first; give it materialised.
    """
    found = found.drop("sequence_id", "offset")
    parts = max(1, -(-found.count() // task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, fit = TaskContext.get().partitionId(), BestFit(length, open_bins)
        for batch in batches:
            placed = [fit.place(s) for s in batch.column("length").to_pylist()]
            bins = np.fromiter((p[0] for p in placed), np.int64, len(placed)) * parts + part
            offsets = np.fromiter((p[1] for p in placed), np.int64, len(placed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins), pa.array(offsets)], [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    # the order is fixed, so a task that is run again places every piece as before
    dealt = found.repartition(parts, F.xxhash64(id_col, "piece", *(c for c in ("ids_crc32",) if c in found.columns)))
    return dealt.sortWithinPartitions(F.xxhash64(id_col, "piece"), id_col, "piece", "length").mapInArrow(run, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(materialize(found, "pieces"))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
