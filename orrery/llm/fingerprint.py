"""Operator 2: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (non-blank lines, without the white space
around them). Every paragraph has a wide hashed vector, and a document's fingerprint is
their sum, lane by lane modulo a power of two, so the paragraphs' order doesn't count and
a paragraph is inserted or deleted by adding or subtracting its vector.

* 8 lanes modulo 2^64, from four 128-bit hashes of the whole paragraph under seeds of their
  own: equality of multisets.
* LANES lanes modulo 2^16: each run of three words of the paragraph (with its number, where the
  paragraph repeats it) adds +1 or -1 to one lane. These sums keep inner products, so with
  x and y the counts of two documents' numbered runs their likeness is read as
  xy / (xx + yy - xy), which is |A and B| / |A or B| of the multisets where no paragraph is
  repeated within a document. The standard error of xy is about sqrt(xx * yy / LANES).

Defined results: a null or empty text is the empty multiset (all lanes 0) and is fully
like another one; texts are read whole; repeated rows are rows of their own; equal ids are
in the order of their texts and a null id comes last; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.shingles import GOLDEN, mix, shingle_hashes
from orrery.llm.words import slices
from orrery.runtime import shuffle_partitions, table

WIDE, LANES, RUN = 8, 512, 3
#: Texts that are summed at a time (LANES counters each).
ROWS = 2048


def numbered(h: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """The hashes of runs, those that their paragraph repeats changed by their number in it."""
    key = h ^ mix(paragraph)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.arange(len(h))
    nth = np.zeros(len(h), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(nth > 0, mix(h + nth * GOLDEN), h)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(wide, lanes): uint64[rows, WIDE] and int16[rows, LANES] sums over each text's paragraphs."""
    wide, lanes = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), LANES), np.int16)
    for at in range(0, len(texts), ROWS):
        for first, part in slices(texts.slice(at, ROWS)):
            lists = pc.split_pattern(part, "\n")
            bounds = np.asarray(lists.offsets, np.int64)
            flat = pc.utf8_trim_whitespace(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
            row = np.repeat(np.arange(len(part)), np.diff(bounds))
            keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
            flat, row = flat.filter(pa.array(keep)), row[keep]
            rows = slice(at + first, at + first + len(part))
            if not len(row):
                continue
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            paragraphs = flat.cast(pa.large_binary()).to_pylist()
            for k in range(WIDE // 2):
                raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, k + 1) for p in paragraphs]), "<u8").reshape(-1, 2)
                wide[at + first + row[starts], 2 * k : 2 * k + 2] = np.add.reduceat(raw, starts, axis=0)
            total = np.zeros(len(part) * LANES)
            for p, h, to in shingle_hashes(flat, RUN, lower=False):
                sizes = np.diff(to)
                h = numbered(h, np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
                where = np.repeat(row[p : p + len(sizes)], sizes) * LANES + (h & np.uint64(LANES - 1)).astype(np.int64)
                total += np.bincount(where, 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(float), len(total))
            lanes[rows] = total.astype(np.int64).astype(np.int16).reshape(-1, LANES)
    return wide, lanes


def texts_of(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The fingerprints as base64 text, little-endian."""
    return [base64.b64encode(w.tobytes() + x.tobytes()).decode() for w, x in zip(v[0].astype("<u8"), v[1].astype("<i2"), strict=True)]


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(map(base64.b64decode, fingerprints))
    raw = np.frombuffer(raw, np.uint8).reshape(len(fingerprints), -1)
    return raw[:, : 8 * WIDE].copy().view("<u8"), raw[:, 8 * WIDE :].copy().view("<i2")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a document with the paragraphs of b inserted (sign 1) or deleted (-1)."""
    (wa, xa), (wb, xb) = parsed([a]), parsed([b])
    return texts_of((wa + wb, xa + xb) if sign > 0 else (wa - wb, xa - xb))[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each row: 1 for equal multisets, else the estimated overlap of their word runs."""
    x, y = a[1].astype(float), b[1].astype(float)
    both = (x * y).sum(1)
    union = (x * x).sum(1) + (y * y).sum(1) - both
    near = np.clip(np.divide(both, union, out=np.zeros(len(x)), where=union > 0), 0, 1)
    return np.where((a[0] == b[0]).all(1), 1.0, near)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint string of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_of(vectors(batch.column(1))), pa.string())], ["id", "fingerprint"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, text, ahead) dealt and sorted so that the next document by descending integer id follows each one.

    The texts move once, to ranges of ids. Of each range its first document also goes to the
    end of the range before it, and the first of all to the end of the last (ahead = 1).
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("key"), F.col(text_col).alias("text"))
    parts = shuffle_partitions(spark)
    cuts = read.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))

    def bucket(key: Column) -> Column:  # as many as there are cuts at or below the key; buckets descend as the order does
        return F.lit(len(cuts)) - F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c <= key))

    # one row a range
    heads = [r[0] for r in read.groupBy(bucket(F.col("key")).alias("bucket")).agg(F.max("key").alias("key")).select("key", "bucket").orderBy("bucket").collect()]
    own = read.withColumn("bucket", bucket(F.col("key")))
    if not heads:
        return own.withColumn("ahead", F.lit(0))
    before = {k: heads[i - 1] for i, k in enumerate(heads)}  # whose range a head also goes to
    to = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("key"))
    copies = F.when(F.col("key").isin(list(before)), F.array(F.struct(F.lit(0).alias("ahead"), F.col("bucket")), F.struct(F.lit(1).alias("ahead"), bucket(to).alias("bucket"))))
    both = own.withColumn("to", F.explode(F.coalesce(copies, F.array(F.struct(F.lit(0).alias("ahead"), F.col("bucket"))))))
    dealt = both.select("id", "key", "text", F.col("to.ahead").alias("ahead"), F.col("to.bucket").alias("bucket")).repartitionById(len(cuts) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("ahead", F.desc("key"), "text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, last = [], [], False

        def out() -> pa.RecordBatch:
            """All rows but the last, which is the next document of the one before it."""
            edited = []
            for x, y in zip(texts, texts[1:], strict=False):
                k = len(x) // 3
                edited.append(x[: len(x) - k] + y[:k])
            v, e = vectors(pa.array(texts, pa.large_string())), vectors(pa.array(edited, pa.large_string()))
            own = v[0][:-1], v[1][:-1]
            columns = [pa.array(ids[:-1], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(texts_of(own)), pa.array(texts_of(e)), pa.array(likeness(own, e)), pa.array(likeness(own, (v[0][1:], v[1][1:])))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                if last:
                    break
                part = batch.slice(at, ROWS)
                ahead = part.column(3).to_pylist()
                end = ahead.index(1) + 1 if 1 in ahead else len(ahead)
                last = end <= len(ahead) and 1 in ahead
                ids += part.column(0).slice(0, end).to_pylist()
                texts += [x or "" for x in part.column(2).slice(0, end).to_pylist()]
                if len(texts) > 1:
                    yield out()
                ids, texts = ids[-1:], texts[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents")).mapInArrow(run, schema)


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
