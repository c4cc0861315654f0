"""Operator 4: language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, every run of other characters than letters becomes a space, and
each 3- and 4-byte window of it that has a space at its ends only is a subword, hashed to
a bucket. Buckets that fewer than RARE of the learned documents have share one bucket, the
unknown. A document is the mean of its subwords' embeddings; a linear layer and a softmax
give the languages and one class more, which is none of them. Embeddings and layer are
trained together by stochastic gradient descent in numpy.

* Sample: whole labelled rows, the first of each language by a hash of the id, at most
  SAMPLE a language, SAMPLE_ALL in all and SAMPLE_BYTES of text (a row that would pass its
  language's share of the bytes is left out of the sample).
* Negatives of the class `none`: made from every NEGATIVE-th sampled text by changing the
  letters of a share of its words (a third, two thirds or all) to others of the sample's letters or
  to letters of no learned alphabet. They teach that unknown subwords speak against
  every language, and that the more there are of them the more so.
* Calibration: a fifth of the sample is kept back, with the negatives made of it. It sets the
  temperature, by the least log loss with labels smoothed by one part in n + 2 (so that a
  faultless fit doesn't send it to 0), and the score below which a prediction is rejected: the
  one that costs the share REJECTED of the kept-back right predictions.

Prediction folds embeddings and layer into one score a bucket and class. The score of a
prediction is its language's probability, with `none` in the denominator; a prediction is
rejected below the learned score, or where `none` is likelier than the language.

Defined results: a null text, or one without a letter, is `und`, scores 0 and is rejected;
so is every text when no label was learned. Texts are read whole. Repeated rows are
predicted each; of rows that repeat an id the smallest (language, text) is learned from; an
empty table gives an empty table; other columns are not read. Equal scores go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.words import release, slices
from orrery.runtime import table

BUCKETS, WIDTH, EPOCHS, RATE, SEED = 1 << 16, 16, 4, 0.6, 7
#: Labelled documents to learn from: at most so many a language, in all, and bytes of their texts in all.
SAMPLE, SAMPLE_ALL, SAMPLE_BYTES = 800, 8000, 32_000_000
#: Samples of a language that the first bound on the hash is set to leave.
MARGIN = 1.5
#: Learned documents that a bucket needs to have an embedding of its own; one text in so many gives a negative.
RARE, NEGATIVE = 2, 4
#: Letters that negatives may take beside the sample's own: one range of code points a script.
SCRIPTS = ((0x100, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3042, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Most that a subword's embedding moves in a step, in parts of the gradient at the mean: the shared bucket would diverge without.
STEP = 4.0
#: Bytes of text whose subwords the driver, and a worker, hold at a time.
TRAIN_BYTES, PREDICT_BYTES = 500_000, 1_000_000
#: Share of the right predictions on kept-back rows that rejection may cost.
REJECTED = 0.002


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row of each) of all subwords of a slice of texts."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    clean = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), clean, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))
    raw = np.frombuffer(clean.buffers()[2], np.uint8)
    ends = np.cumsum(pc.binary_length(clean).to_numpy(zero_copy_only=False))
    first = int(np.frombuffer(clean.buffers()[1], np.int64)[clean.offset])
    b = raw[first : first + int(ends[-1])].astype(np.uint32) if len(ends) else np.zeros(0, np.uint32)
    space = b == 32
    found, where = [], []
    for n in (3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        code, inner = b[:m].copy(), np.zeros(m, bool)
        for k in range(1, n):
            code |= b[k : k + m] << np.uint32(8 * k)
            if k < n - 1:
                inner |= space[k : k + m]
        at = np.flatnonzero(~inner & ~(space[:m] & space[n - 1 : n - 1 + m]))
        found.append(((code[at] * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(16)).astype(np.int32))
        where.append(at)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    # a window that runs into the next text begins in this one's closing spaces and was left out, as it has a space inside
    return np.concatenate(found), rows[np.concatenate(where)]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row a language, and one for none of them: each bucket's contribution, in single precision
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        bucket, row = subwords(texts)
        n = np.maximum(1, np.bincount(row, minlength=len(texts)))
        return np.stack([np.bincount(row, self.scores[k][bucket], len(texts)) / n for k in range(len(self.bias))], axis=1) + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Of each language, and of none in the last column."""
        z = self.logits(texts) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the languages, score, rejected) of texts with a letter."""
        p = self.probabilities(texts)
        own = p[:, :-1]
        best, score = own.argmax(axis=1), own.max(axis=1)
        return best, score, (score < self.reject_below) | (p[:, -1] > score)


def negative(text: str, share: float, alphabet: list[str], rng: np.random.Generator) -> str:
    """The text with other letters in about `share` of its words, all from one script or from the learned letters."""
    lo, hi = SCRIPTS[rng.integers(len(SCRIPTS))]
    own = rng.random() < 0.6

    def other(word: str) -> str:
        if rng.random() >= share:
            return word
        picks = rng.random(len(word))
        return "".join((alphabet[int(x * len(alphabet))] if own else chr(lo + int(x * (hi - lo + 1)))) if c.isalpha() else c for c, x in zip(word, picks.tolist(), strict=True))

    return " ".join(map(other, text.split(" ")))


def train(texts: list[str], labels: list[str]) -> Model | None:
    """Fit on the rows given, in a fixed order; None without rows."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    none = len(languages)
    code = [languages.index(x) for x in labels]
    kept = rng.permutation(len(texts)) % 5 == 0
    if len(texts) < 20:
        kept[:] = False
    alphabet = sorted({c for t in texts for c in t if c.isalpha()})
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for at, part in slices(pa.array(texts, pa.large_string()), TRAIN_BYTES):
        docs += [counted(x) for x in split(part)]
        release()
    made = [i for i in range(len(texts)) if i % NEGATIVE == 0 and alphabet]
    for j, i in enumerate(made):
        docs += [counted(x) for x in split(pa.array([negative(texts[i], (1 / 3, 2 / 3, 1)[j % 3], alphabet, rng)], pa.large_string()))]
    code, kept = np.array(code + [none] * len(made)), np.concatenate([kept, kept[made]]).astype(bool)
    learn = np.flatnonzero(~kept)
    # buckets of few documents of a language are one, and its embedding is learned from them
    has = np.zeros(BUCKETS, np.int32)
    for i in learn[code[learn] != none]:
        has[docs[i][0]] += 1
    to = np.where(has >= min(RARE, max(1, len(learn) // 20)), np.arange(BUCKETS), 0).astype(np.int32)
    docs = [folded(to[bucket], share) for bucket, share in docs]
    embed = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((WIDTH, none + 1), np.float32), np.zeros(none + 1, np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate, (bucket, share) = np.float32(RATE * (1 - step / steps)), docs[i]
            step += 1
            v = share @ embed[bucket]
            z = v @ layer + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[code[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(v, error)
            bias -= rate * error
            # a subword's share of the mean is small, so its step is scaled up to the number of subwords; not that of a frequent one
            embed[bucket] -= rate * np.outer(np.minimum(share * min(len(bucket), 256), STEP), back)
    scores = (embed @ layer).astype(float)
    model = Model(languages, np.ascontiguousarray(scores[to].T, dtype=np.float32), bias.astype(float))
    hold = np.flatnonzero(kept)
    if len(hold):
        z = np.stack([share.astype(float) @ scores[bucket] for bucket, share in (docs[i] for i in hold)]) + model.bias
        smooth = 1 / (len(hold) + 2)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            log = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
            return float(-np.mean((1 - smooth) * log[np.arange(len(hold)), code[hold]] + smooth * log.mean(axis=1)))

        model.temperature = float(min(np.geomspace(0.1, 10, 80), key=loss))
        p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        p /= p.sum(axis=1, keepdims=True)
        right = np.sort(p[:, :-1].max(axis=1)[(code[hold] != none) & (p.argmax(axis=1) == code[hold])])
        if len(right):
            model.reject_below = float(right[int(REJECTED * len(right))])
    return model


def split(part: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their counts) of each text, each bucket once."""
    bucket, row = subwords(part)
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(part) + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.int32), count[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def counted(x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return x[0], (x[1] / max(1, x[1].sum())).astype(np.float32)


def folded(bucket: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets once each, with the sum of their shares."""
    one, at = np.unique(bucket, return_inverse=True)
    return one, np.bincount(at, share, len(one)).astype(np.float32)


def held_out(id_col: str) -> Column:
    """Whether a row is never learned from: the checksum of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(rows: DataFrame, counts: dict[str, int]) -> list:
    """(id, lang, bytes) of the first SAMPLE ids of each language by hash, SAMPLE_ALL in all, from labelled rows (id, lang, text).

    Only rows below a hash that leaves about MARGIN samples of their language are ranked, so a
    language with a third of all rows costs as much as a rare one. Where repeated ids leave
    too few, the bound rises for all.
    """
    place, wide = F.xxhash64("id"), 1.0
    while True:
        below = {x: min(1.0, wide * (MARGIN * SAMPLE + 50) / n) for x, n in counts.items()}
        bound = F.element_at(F.create_map(*(F.lit(v) for x, part in below.items() for v in (x, 2**63 - 1 if part == 1 else int(part * 2**64) - 2**63))), F.col("lang"))
        near = rows.where(place <= bound).groupBy("lang", "id").agg(F.min(F.octet_length("text")).alias("bytes"))
        ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))).where(F.col("k") <= SAMPLE)
        found = ranked.orderBy("k", "lang").collect()
        got: dict[str, int] = {}
        for r in found:
            got[r["lang"]] = got.get(r["lang"], 0) + 1
        if all(part == 1 or got.get(x, 0) >= SAMPLE for x, part in below.items()):
            return found[:SAMPLE_ALL]
        wide *= 8


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    first = sampled(rows, counts)
    share = SAMPLE_BYTES // max(1, len({r["lang"] for r in first}))
    used: dict[str, int] = {}
    ids = []
    for r in first:
        if used.get(r["lang"], 0) + (r["bytes"] or 0) <= share:
            used[r["lang"]] = used.get(r["lang"], 0) + (r["bytes"] or 0)
            ids.append(r["id"])
    once = rows.where(F.col("id").isin(ids) & F.col("text").isNotNull()).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("m"))
    sample = once.select("id", "m.lang", "m.text").toArrow().sort_by("id")
    texts, labels = sample["text"].to_pylist(), sample["lang"].to_pylist()
    del sample
    try:
        return train(texts, labels)
    finally:
        release()  # the driver lives on, too


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`'s rows as (id_col, lang_pred, score, rejected)."""
    seen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = seen.value
        for batch in batches:
            for first, part in slices(batch.column(1), PREDICT_BYTES):
                lettered = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                if m is None:
                    name, score = np.full(len(part), "und", object), np.zeros(len(part))
                    bad = np.ones(len(part), bool)
                else:
                    best, score, bad = m.predict(part)
                    name = np.where(lettered, np.array(m.languages, object)[best], "und")
                    score, bad = np.where(lettered, score, 0.0), ~lettered | bad
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(name, pa.string()), pa.array(score), pa.array(bad)], ["id", "lang_pred", "score", "rejected"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is not rejected, with all their columns."""
    seen = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = seen.value
        for batch in batches:
            for first, part in slices(batch.column(at), PREDICT_BYTES):
                keep = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                keep &= ~m.predict(part)[2] if m else False
                yield batch.slice(first, len(part)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
